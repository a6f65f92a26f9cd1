"""Helpers of the training-data operators' tests."""

from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their results or inside; an input may have them too.
EXTRA = "pos int, quality string, kept string, fp string, root string, ids string, media string, size string, h1 string, row string, s string, t string, i string, __s string, __id string, __th string, __h string, __i string, __n string, __z string, __rep string, __gone string, __quality string, th string, salt string, nth string, own_i string"


def clashing(docs):
    from pyspark.sql import functions as F

    return docs.selectExpr("*", *(f"cast('x' as {kind}) as `{name}`" for name, kind in (e.split() for e in EXTRA.split(", ")) if kind == "string"), "7 as pos").withColumn("__extra", F.lit(1))


@pytest.fixture
def make_docs(spark):
    def make(texts, sources=None, langs=None, ids=None):
        n = len(texts)
        rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", len(t) if t is not None else None) for i, t in zip(range(n), texts, strict=True)]
        return spark.createDataFrame(rows, DOCS)

    return make


#: Null, empty, blank, very long, tied and repeated texts.
ODD = [None, "", " \t\n", "word", "a b c d e f g h " * 20, "the cat sat on the mat. " * 20000, "ß ÉÀ 漢字 😀 \x00 ok", "line\nline\n\nline", "x\n" * 50, "one two three four five six", "one two three four five six", "\r\n\x0b\x0c"]
