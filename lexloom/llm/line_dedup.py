"""Removal of lines that many documents share (native).

Lines are exploded with their positions, their normalised keys hashed to 128 bits, and documents counted per
hash with a map-side combine. Only hashes and positions travel to find what goes; each text is shuffled once,
to meet its own list of positions, and rebuilt from the slices between them.

Defined results: every row is a document, so repeated rows count one each; a null or empty text is one empty
line, whose empty key never goes; a null doc_id is a value like any other; extra columns pass through
:func:`drop_common_lines`; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import SPACE, durable, let, lower_ascii, packed, unpacked

MIN_DOCUMENTS = 10
MIN_KEY = 1


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keys(text: Column, min_key: int) -> Column:
    """Per line: two differently seeded 64-bit hashes of the key; null where the key is too short."""
    key = lambda line: lower_ascii(F.btrim(line, F.lit(SPACE)))
    pair = lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))
    return F.transform(
        _lines(text), lambda line: let(key(line), lambda k: F.when(F.length(k) >= min_key, pair(k)))
    )


def common_keys(df: DataFrame, text: str = "text", min_documents: int = MIN_DOCUMENTS, min_key: int = MIN_KEY) -> DataFrame:
    """Hashes of the keys found in at least ``min_documents`` rows."""
    one_each = df.select(F.explode(F.array_compact(F.array_distinct(_keys(F.col(f"`{text}`"), min_key)))).alias("k"))
    counted = one_each.groupBy(F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2")).agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= min_documents).select("h1", "h2")


def mark_lines(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", min_documents: int = MIN_DOCUMENTS, min_key: int = MIN_KEY
) -> DataFrame:
    """``row`` (the input's columns) and ``gone``: the sorted positions of the lines that go (null if none)."""
    whole = F.col(f"`{text}`")
    identity = {"i": F.col(f"`{doc_id}`"), "t": F.xxhash64(F.coalesce(whole, F.lit("")))}
    # A finished table: the join below then has two plain shuffles, of which adaptive execution can split the
    # partition of a very common line.
    common = durable(common_keys(df, text, min_documents, min_key))
    placed = df.select(*(c.alias(n) for n, c in identity.items()), F.posexplode(_keys(whole, min_key)).alias("pos", "k")).filter("k is not null")
    hits = placed.select("i", "t", "pos", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2")).join(common, ["h1", "h2"], "left_semi")
    gone = hits.groupBy(F.col("i").alias("gi"), F.col("t").alias("gt")).agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    joined = packed(df, **identity).join(gone, F.col("i").eqNullSafe(F.col("gi")) & (F.col("t") == F.col("gt")), "left")
    return joined.select("row", "gone")


def _kept(lines: Column, gone: Column) -> Column:
    """Lines between the positions that go; linear in the lines."""

    def slices(bounds: Column) -> Column:
        pieces = F.transform(
            F.sequence(F.lit(0), F.size(bounds) - 2),
            lambda i: F.slice(lines, F.get(bounds, i) + 2, F.get(bounds, i + 1) - F.get(bounds, i) - 1),
        )
        return F.flatten(pieces)

    bounds = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    return F.when(gone.isNull(), lines).otherwise(let(bounds, slices))


def _rebuilt(text: Column, gone: Column) -> Column:
    return let(
        _lines(text),
        lambda ls: F.struct(
            F.size(ls).cast("long").alias("n_lines"),
            F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
            F.array_join(_kept(ls, gone), "\n").alias("text"),
        ),
    )


def drop_common_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **limits) -> DataFrame:
    """The input's rows and columns with the common lines gone from ``text``; a null text stays null."""
    marked = mark_lines(df, text, doc_id, **limits)
    whole = F.col("row").getField(text)
    return unpacked(marked, df.columns, **{text: F.when(F.col("gone").isNull(), whole).otherwise(_rebuilt(whole, F.col("gone"))["text"])})


def digest(docs: DataFrame) -> DataFrame:
    marked = mark_lines(docs.select("doc_id", "text"))
    out = marked.select("row.doc_id", F.explode(F.array(_rebuilt(F.col("row.text"), F.col("gone")))).alias("r"))
    return out.select("doc_id", "r.n_lines", "r.n_dropped", F.sha2(F.col("r.text"), 256).alias("kept_sha256"))


ORACLE = r"""
    WITH t AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM t),
    k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10)
    SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(c.key)::BIGINT AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
    FROM k LEFT JOIN c USING (key) GROUP BY rid
    """
