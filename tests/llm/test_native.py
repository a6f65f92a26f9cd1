"""Quality rules and line dedup: oracles, brute force, defined results, plans without Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest

from lexloom.llm import line_dedup, quality_rules, queries
from tests.compare import duck_rows, spark_rows
from tests.conftest import SMALL
from tests.llm.conftest import ODD, clashing

SPACE = " \t\n\x0b\f\r"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, name):
    assert spark_rows(queries.QUERIES[name](spark, SMALL)) == duck_rows(duck, queries.ORACLES[name])


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, make_docs):
    texts = [*ODD, "a b c d e f g h i j a b c d e f g h z " * 3, "%% ## <|> a&b"]
    rows = quality_rules.digest(make_docs(texts)).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(texts[r.doc_id]), texts[r.doc_id][:40]
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_keeps_prose_and_drops_junk(make_docs):
    prose = "The river ran to the north of the old town and it was wide. People came from the hills with wood for the winter, and they sold it at the market that stood by the bridge."
    junk = [prose.upper(), " | ".join(prose.replace("the", "x").split()), " ".join(w + "%%%" for w in prose.split())]
    docs = make_docs([prose, "De la casa que el rey hizo para los hijos de la reina se ve el mar, y en el puerto hay barcos que llegan con vino de las islas del sur cada semana.", *junk])
    assert sorted(r.doc_id for r in quality_rules.filter_quality(docs).collect()) == [0, 1]


def test_quality_filter_keeps_columns(make_docs):
    docs = clashing(make_docs(ODD))
    out = quality_rules.filter_quality(docs)
    assert out.columns == docs.columns
    assert out.count() <= docs.count()
    assert "quality" in quality_rules.score(docs).columns
    assert quality_rules.digest(docs.limit(0)).count() == 0


def brute_lines(texts, least=10):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    split = [(t or "").split("\n") for t in texts]
    docs = Counter(k for ls in split for k in {key(x) for x in ls})
    out = []
    for ls in split:
        kept = [x for x in ls if not (key(x) and docs[key(x)] >= least)]
        out.append((len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_line_dedup(make_docs):
    texts = [*ODD, *(f"Common LINE \nown {i}\n\tcommon line\n" for i in range(9)), "common line", "common line\n" * 3, *(f"nine {i}\nrare" for i in range(9)), "É\né"]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.digest(make_docs(texts)).collect()}
    assert got == dict(enumerate(brute_lines(texts)))


def test_line_dedup_rows_are_documents(make_docs):
    """Ten equal rows of one id are ten documents; null ids do not mix up."""
    docs = make_docs(["same\nown"] * 10 + ["x", "y"], ids=[1] * 10 + [None, None])
    out = line_dedup.drop_common_lines(clashing(docs))
    assert sorted(r.text for r in out.collect()) == [""] * 10 + ["x", "y"]
    assert out.columns == clashing(docs).columns
    assert line_dedup.drop_common_lines(docs.limit(0)).count() == 0


def test_null_text_stays_null(make_docs):
    assert [r.text for r in line_dedup.drop_common_lines(make_docs([None])).collect()] == [None]


@pytest.mark.parametrize("name", ["op6_quality_rules", "op10_line_dedup"])
def test_native_plans(spark, name):
    plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert "Cartesian" not in plan and "NestedLoop" not in plan
