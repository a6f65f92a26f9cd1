"""MinHash near-duplicates, sketches and group links against brute force."""

from __future__ import annotations

import random
import re
from functools import partial

import numpy as np
import pytest

from lexloom.llm import components, groups, minhash
from lexloom.session import table
from tests.conftest import SMALL
from tests.llm.conftest import ODD, clashing


def brute_set(text) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 4]) for i in range(len(words) - 3)) or frozenset([tuple(words)])


def brute(ids, texts) -> list:
    sets = [brute_set(t) for t in texts]
    distinct = list({s for s in sets if s})
    parent = list(range(len(distinct)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for j in range(i):
            b = distinct[j]
            common = len(a & b)
            if 100 * common >= 80 * (len(a) + len(b) - common):
                parent[top(i)] = top(j)
    number = {s: top(i) for i, s in enumerate(distinct)}
    least: dict = {}
    for i, s in zip(ids, sets, strict=True):
        if s and i is not None:
            least[number[s]] = min(i, least.get(number[s], i))
    out = []
    for i, s in zip(ids, sets, strict=True):
        c = least.get(number[s]) if s else i
        out.append((i is None, i or 0, len(s), c is None, c or 0, i == c))
    return sorted(out)


def found(df) -> list:
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id is None, r.component_id or 0, r.kept) for r in minhash.digest(df).collect())


def test_on_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = docs.collect()
    assert found(docs) == brute([r.doc_id for r in rows], [r.text for r in rows])


def test_odd_rows(make_docs):
    texts = [*ODD, "A b\tC", "a  b c", "a b", "The Cat sat on the mat today", None]
    ids = [*range(len(texts) - 3), None, None, 3]
    docs = clashing(make_docs([*texts, *texts[:4]], ids=[*ids, None, None, 3, 3]))
    rows = minhash.digest(docs)
    got = found(docs)
    assert got == brute([*ids, None, None, 3, 3], [*texts, *texts[:4]])
    assert rows.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    sets = [brute_set(t) for t in [*texts, *texts[:4]]]
    assert kept.count() == len({s for s in sets if s}) + sum(not s for s in sets)
    assert minhash.digest(docs.limit(0)).count() == 0 and minhash.drop_near_duplicates(docs.limit(0)).count() == 0


def edited(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
    return " ".join(words)


def test_hot_groups_in_chunks(spark, make_docs):
    """One group of near copies, edited so that links form chains and leave some alone, a hot passage and a hot copy."""
    draw = random.Random(3)
    base = [f"w{draw.randrange(3000)}" for _ in range(120)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [edited(draw, base, draw.choice([0, 1, 2, 3, 4, 5, 8])) for _ in range(300)]
    texts += [passage + " " + " ".join(f"q{draw.randrange(10**6)}" for _ in range(draw.choice([5, 40]))) for _ in range(200)]
    texts += ["one two three four five six"] * 400
    docs = make_docs(texts)
    want = brute(list(range(len(texts))), texts)
    assert len({c for *_, c, _ in want}) > 20
    assert found(docs) == want
    small = minhash.components(docs, sketch_cap=32, set_cap=4000)
    assert sorted((False, r.doc_id, r.n, False, r.component_id, r.doc_id == r.component_id) for r in small.collect()) == want


def test_sketches_estimate_and_fill():
    draw = np.random.default_rng(5)
    pools = [draw.integers(0, 2**63, 3000).astype(np.uint64) for _ in range(3)]
    for j in (0.2, 0.5, 0.8):
        agreed = []
        for size in (1, 5, 40, 3000):
            for trial in range(30):
                common = draw.integers(0, 2**63, max(1, round(size * j))).astype(np.uint64)
                rest = (size - len(common)) // 2
                a = np.concatenate([common, draw.integers(0, 2**63, rest).astype(np.uint64)])
                b = np.concatenate([common, draw.integers(0, 2**63, rest).astype(np.uint64)])
                s = minhash.sketches([a, b, pools[trial % 3]])
                assert (s != np.iinfo(np.uint64).max).all()
                if size == 3000:
                    agreed.append((s[0] == s[1]).mean())
                assert (minhash.sketches([a])[0] == s[0]).all()  # alone as among others
        assert abs(np.mean(agreed) - len(common) / (len(common) + 2 * rest)) < 0.03
    assert minhash.least_agreement() > 60 and len(minhash.bands(s)[0]) == minhash.BANDS


@pytest.mark.parametrize("cap", [10, 40, 10_000])
def test_group_links(spark, cap):
    """Every component inside a key, also in groups of chunks."""
    draw = random.Random(8)
    rows, want = [], {}
    for key in range(12):
        members = [frozenset(draw.sample(range(30), draw.randint(1, 3))) for _ in range(draw.choice([1, 2, 17, 90]))]
        for k, s in enumerate(members):
            rows.append((key, key * 1000 + k, len(s), np.array(sorted(s), np.uint64).tobytes()))
    df = spark.createDataFrame([(a, b, c, bytearray(d)) for a, b, c, d in rows], "key long, node long, size long, payload binary")
    stars = {r.node: r.root for r in components.connected_components(groups.group_links(df, partial(minhash.SetMeasure, percent=50), cap)).collect()}
    parent = {n: n for _, n, _, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {n: set(np.frombuffer(p, np.uint64).tolist()) for _, n, _, p in rows}
    for k1, a, _, _ in rows:
        for k2, b, _, _ in rows:
            if k1 == k2 and a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    want = {n: top(n) for n in parent}
    assert {n: stars.get(n, n) for n in parent} == want
