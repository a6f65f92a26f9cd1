"""SimHash links, components, mixing and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest
import xxhash

from lexloom.llm import components, line_dedup, mixing, quality_rules, simhash
from lexloom.session import table
from tests.conftest import SMALL
from tests.llm.conftest import ODD, clashing

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def brute_fingerprint(text) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints) -> dict:
    """Least id reachable per position, by union of all pairs within four bits."""
    parent = list(range(len(ids)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    array = np.array(prints, dtype=np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= 4) + i + 1:
            a, b = top(i), top(int(j))
            parent[max(a, b)] = min(a, b)
    groups: dict = {}
    for i in range(len(ids)):
        groups.setdefault(top(i), []).append(ids[i])
    least = {t: min((x for x in g if x is not None), default=None) for t, g in groups.items()}
    return {i: least[top(i)] for i in range(len(ids))}


def test_simhash_on_documents(spark):
    docs = table(spark, SMALL, "documents")
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    found = brute_components([r.doc_id for r in rows], prints)
    want = {r.doc_id: (f"{p:016x}", found[i]) for i, (r, p) in enumerate(zip(rows, prints, strict=True))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.digest(docs).collect()} == want


def test_simhash_odd_rows(make_docs):
    docs = clashing(make_docs([*ODD, *ODD], ids=[*range(len(ODD)), *[None] * len(ODD)]))
    rows = simhash.digest(docs).collect()
    assert len(rows) == 2 * len(ODD)
    blank = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.component_id for r in blank} == {0} and len(blank) == 8
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r.component_id for r in rows})
    assert simhash.digest(docs.limit(0)).count() == 0


def test_one_row_of_each_group_stays(make_docs):
    """Repeated ids and all-null groups leave one row each."""
    docs = make_docs(["a b c d e f"] * 3 + ["q w e r t y u i"] * 2, ids=[5, 5, 7, None, None])
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.drop_near_duplicates(docs).collect()) == [(False, 5), (True, 0)]


def near_prints(n: int, seed: int) -> list[int]:
    """Clusters of prints a few bits apart, and loose ones."""
    draw = random.Random(seed)
    out = set()
    while len(out) < n:
        centre = draw.getrandbits(64)
        for _ in range(draw.choice([1, 1, 3, 40])):
            x = centre
            for b in draw.sample(range(64), draw.randint(0, 6)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)[:n]


@pytest.mark.parametrize(("cell_rows", "agree"), [(4096, 2), (16, 2), (200, 2), (16, 4), (4096, 3), (4096, 5)])
def test_links_span_all_components(spark, cell_rows, agree):
    """Also where cells are cut into chunks, and on finer grids."""
    prints = near_prints(700, 9)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    stars = {r.node: r.root for r in components.connected_components(simhash.links(df, cell_rows=cell_rows, agree=agree)).collect()}
    got: dict = {}
    for s in signed:
        got.setdefault(stars.get(s, s), set()).add(s)
    want: dict = {}
    for i, least in brute_components(signed, prints).items():
        want.setdefault(least, set()).add(signed[i])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert any(len(g) > 20 for g in got.values())


def test_one_dense_cell(spark):
    """50,000 prints within two bits of one centre, a few chains that leave it, and loose prints."""
    draw = random.Random(2)
    centre = draw.getrandbits(64)
    dense = {centre}
    while len(dense) < 50_000:
        x = centre
        for b in draw.sample(range(64), 4):
            x ^= 1 << b
        dense.add(x)
    chain, at = [], centre ^ 0xFF  # eight bits off the centre, then ever farther in steps of four
    for step in range(2, 6):
        chain.append(at)
        at ^= 0xF << (4 * step)
    loose = [draw.getrandbits(64) for _ in range(200)]
    signed = [p - (1 << 64) if p >> 63 else p for p in [*dense, *chain, *loose]]
    df = spark.createDataFrame([(s,) for s in signed], "fp long").repartition(4)
    stars = {r.node: r.root for r in components.connected_components(simhash.links(df)).collect()}
    groups: dict = {}
    for s in signed:
        groups.setdefault(stars.get(s, s), set()).add(s)
    sizes = sorted(map(len, groups.values()))
    assert sizes[-1] == 50_000 + len(chain) and sizes[:-1] == [1] * 200


def test_grid_grows_with_the_points():
    assert [simhash.grid_for(n, 4) for n in (0, 10**5, 2 * 10**6, 10**8)] == [2, 2, 3, 6]
    assert len(simhash.subspace_masks(4, 2)) == 15 and len(set(simhash.subspace_masks(4, 3))) == 35


def test_lower_bound():
    a, b = (np.array(near_prints(300, s), dtype=np.uint64) for s in (1, 2))
    near = b ^ (a & np.uint64(0xF0F))
    for x, y in ((a, b), (b, near)):
        count = lambda v: np.stack([np.bitwise_count(v >> np.uint64(2 * i) & np.uint64(3)) for i in range(32)])
        distance = np.abs(count(x).astype(int) - count(y)).sum(0)
        assert (simhash._manhattan(simhash._embed_array(x), simhash._embed_array(y)) == distance).all()
        assert (distance <= np.bitwise_count(x ^ y)).all()


def test_components_of_a_path(spark):
    n = 60
    edges = spark.createDataFrame([((7 * i) % n, (7 * i + 7) % n) for i in range(n - 1)] + [(100, 101), (5, 5)], "u long, v long")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(n)}, 100: 100, 101: 100}
    assert components.connected_components(edges.limit(0)).count() == 0


# --- Mixing


def reference_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_names, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_names:
        total = sum(weight[s] for s in open_names)
        over = [s for s in open_names if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_names}
        for s in over:
            out[s] = 2 * sizes[s]
            open_names.remove(s)
        left = 1.5 * sum(sizes.values()) - sum(out.values())
    return out


def check_mix(docs, tolerance):
    rows = mixing.digest(docs).collect()
    texts = {r.doc_id: r for r in docs.select("doc_id", "text", "source").collect()}
    sizes: dict = {}
    taken: dict = {}
    for r in rows:
        t = texts[r.doc_id]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", t.text or ""))
        assert r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        sizes[t.source] = sizes.get(t.source, 0) + r.size
        taken[t.source] = taken.get(t.source, 0) + r.taken
    targets = reference_targets(sizes)
    for r in rows:
        s = texts[r.doc_id].source
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s])
    for s, t in targets.items():
        assert abs(taken[s] - t) <= tolerance * max(t, 1), (s, taken[s], t)
    return {r.doc_id: r.taken for r in rows}


def test_mix_meets_targets_and_repeats_itself(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    assert check_mix(docs, 0.01) == check_mix(docs.repartition(7), 0.01)


def test_mix_in_chunks(spark):
    """Levels of chunks balance as one flight does."""
    sized = spark.range(4000).selectExpr("id as doc_id", "'s' || cast(id % 2 as string) as source", "1 + id * 7919 % 500 as size")
    targets = mixing.plan(sized)
    for r in mixing.take(sized, targets, chunk=64).groupBy("source", "target").agg({"*": "count"}).collect():
        assert r["count(1)"] == 2000
    out = mixing.take(sized, targets, chunk=64).selectExpr("source", "target", "copies * size as t").groupBy("source", "target").sum("t").collect()
    assert all(abs(r["sum(t)"] - r.target) < 0.01 * r.target for r in out)


def test_mix_odd_rows(make_docs):
    docs = make_docs([*ODD, *ODD], sources=[None, "b", "a", "b"] * 6)
    check_mix(docs, 2.0)
    mixed = mixing.mix(clashing(docs))
    assert mixed.columns == clashing(docs).columns
    assert mixing.digest(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
    assert {r.target for r in mixing.digest(make_docs([None, ""])).collect()} == {0.0}


def test_mix_keeps_large_ids_beside_nulls(make_docs):
    big = (1 << 62) + 1
    docs = make_docs(["a b c"] * 4, sources=["s"] * 4, ids=[None, big, big + 2, None])
    assert {r.doc_id for r in mixing.digest(docs).collect()} == {None, big, big + 2}


def test_mix_repeats_rows_as_drawn(spark):
    docs = table(spark, SMALL, "documents")
    drawn = {r.doc_id: r.taken // r["size"] for r in mixing.digest(docs).collect() if r["size"]}
    got: dict = {}
    for r in mixing.mix(docs).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert {k: v for k, v in got.items() if k in drawn} == {k: v for k, v in drawn.items() if v}


def test_mix_of_one_repeated_id(spark):
    """A third of all rows have one id: they are dealt over chunks, and each kind of row gets its share."""
    docs = spark.range(30_000).selectExpr(
        "case when id % 3 = 0 then null else id end as doc_id", "case when id % 3 = 0 then repeat('w ', 7) else repeat('v ', cast(1 + id % 20 as int)) end as text", "'en' as lang",
        "'s' || cast(id % 2 as string) as source", "id % 6 as n_chars",
    )
    sized = mixing.sized_rows(docs)
    ranks = mixing._numbered(sized.select("doc_id", "source", "size", "th"))
    assert ranks.filter("doc_id is null").select("source", "nth").distinct().count() == 10_000
    rows = mixing.digest(docs)
    assert rows.count() == 30_000
    sums = rows.groupBy("target").agg({"taken": "sum"}).collect()
    assert all(abs(r["sum(taken)"] - r.target) < 0.002 * r.target for r in sums)
    want = rows.filter("doc_id is null").selectExpr("sum(taken div size) as n").first().n
    mixed = mixing.mix(docs)
    assert mixed.filter("doc_id is null").count() == want and mixed.columns == docs.columns
    per = {r.n_chars: r["count"] for r in mixed.filter("doc_id is null").groupBy("n_chars").count().collect()}
    assert set(per) == {0, 3} and all(abs(n - 5000 * r.target / r.source_size) < 100 for n, r in zip(sorted(per.values()), sorted(rows.select("target", "source_size").distinct().collect(), key=lambda r: r.target / r.source_size), strict=True))


def test_flight_keeps_expectations():
    sizes, probs = [50, 9, 9, 7, 3, 2, 1, 1], [0.3] * 8
    sums = np.zeros(8)
    for seed in range(4000):
        draw = random.Random(seed)
        flown = mixing._land(sizes, mixing._flight(sizes, probs, draw), draw)
        assert all(p in (0.0, 1.0) for p in flown)
        sums += flown
    assert np.abs(sums / 4000 - 0.3).max() < 0.04


# --- The pipeline


def test_pipeline(spark):
    import tiktoken

    import corpus_pipeline
    from lexloom.llm import bpe

    docs = table(spark, SMALL, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    verdicts = {r.doc_id: r.kept for r in quality_rules.digest(docs).collect()}
    kept = {i: r.text for i, r in rows.items() if verdicts[i]}
    lines = brute_drop(kept)
    prints = [brute_fingerprint(t) for t in lines.values()]
    least = brute_components(list(lines), prints)
    single = {i: lines[i] for k, i in enumerate(lines) if least[k] == i}
    stage_docs = spark.createDataFrame([(i, t, rows[i].lang, rows[i].source, len(t)) for i, t in single.items()], "doc_id long, text string, lang string, source string, n_chars long")
    copies = {r.doc_id: r.taken // r["size"] if r["size"] else None for r in mixing.digest(stage_docs).collect()}
    path, pattern = bpe.public_vocabulary()
    encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.codec(path, pattern).ranks, special_tokens={})
    got: dict = {}
    for r in corpus_pipeline.run(spark, SMALL).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
        ids = encoder.encode_ordinary(single[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(single[r.doc_id].encode()).hexdigest()
    assert {i: n for i, n in got.items() if copies[i] is not None} == {i: n for i, n in copies.items() if n}


def brute_drop(texts: dict) -> dict:
    from collections import Counter

    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))
    seen = Counter(k for t in texts.values() for k in {key(x) for x in t.split("\n")})
    return {i: "\n".join(x for x in t.split("\n") if not key(x) or seen[key(x)] < line_dedup.MIN_DOCUMENTS) for i, t in texts.items()}


def test_stages_return_documents(spark):
    import corpus_pipeline

    docs = table(spark, SMALL, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
        assert stage(spark, docs.limit(0), SMALL).count() == 0
