"""Clustering with bounds and fill-in-middle against brute force."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import clustering, infill
from lexloom.session import table
from tests.conftest import SMALL
from tests.llm.conftest import ODD, clashing

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_clusters(rows, k, rounds, size, scale=1024, seed="3:"):
    """Lloyd with Python integers; rows: (id, vector)."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    told = lambda r: (r[0] is None, hashlib.sha256(f"{seed}{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [list(p) for _, p in sorted(kept, key=told)[:k]]
    apart = lambda p, c: sum((a - b) ** 2 for a, b in zip(p, c, strict=True))
    nearest = lambda p: min(range(len(centroids)), key=lambda c: (apart(p, centroids[c]), c))
    for _ in range(rounds):
        groups: dict = {}
        for _, p in kept:
            groups.setdefault(nearest(p), []).append(p)
        for c, members in groups.items():
            centroids[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    out = [(i, c := nearest(p), apart(p, centroids[c])) for i, p in kept]
    total = sum(d for _, _, d in out)
    return sorted(((i is None, i or 0), c, d, sum(e for _, x, e in out if x == c), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in out)


def found_clusters(df, **parameters):
    return sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in clustering.digest(df, **parameters).collect())


def test_clusters_of_odd_rows(spark):
    draw = random.Random(4)
    ties = [float(draw.choice([0, 0, 1, -1])) for _ in range(4)]
    rows = [(i, [float(draw.choice([-1, 0, 1])) for _ in range(4)], 0) for i in range(60)]
    rows += [(100 + i, ties, 0) for i in range(90)]  # a hot vector
    rows += [(i, [0.5, -0.001, 0.25, 9.0], None) for i in (7, 7, None, None)]
    rows += [(500, None, 0), (501, [], 0), (502, [1.0] * 3, 0), (503, [1.0, None, 1.0, 1.0], 0), (504, [1.0, float("nan"), 1.0, 1.0], 0), (505, [float("-inf")] + [1.0] * 3, 0)]
    df = clashing(spark.createDataFrame(rows, VECTORS)).withColumnRenamed("s", "cluster").withColumnRenamed("t", "p").repartition(5)
    for k in (1, 3, 8):
        assert found_clusters(df, clusters=k, rounds=4, size=4) == brute_clusters([r[:2] for r in rows], k, 4, 4)
    few = spark.createDataFrame(rows[:3], VECTORS)
    assert found_clusters(few, clusters=8, rounds=2, size=4) == brute_clusters([r[:2] for r in rows[:3]], 8, 2, 4)
    assert clustering.digest(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="scaled component"):
        clustering.digest(spark.createDataFrame([(1, [1e9] * 64, 0)], VECTORS))


def test_many_clusters_with_long_lists(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SMALL, "embeddings").collect()]
    assert found_clusters(table(spark, SMALL, "embeddings"), clusters=40, rounds=5) == brute_clusters(rows, 40, 5, 64)


def test_bounds_certify_only_what_is_true():
    """Against full measuring, over many moves; most rows are certified without a distance."""
    draw = np.random.default_rng(1)
    centres = draw.integers(-4000, 4000, (24, 16))
    points = centres[draw.integers(0, 24, 3000)] + draw.integers(-300, 300, (3000, 16))
    centroids = points[:24].copy()
    bounds = clustering.Bounds.measured(points, centroids, 6)
    measured = []
    for step in range(12):
        new = np.array([points[bounds.a == c].sum(axis=0) // max(1, (bounds.a == c).sum()) if (bounds.a == c).any() else centroids[c] for c in range(24)])
        drift = np.sqrt(((new - centroids) ** 2).sum(axis=1)) * (1 + clustering.SLACK)
        centroids = new
        measured.append(bounds.shortened(6 - step // 3).moved(points, centroids, drift))
        exact = clustering.distances(points, centroids)
        assert (bounds.a == exact.argmin(axis=1)).all()
        root = np.sqrt(exact.astype(float))
        assert (bounds.u >= root[np.arange(3000), bounds.a]).all()
        assert (bounds.low <= np.take_along_axis(root, bounds.near, 1)).all()
        other = root.copy()
        np.put_along_axis(other, np.concatenate([bounds.near, bounds.a[:, None]], axis=1), np.inf, 1)
        assert (bounds.rest <= other.min(axis=1)).all()
    assert measured[-1] < 0.2 * 3000 * 24


# --- Fill-in-middle


@given(st.text(alphabet="ab é漢😀<PSM>\n", max_size=80), st.integers(1, 9))
def test_runs(text, block):
    data = text.encode()
    runs = infill.runs_of(data, block)
    assert runs.n == len(text)
    assert [runs.offset(u) for u in range(len(text) + 1)] == [len(text[:u].encode()) for u in range(len(text) + 1)]
    assert all(a != b for a, b in zip(runs.widths, runs.widths[1:], strict=False))


@given(st.text(alphabet="ab é漢😀<PSM>", max_size=60), st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4))
@settings(max_examples=300, deadline=None)
def test_forms_restore(text, h):
    data = text.encode()
    runs = infill.runs_of(data)
    form, a, b = infill.plan(data, runs.n, h)
    output = infill.arrange(data, runs, form, a, b)
    assert infill.restore(output, form) == data
    want = {"plain": text, "psm": f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", "spm": f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"}[form]
    assert output.decode() == want


def test_infill_odd_rows(make_docs):
    texts = [*ODD, "say <P> here", "é漢" * 300_000, *(f"text {i} é" for i in range(200))]
    docs = clashing(make_docs([*texts, None, "x"], ids=[*range(len(texts)), None, None]))
    rows = infill.digest(docs).collect()
    for r in rows:
        text = (texts[r.doc_id] if r.doc_id is not None else "x" if r.n else "") or ""
        h = hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
        n = len(text)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        form = "plain" if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        output = {"plain": text, "psm": f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", "spm": f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"}[form]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r.n, r.form, r.output_sha256, r.restored_sha256) == (n, form, sha(output), sha(text))
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if form == "plain" else (a, b - a))
    assert {r.form for r in rows} == {"plain", "psm", "spm"} and len(rows) == len(texts) + 2
    out = infill.filled(docs)
    assert out.columns == docs.columns
    assert sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in out.collect()) == sorted(r.output_sha256 for r in rows)
    assert infill.transform(docs.limit(0)).count() == 0 and infill.digest(docs.limit(0)).count() == 0
