"""The vector index in cells against brute force."""

from __future__ import annotations

from lexloom.operators import cells, retrieve as R
from lexloom.plans.retrieval_queries import vector_queries, vectors
from lexloom.session import table


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_recall_and_exact_mode(spark, tmp_path):
    sf = "/root/testdata/sf0.1"
    own, asked = vectors(spark, sf), vector_queries(spark, sf)
    index = cells.CellIndex.build(own, f"file://{tmp_path}/cells")
    assert index.rows.count() == own.count()
    want = R.knn_topk(asked, own, 10)
    assert rows(index.exact(asked, 10)) == rows(want)
    found = cells.recall(index.search(asked, 10), want)  # 12 of 16 cells; these vectors have hardly any clusters
    print('recall', found)
    assert found >= 0.9
    again = cells.CellIndex.read(spark, f"file://{tmp_path}/cells", own)
    assert cells.recall(again.search(asked, 10, probes=16), want) == 1.0


def test_bounds_leave_far_cells_out(spark, tmp_path):
    """Where rows lie in clusters, the exact mode visits few cells; ties, nulls and repeated rows have defined results."""
    data = [(i, [float(i % 8) * 100 + (i % 3) * 0.5, float(i // 8 % 2)]) for i in range(400)] + [(999, None), (998, [1.0]), (997, [0.0, None]), (5, [0.0, 0.0]), (5, [0.0, 0.0])]
    own = spark.createDataFrame(data, "doc_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [0.0, 0.0]), (2, [350.0, 0.5]), (3, None)], "query_id int, embedding array<float>")
    index = cells.CellIndex.build(own, f"file://{tmp_path}/cells", cells=8)
    got = index.exact(asked, 5)
    whole = own.filter("size(embedding) = 2 and not exists(embedding, x -> x is null)")
    assert rows(got) == rows(R.knn_topk(asked, whole, 5))
    assert index.visited.count() < 10
    plan = index.rows.filter("cell = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    empty = cells.CellIndex.build(own.limit(0), f"file://{tmp_path}/none")
    assert empty.search(asked, 3).count() == 0 and empty.exact(asked, 3).count() == 0
