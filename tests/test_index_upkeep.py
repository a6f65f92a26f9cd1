"""Pruned postings, segments and committed loads against rebuilds and brute force."""

from __future__ import annotations

import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from lexloom.operators import index as I, postings as P, retrieve as R
from lexloom.operators.segments import SegmentedIndex
from lexloom.session import stored, table
from lexloom.sources import commits, files
from tests.conftest import SMALL

QUERY = "query_id int, question string"


def corpus(spark, n=400, seed=1):
    """Zipf-like words: w0 is in most documents, high numbers are rare."""
    draw = random.Random(seed)
    word = lambda: f"w{int(draw.paretovariate(0.6)) - 1}"
    rows = [(i, " ".join(word() for _ in range(draw.choice([3, 20, 60])))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def asked(spark, seed=2, n=25):
    draw = random.Random(seed)
    words = lambda: " ".join(f"w{int(draw.paretovariate(0.5)) - 1}" for _ in range(draw.choice([1, 3, 8])))
    rows = [(i, words()) for i in range(n)] + [(n, ""), (n + 1, "zzz"), (n + 2, None), (n + 3, "w0"), (n + 4, "w0 w1 w2")]
    return spark.createDataFrame(rows, QUERY)


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())


def every_posting(queries, index, k):
    """All scores, and all documents at 0 beside them."""
    from pyspark.sql import functions as F

    told = queries.select("query_id", F.explode(I.tokens(F.col("question"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    held, weighed = index.blocks(told, index.stats.first()["avgdl"])
    found = P.all_scores(weighed, held, index.stats.first()["avgdl"])
    plain = queries.select("query_id").crossJoin(index.ids().distinct()).join(found, ["query_id", "doc_id"], "left")
    return R.top(plain.select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score")), [F.col("score").desc(), F.col("doc_id").asc()], k, ["query_id"])


@pytest.mark.parametrize(("block", "k"), [(8, 5), (64, 3)])
def test_pruned_search_equals_all_postings(spark, monkeypatch, block, k):
    monkeypatch.setattr(P.blocks, "__defaults__", (block,))
    index, queries = I.bm25_index(corpus(spark)), asked(spark)
    assert rows(R.bm25_topk(queries, index, k)) == rows(every_posting(queries, index, k))


def test_blocks_are_left_unread(spark):
    from pyspark.sql import functions as F

    index, queries = I.bm25_index(corpus(spark, 2000)), asked(spark)
    avgdl = index.stats.first()["avgdl"]
    told = stored(queries.select("query_id", F.explode(I.tokens(F.col("question"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times")))
    held, weighed = index.blocks(told, avgdl)
    search = P.Search(weighed, held, avgdl, 3)
    search.scores().count()
    read = search.read().first()
    assert 0 < read.postings_read < 0.9 * read.postings and read.blocks_read < read.blocks


def test_negative_weights_have_no_cross_join(spark):
    docs = spark.createDataFrame([(i, "a b" if i < 8 else "a") for i in range(10)] + [(i, "a") for i in range(100, 130)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "b"), (2, "a b"), (3, "zzz"), (4, "a")], QUERY)
    index = I.bm25_index(docs)
    for negative in (False, True):
        got = R.bm25_topk(queries, index, 4, negative=negative)
        assert rows(got) == rows(every_posting(queries, index, 4))
    assert [(r.doc_id, r.nth) for r in P.numbered(docs.select("doc_id")).orderBy("nth").collect()] == list(zip([*range(10), *range(100, 130)], range(40), strict=True))


def bucket_filtered(spark, df) -> bool:
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    return bool(re.search(r"PartitionFilters: \[[^]]*bucket#", plan))


def test_segments_equal_a_rebuild(spark, tmp_path):
    docs, queries = corpus(spark, 300).filter("doc_id <> 7"), asked(spark)
    index = SegmentedIndex(spark, f"file://{tmp_path}/bm25", buckets=4)
    for k in range(3):
        assert index.add(docs.filter(f"doc_id % 3 = {k}"), block=8, batch=f"b{k}")
    assert not index.add(docs.limit(5), batch="b1")
    same = lambda living: rows(R.bm25_topk(queries, index, 4)) == rows(R.bm25_topk(queries, I.bm25_index(living), 4))
    assert index.delete(docs.filter("doc_id % 5 = 0")) == 60 and index.delete(docs.filter("doc_id % 10 = 0")) == 0
    index.add(docs.filter("doc_id = 10").selectExpr("doc_id", "'w3 w4 changed' as text"))
    living = docs.filter("doc_id % 5 <> 0").unionByName(spark.createDataFrame([(10, "w3 w4 changed")], docs.schema))
    assert same(living)
    other = SegmentedIndex(spark, index.path, buckets=4)
    assert len(other.segments) == 4
    index.compact()
    assert len(index.segments) == 1 and not index.deletes
    assert other.delete(docs.filter("doc_id = 11")) == 1  # out of date at first, then done on what is there
    index.refresh()
    assert same(living.filter("doc_id <> 11"))


def test_a_query_reads_its_buckets(spark, tmp_path):
    index = SegmentedIndex(spark, f"file://{tmp_path}/bm25", buckets=16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else the few rows share a file
    try:
        index.add(spark.createDataFrame([(i, f"common w{i % 50}") for i in range(3000)], "doc_id long, text string"), block=16)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    wanted = index.buckets_of(spark.createDataFrame([("common",)], "token string"))
    assert len(wanted) == 1 and bucket_filtered(spark, index.read_blocks(wanted))
    held = index.read_blocks(wanted).filter("token = 'common'").selectExpr("_metadata.file_path as f", "n")
    assert held.select("f").distinct().count() > 1 and held.agg({"n": "max"}).first()[0] < 100


# --- Committed loads

LINE = '{"page_content": "t%d", "metadata": {"chunk_id": "c%d", "keywords": ["a"], "n": {"x": 1}}}'


def gold(spark, ids):
    lines = spark.createDataFrame([(LINE % (i, i), "/g/f.jsonl", i) for i in ids], "value string, file string, position int")
    return I.gold_records(lines)


def test_whole_loads_once(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    first = gold(spark, range(20))
    assert commits.load(first.unionAll(first), path, "b0") == 20
    assert commits.load(gold(spark, range(99)), path, "b0") == 0  # the same batch again
    assert commits.load(gold(spark, range(10, 30)), path, "b1") == 10
    assert commits.load(gold(spark, range(5)), path, "b2") == 0
    table_now = commits.collection(spark, path, first.schema)
    assert table_now.schema.names == first.schema.names
    assert sorted(r.chunk_id for r in table_now.collect()) == sorted(f"c{i}" for i in range(30))
    assert commits.collection(spark, f"{path}-none", first.schema).count() == 0


def test_killed_load_leaves_nothing(spark, tmp_path, monkeypatch):
    """Files are there, the record is not: readers see nothing of it, and the load can be repeated."""
    path = f"file://{tmp_path}/index"
    commits.load(gold(spark, range(3)), path, "b0")
    with monkeypatch.context() as m:
        m.setattr(commits.CommitLog, "append", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            commits.load(gold(spark, range(6)), path, "b1")
    assert len(list((tmp_path / "index/data").iterdir())) == 2
    schema = gold(spark, [0]).schema
    assert commits.collection(spark, path, schema).count() == 3
    files.write_text(spark, f"{path}/log/000000000001.json", '{"batch": "b1", "lo')  # a record half written
    assert commits.collection(spark, path, schema).count() == 3
    files.remove(spark, f"{path}/log/000000000001.json")
    assert commits.load(gold(spark, range(6)), path, "b1") == 3
    assert commits.collection(spark, path, schema).count() == 6


def test_two_loads_at_once(spark, tmp_path):
    path, found = f"file://{tmp_path}/index", []
    threads = [threading.Thread(target=lambda k=k: found.append(commits.load(gold(spark, range(k * 5, k * 5 + 10)), path, f"b{k}"))) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    ids = [r.chunk_id for r in commits.collection(spark, path, gold(spark, [0]).schema).collect()]
    assert sorted(ids) == sorted(f"c{i}" for i in range(20)) and sum(found) == 20


def test_a_load_reads_its_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    commits.load(gold(spark, range(200)), path, "b0")
    schema = gold(spark, [0]).schema
    loads = [r["load"] for r in commits.CommitLog(spark, f"{path}/log").records()]
    assert bucket_filtered(spark, commits.read_loads(spark, path, schema, loads, [3]))


def test_every_50th_of_the_table(spark):
    from lexloom.plans import catalog

    docs = table(spark, SMALL, "documents")
    index = I.bm25_index(docs)
    from lexloom.plans.retrieval_queries import document_queries

    queries = document_queries(spark, SMALL).select("query_id", "question")
    assert rows(catalog.QUERIES["bm25_topk_every50"](spark, SMALL)) == rows(every_posting(queries, index, 10))


def test_many_queries_meet_documents_in_chunks(spark, monkeypatch):
    """As by blocks and bounds, with copies, ties, repeated ids, null ids and texts, over several chunks."""
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.9)) % 90}" for _ in range(4000)]
    rows = [(i // 2 if i < 20 else i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(1400)]
    rows += [(2000 + i, "w1 w2 w3 w70") for i in range(40)] + [(None, "w1 w2"), (5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(q, " ".join(rng.choices(words, k=4))) for q in range(70)] + [(70, "unknown"), (71, ""), (72, "w1 w2 w3 w70")], "query_id long, question string")
    told = lambda: [tuple(r) for r in R.bm25_topk(asked, I.bm25_index(docs), 5).select("query_id", "rank", "doc_id", F.round("score", 7)).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(R, "FEW_QUERIES", 1000)
    by_bounds = told()
    monkeypatch.setattr(R, "FEW_QUERIES", 64)
    monkeypatch.delattr(R, "Search")
    assert told() == by_bounds and len(by_bounds) == 73 * 5


def test_many_queries_read_texts_without_a_row_an_occurrence(spark, monkeypatch):
    """As over counted postings, with repeated ids of one length and of two, null ids and texts, and rare white space."""
    from dataclasses import replace

    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.9)) % 90}" for _ in range(2000)]
    made = [(i // 2 if i < 40 else i, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(1200)]
    made += [(3000, "w1 w2 w2"), (3000, "w2 w1 w3"), (None, "w1 w2"), (3001, None), (3002, "w1\x1cw2 w3\x85w4  w5\x1f")]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    queries = spark.createDataFrame([(q, " ".join(rng.choices(words, k=4))) for q in range(80)] + [(80, "w1\x1cw2 w4"), (81, "unknown"), (82, "")], "query_id long, question string")
    index = I.bm25_index(docs)
    by_postings = rows(R.bm25_topk(queries, replace(index, given=None), 5))
    nothing = index.occurrences.filter("1 / 0 = 1")
    assert rows(R.bm25_topk(queries, replace(index, occurrences=nothing, postings=nothing), 5)) == by_postings and len(by_postings) == 83 * 5


def test_words_are_tokens(spark):
    texts = [f"a{chr(c)}b {chr(c)}" for c in (*range(1, 0x100), *range(0x1680, 0x1810), *range(0x2000, 0x2070), 0x3000, 0xFEFF)] + ["", None, "\x1c \x1d"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", I.tokens(F.col("t")).alias("w")).collect()
    assert all(I.words(r.t) == r.w for r in found)


def test_large_sets_of_vector_queries_meet_chunks_in_groups(spark, monkeypatch):
    """Blocks of queries by matrix products, not pair by pair; ties by id, queries and rows without a vector."""
    rng = random.Random(4)
    made = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(300)] + [(300, None)]
    vectors = spark.createDataFrame(made, "doc_id int, embedding array<float>")
    queries = vectors.filter("doc_id % 3 = 0").withColumnRenamed("doc_id", "query_id")
    by_all = rows(R.knn_topk(queries, vectors, 5))
    monkeypatch.delattr(R, "squared_l2")
    assert rows(R.knn_topk(queries, vectors, 5, most_queries=17)) == by_all and len(by_all) == 500
