"""Queries of the index, retrieval, answer, enrichment, evaluation, source and streaming operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexloom.functions import fixed
from lexloom.operators import answer as A, cells, enrich as E, evaluate as V, index as I, ledger, retrieve as R, sections as S
from lexloom.operators.segments import SegmentedIndex
from lexloom.plans.adapter import documents
from lexloom.plans.document_queries import SECTION_SQL
from lexloom.plans.text_queries import strip
from lexloom.session import shared_folder, spread, stored, table
from lexloom.sources import commits, files
from lexloom.streaming import chat, ingest

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


#: Questions of the retrieval queries; the vector of a question is that of the row named with it.
QUESTIONS = ((1, "the and thanedble of", 0), (2, "der die und Nicht aulich", 7), (3, "que la de eauouon les des", 11), (4, "tionsh xyzzy", 23))
K = 10


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUESTIONS), "query_id int, question string, vec_id long")


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def with_vectors(spark, sf_dir) -> DataFrame:
    asked = questions(spark)
    stored = table(spark, sf_dir, "embeddings").filter(F.col("vec_id").isin([v for _, _, v in QUESTIONS]))
    return asked.join(stored.select("vec_id", "embedding"), "vec_id").select("query_id", "question", "embedding")


def bm25(spark, sf_dir) -> I.Bm25Index:
    return I.bm25_index(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


_ASKED = "(VALUES " + ", ".join(f"({q}, '{t}', {v})" for q, t, v in QUESTIONS) + ") AS v(query_id, question, vec_id)"
_TOKENS = r"list_filter(string_split_regex({}, '\s+'), lambda x: x <> '')"
_BM25 = f"""t AS (SELECT doc_id, {_TOKENS.format('text')} AS ts FROM documents),
    x AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS token FROM t),
    tf AS (SELECT token, doc_id, dl, count(*) AS tf FROM x GROUP BY ALL),
    st AS (SELECT count(*) AS n, round(avg(len(ts)), 9) AS avgdl FROM t),
    df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
    rw AS (SELECT token, df, round(ln(n - df + 0.5) - ln(df + 0.5), 9) AS raw FROM df, st),
    mn AS (SELECT round(avg(raw), 9) AS mean FROM rw),
    tm AS (SELECT token, df, CASE WHEN raw < 0 THEN round(0.25 * mean, 9) ELSE raw END AS idf FROM rw, mn)"""
_SCORES = f"""{_BM25}, qt AS (SELECT query_id, unnest({_TOKENS.format('question')}) AS token FROM {_ASKED}),
    qw AS (SELECT query_id, token, count(*) AS times FROM qt GROUP BY ALL),
    sc AS (SELECT query_id, doc_id, round(sum(times * idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
        FROM qw JOIN tm USING (token) JOIN tf USING (token), st GROUP BY ALL),
    al AS (SELECT q.query_id, t.doc_id, coalesce(score, 0.0) AS score FROM {_ASKED.replace(' AS v(', ' AS q(')} CROSS JOIN t LEFT JOIN sc ON sc.query_id = q.query_id AND sc.doc_id = t.doc_id),
    bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM al) WHERE rank <= {K})"""
_KNN = f"""nn AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS rank FROM
        (SELECT query_id, e.vec_id AS doc_id, round(list_sum(list_transform(list_zip(e.embedding, o.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), 9) AS score
        FROM {_ASKED} JOIN embeddings o ON o.vec_id = v.vec_id CROSS JOIN embeddings e)) WHERE rank <= {K})"""
_FUSED = """fu AS (SELECT query_id, doc_id, round(sum(part), 12) AS score, min(seen) AS seen FROM
        (SELECT query_id, doc_id, 0.3 / (rank + 160) AS part, rank AS seen FROM bm UNION ALL SELECT query_id, doc_id, 0.7 / (rank + 160), 1000 + rank FROM nn) GROUP BY ALL),
    rk AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, doc_id) AS rank FROM fu)"""


@query(
    "bm25_stats",
    f"""WITH t AS (SELECT {_TOKENS.format('text')} AS ts FROM documents), st AS (SELECT count(*) AS n FROM t),
    df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(ts)) AS token FROM t) GROUP BY token),
    rw AS (SELECT token, df, round(ln(n - df + 0.5) - ln(df + 0.5), 9) AS raw FROM df, st), mn AS (SELECT round(avg(raw), 9) AS mean FROM rw)
    SELECT token, df, round(CASE WHEN raw < 0 THEN round(0.25 * mean, 9) ELSE raw END, 6) AS idf FROM rw, mn""",
)
def bm25_stats(spark, sf_dir):
    return bm25(spark, sf_dir).terms.select("token", "df", F.round("idf", 6).alias("idf"))


@query("bm25_corpus", f"WITH {_BM25} SELECT n, round(avgdl, 6) AS avgdl FROM st")
def bm25_corpus(spark, sf_dir):
    return bm25(spark, sf_dir).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


@query("bm25_topk", f"WITH {_SCORES} SELECT query_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM bm")
def bm25_topk(spark, sf_dir):
    return R.bm25_topk(questions(spark), bm25(spark, sf_dir), K).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("knn_topk", f"WITH {_KNN} SELECT query_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM nn")
def knn_topk(spark, sf_dir):
    return R.knn_topk(with_vectors(spark, sf_dir), vectors(spark, sf_dir), K).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("rrf_fusion", f"WITH {_KNN}, bm AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC) AS rank FROM (SELECT query_id, doc_id FROM nn WHERE rank <= 5)), {_FUSED} SELECT query_id, doc_id, round(score, 9) AS score, rank::INTEGER AS rank FROM rk")
def rrf_fusion(spark, sf_dir):
    near = R.knn_topk(with_vectors(spark, sf_dir), vectors(spark, sf_dir), K)
    other = R.top(near.filter("rank <= 5").select("query_id", "doc_id"), [F.col("doc_id").desc()], K, ["query_id"])
    return R.fuse([("other", other, fixed.BM25_WEIGHT), ("vector", near, fixed.VECTOR_WEIGHT)]).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


_HYBRID = f"WITH {_SCORES}, {_KNN}, {_FUSED}"


@query("hybrid_search", f"{_HYBRID} SELECT query_id, doc_id, round(score, 9) AS score, rank::INTEGER AS rank FROM rk")
def hybrid_search(spark, sf_dir):
    found = R.hybrid(with_vectors(spark, sf_dir), bm25(spark, sf_dir), vectors(spark, sf_dir), K)
    return found.select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


# --- The same searches for every row whose id is divisible by 50, so that the query set grows with the tables.

EVERY, WORDS = 50, 8


def vector_queries(spark, sf_dir) -> DataFrame:
    """Every 50th vector as a query."""
    return vectors(spark, sf_dir).filter(F.col("doc_id") % EVERY == 0).withColumnRenamed("doc_id", "query_id")


def document_queries(spark, sf_dir) -> DataFrame:
    """The first words of every 50th document as a question; its vector is that of the row with its id, if there is one."""
    docs = table(spark, sf_dir, "documents").filter(F.col("doc_id") % EVERY == 0)
    asked = docs.select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(I.tokens(F.col("text")), 1, WORDS), " ").alias("question"))
    return asked.join(vector_queries(spark, sf_dir), "query_id", "left")


_ASKED_VECTORS = f"(SELECT vec_id, '', vec_id FROM embeddings WHERE vec_id % {EVERY} = 0) AS v(query_id, question, vec_id)"
_ASKED_DOCUMENTS = f"(SELECT doc_id, array_to_string({_TOKENS.format('text')}[1:{WORDS}], ' '), doc_id FROM documents WHERE doc_id % {EVERY} = 0) AS v(query_id, question, vec_id)"


def _asking(sql: str, asked: str) -> str:
    """The SQL of a search with another query set."""
    return sql.replace(_ASKED, asked).replace(_ASKED.replace(" AS v(", " AS q("), asked.replace(" AS v(", " AS q("))


@query("knn_topk_every50", _asking(ORACLES["knn_topk"], _ASKED_VECTORS))
def knn_topk_every50(spark, sf_dir):
    return R.knn_topk(vector_queries(spark, sf_dir), spread(vectors(spark, sf_dir)), K).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("knn_cells_every50", _asking(ORACLES["knn_topk"], _ASKED_VECTORS))
def knn_cells_every50(spark, sf_dir):
    """The exact mode of an index in cells."""
    index = cells.CellIndex.build(spread(vectors(spark, sf_dir)), f"{shared_folder(spark)}/cells")
    return index.exact(vector_queries(spark, sf_dir), K).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("bm25_topk_every50", _asking(ORACLES["bm25_topk"], _ASKED_DOCUMENTS))
def bm25_topk_every50(spark, sf_dir):
    return R.bm25_topk(document_queries(spark, sf_dir), bm25(spark, sf_dir), K).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("rrf_fusion_every50", _asking(ORACLES["rrf_fusion"], _ASKED_VECTORS))
def rrf_fusion_every50(spark, sf_dir):
    near = R.knn_topk(vector_queries(spark, sf_dir), spread(vectors(spark, sf_dir)), K)
    other = R.top(near.filter("rank <= 5").select("query_id", "doc_id"), [F.col("doc_id").desc()], K, ["query_id"])
    return R.fuse([("other", other, fixed.BM25_WEIGHT), ("vector", near, fixed.VECTOR_WEIGHT)]).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@query("hybrid_search_every50", _asking(ORACLES["hybrid_search"], _ASKED_DOCUMENTS))
def hybrid_search_every50(spark, sf_dir):
    found = R.hybrid(document_queries(spark, sf_dir), bm25(spark, sf_dir), spread(vectors(spark, sf_dir)), K)
    return found.select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@query("bm25_segments_every50", _asking(ORACLES["bm25_topk"], _ASKED_DOCUMENTS).replace("AS ts FROM documents)", "AS ts FROM documents WHERE doc_id % 7 <> 3)", 1))
def bm25_segments_every50(spark, sf_dir):
    """All documents in three segments of a stored index, less those that are deleted from it, answer as a rebuild."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = SegmentedIndex(spark, f"{shared_folder(spark)}/bm25")
    for part in range(3):
        index.add(spread(docs.filter(F.pmod("doc_id", F.lit(3)) == part)))
    index.delete(docs.filter("doc_id % 7 = 3"))
    return R.bm25_topk(document_queries(spark, sf_dir), index, K).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _ranked(spark, sf_dir) -> DataFrame:
    """The first five of the BM25 lists with the columns that context and sources read."""
    best = R.bm25_topk(questions(spark), bm25(spark, sf_dir), 5).select("query_id", "doc_id", "rank")
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    told = docs.select(
        "doc_id", F.concat("source", F.lit("_caso.txt")).alias("source"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"),
        F.when(F.col("quality") == 1, F.col("lang")).alias("section_name"), F.when(F.col("toxic") == 0, F.lit("limpio")).alias("summary"), F.col("text").alias("page_content"),
    )
    return best.join(told, "doc_id")


_RANKED = f"""{_SCORES.replace('<= ' + str(K), '<= 5')}, r AS (SELECT bm.query_id, bm.doc_id, bm.rank, d.source || '_caso.txt' AS source, 'c' || d.doc_id AS chunk_id,
    CASE WHEN l.quality = 1 THEN d.lang END AS section_name, CASE WHEN l.toxic = 0 THEN 'limpio' END AS summary, d.text AS page_content
    FROM bm JOIN documents d ON bm.doc_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


@query(
    "context_block",
    f"""WITH {_RANKED} SELECT query_id, string_agg(concat_ws(chr(10), '[doc' || rank || ' | source=' || source || ' | chunk_id=' || chunk_id || ']', 'Sección: ' || section_name, 'Resumen: ' || summary, page_content),
    chr(10) || chr(10) ORDER BY rank) AS context FROM r GROUP BY query_id""",
)
def context_block(spark, sf_dir):
    return A.context(_ranked(spark, sf_dir))


@query(
    "answer_sources",
    f"""WITH {_RANKED} SELECT query_id, rank::INTEGER AS rank, CASE WHEN length(t) > 500 THEN left(t, 500) || '...' ELSE t END AS content, source, replace(replace(source, '.txt', ''), '_', ' ') AS title
    FROM (SELECT *, replace({strip('page_content')}, chr(10), ' ') AS t FROM r)""",
)
def answer_sources(spark, sf_dir):
    return A.sources(_ranked(spark, sf_dir)).select("query_id", "rank", "content", "source", "title")


_REPLY = "CASE doc_id % 4 WHEN 0 THEN 'Puntaje: ' || (doc_id % 13) || '.5 de 10' WHEN 1 THEN 'ninguno' WHEN 2 THEN '' || (doc_id % 9) ELSE '10 o 3' END"


@query(
    "rerank_parse",
    f"""WITH {_SCORES}, s AS (SELECT query_id, doc_id, rank, least(10.0, greatest(0.0, coalesce(try_cast(nullif(regexp_extract({_REPLY}, '(\\d+(\\.\\d+)?)', 1), '') AS DOUBLE), 0.0))) AS score FROM bm)
    SELECT query_id, doc_id, score::DOUBLE AS score, rank::INTEGER AS rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM s) WHERE rank <= 3""",
)
def rerank_parse(spark, sf_dir):
    best = R.bm25_topk(questions(spark), bm25(spark, sf_dir), K).select("query_id", "doc_id", "rank")
    replied = best.withColumn("reply", F.expr(_REPLY.replace("doc_id", "cast(doc_id as int)")))
    return R.rerank(replied, 3).select("query_id", "doc_id", "score", "rank")


_CITED = "left(text, 40) || ' [doc' || (turn % 4 + 1) || '] y [doc' || (conv_id % 9 + 1) || '] otra vez [doc' || (turn % 4 + 1) || ']'"


@query(
    "citation_link",
    f"""WITH {_RANKED}, a AS (SELECT query_id, unnest(regexp_extract_all(answer, '\\[doc(\\d+)\\]', 1)) AS n FROM (SELECT v.query_id, {_CITED} AS answer FROM {_ASKED} JOIN conversations c ON c.conv_id = v.query_id AND c.turn = 0)),
    d AS (SELECT DISTINCT query_id, n::INTEGER AS n FROM a)
    SELECT d.query_id, d.n, r.doc_id, r.doc_id IS NULL AS missing FROM d LEFT JOIN r ON r.query_id = d.query_id AND r.rank = d.n""",
)
def citation_link(spark, sf_dir):
    first = table(spark, sf_dir, "conversations").filter("turn = 0").select(F.col("conv_id").cast("int").alias("query_id"), "turn", "conv_id", "text")
    answers = questions(spark).join(first, "query_id").select("query_id", F.expr(_CITED).alias("answer"))
    return A.link_citations(answers, _ranked(spark, sf_dir)).select("query_id", "n", "doc_id", "missing")


_CITED_WHOLE = _CITED.replace("left(text, 40)", "text")


@query(
    "citation_link_whole",
    f"""WITH {_RANKED}, a AS (SELECT conv_id, string_agg({_CITED_WHOLE}, chr(10) ORDER BY turn) AS answer FROM conversations GROUP BY conv_id),
    d AS (SELECT DISTINCT conv_id AS query_id, conv_id % {len(QUESTIONS)} + 1 AS question, n::INTEGER AS n FROM (SELECT conv_id, unnest(regexp_extract_all(answer, '\\[doc(\\d+)\\]', 1)) AS n FROM a))
    SELECT d.query_id, d.n, r.doc_id, r.doc_id IS NULL AS missing FROM d LEFT JOIN r ON r.query_id = d.question AND r.rank = d.n""",
)
def citation_link_whole(spark, sf_dir):
    """Whole texts of all conversations, each asked the question that its id gives.

    A turn is searched by itself and its conversation's citations are then taken once, so that no conversation's text
    is gathered in one row.
    """
    rows = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    cited = A.citations(rows.select("conv_id", F.expr(_CITED_WHOLE).alias("answer")), key="conv_id").select("conv_id", "n").distinct()
    best = F.broadcast(_ranked(spark, sf_dir).select("query_id", F.col("rank").alias("n"), "doc_id"))  # five rows a question
    told = cited.withColumn("query_id", F.col("conv_id") % len(QUESTIONS) + 1).join(best, ["query_id", "n"], "left")
    return told.select(F.col("conv_id").alias("query_id"), "n", "doc_id", F.col("doc_id").isNull().alias("missing"))


@query("answer_pipeline")
def answer_pipeline(spark, sf_dir):
    lexical, stored = bm25(spark, sf_dir), vectors(spark, sf_dir)
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.col("source"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("page_content"))
    return A.generate_answers(with_vectors(spark, sf_dir), lambda asked, k: R.hybrid(asked, lexical, stored, k), chunks, k_candidates=5)


@query("answer_pipeline_every50")
def answer_pipeline_every50(spark, sf_dir):
    lexical, stored = bm25(spark, sf_dir), vectors(spark, sf_dir)
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.col("source"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("page_content"))
    return A.generate_answers(document_queries(spark, sf_dir), lambda asked, k: R.hybrid(asked, lexical, stored, k), chunks, k_candidates=5)


@query(
    "request_validation",
    """SELECT conv_id AS query_id, CASE WHEN turn % 3 = 0 THEN 4 ELSE turn::INTEGER * 3 END AS k, (turn * 4)::INTEGER AS k_candidates,
    CASE WHEN length(q) < 1 THEN 'question is empty' WHEN (CASE WHEN turn % 3 = 0 THEN 4 ELSE turn * 3 END) NOT BETWEEN 1 AND 8 THEN 'k is not in 1..8' WHEN turn * 4 NOT BETWEEN 4 AND 20 THEN 'k_candidates is not in 4..20' END AS error
    FROM (SELECT *, CASE WHEN turn = 5 THEN '' ELSE text END AS q FROM conversations)""",
)
def request_validation(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    asked = rows.select(
        F.col("conv_id").alias("query_id"), F.when(F.col("turn") == 5, "").otherwise(F.col("text")).alias("question"),
        F.when(F.col("turn") % 3 != 0, F.col("turn") * 3).cast("int").alias("k"), (F.col("turn") * 4).cast("int").alias("k_candidates"),
    )
    return A.valid_requests(asked).select("query_id", "k", "k_candidates", "error")


# --- Replies of models: their shapes are made from turns.

_FENCE = "'```json' || {nl} || '{{\"expanded_query\": \"consulta ' || turn || '\"}}' || {nl} || '```'"
_REPLIES = "CASE turn % 4 WHEN 0 THEN " + _FENCE + " WHEN 1 THEN 'Claro: {{\"expanded_query\": \"  \"}}' WHEN 2 THEN 'sin json' ELSE '{{\"expanded_query\": \"q' || conv_id || '\", \"verdict\": 0.' || (conv_id % 10) || '}}' END"


@query(
    "json_repair",
    """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'consulta ' || turn WHEN 3 THEN 'q' || conv_id ELSE 'pregunta' END AS expanded_query,
    turn % 4 <> 2 AS ok, CASE WHEN turn % 4 = 3 AND conv_id % 10 >= 5 THEN 1 ELSE 0 END AS verdict FROM conversations""",
)
def json_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("reply", F.expr(_REPLIES.format(nl="char(10)")))
    told = rows.withColumn("r", V.repaired(F.col("reply")))
    return told.select("conv_id", "turn", E.expanded_query(F.col("reply"), F.lit("pregunta")).alias("expanded_query"), "r.ok", "r.verdict")


_USAGE = """CASE turn % 4 WHEN 0 THEN '{"llm_output": {"token_usage": {"prompt_tokens": ' || n || ', "completion_tokens": 7}}}'
    WHEN 1 THEN '{"llm_output": {"usage_metadata": {"prompt_token_count": ' || n || ', "candidates_token_count": 3}}}'
    WHEN 2 THEN '{"message": {"usage_metadata": {"input_tokens": ' || n || ', "output_tokens": 2}}}' ELSE '{}' END"""


@query(
    "token_usage_summary",
    """SELECT role AS model, turn % 4 AS use_case, count(*) AS calls, CASE WHEN turn % 4 = 3 THEN '?' ELSE sum(length(text))::BIGINT::VARCHAR END AS tokens_in,
    CASE turn % 4 WHEN 0 THEN (7 * count(*))::VARCHAR WHEN 1 THEN (3 * count(*))::VARCHAR WHEN 2 THEN (2 * count(*))::VARCHAR ELSE '?' END AS tokens_out FROM conversations GROUP BY role, turn % 4""",
)
def token_usage_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("n", F.length("text"))
    made = rows.select(F.col("role").alias("model"), (F.col("turn") % 4).alias("use_case"), F.expr(_USAGE).alias("response"))
    return V.usage_summary(made)


@query(
    "eval_metric_mean",
    "SELECT m AS metric, round(avg(v), 6) AS mean, count(*) AS n FROM (SELECT 'quality' AS m, CASE WHEN doc_id % 5 <> 0 THEN quality::DOUBLE END AS v FROM labels UNION ALL SELECT 'toxic', toxic::DOUBLE FROM labels) WHERE v IS NOT NULL GROUP BY m",
)
def eval_metric_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    value = F.when(F.col("doc_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("quality").cast("double"))
    scores = rows.select(F.lit("quality").alias("metric"), value.alias("value")).unionByName(rows.select(F.lit("toxic").alias("metric"), F.col("toxic").cast("double").alias("value")))
    return V.metric_means(scores)


_VERDICTS = "SELECT doc_id // 8 AS query_id, doc_id % 8 AS rank, coalesce(quality, 0)::DOUBLE AS v, coalesce(toxic, 0) AS t FROM labels"


@query(
    "eval_metrics",
    f"""WITH l AS ({_VERDICTS}), p AS (SELECT *, avg(v) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS p FROM l),
    s AS (SELECT query_id, rank % 4 AS statement_id, max(v) AS s, max(t) AS t FROM l GROUP BY ALL),
    d AS (SELECT g.vec_id // 8 AS query_id, list_dot_product(q.embedding::DOUBLE[], g.embedding::DOUBLE[]) AS ab, sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(g.embedding::DOUBLE[], g.embedding::DOUBLE[])) AS n, g.vec_id
      FROM embeddings g JOIN embeddings q ON q.vec_id = g.vec_id // 8 * 8),
    m AS (SELECT query_id, 'context_precision' AS metric, CASE WHEN sum(v) > 0 THEN sum(p * v) / sum(v) ELSE 0 END AS value FROM p GROUP BY query_id
      UNION ALL SELECT query_id, 'faithfulness', avg(s) FROM s GROUP BY query_id UNION ALL SELECT query_id, 'context_recall', avg(t) FROM s GROUP BY query_id
      UNION ALL SELECT query_id, 'answer_relevancy', avg(CASE WHEN vec_id % 5 <> 0 AND n > 0 THEN ab / n ELSE 0 END) FROM d GROUP BY query_id)
    SELECT metric, round(avg(value), 6) AS mean, count(*) AS n FROM m GROUP BY metric""",
)
def eval_metrics(spark, sf_dir):
    """The four metrics, from judges' verdicts that the labels stand for and questions that the vectors stand for."""
    eight = F.floor(F.col("doc_id") / 8).alias("query_id")
    labels = table(spark, sf_dir, "labels").select(eight, (F.col("doc_id") % 8).alias("rank"), "quality", "toxic")
    stated = lambda c: labels.select("query_id", (F.col("rank") % 4).alias("statement_id"), F.col("rank").alias("context_id"), F.col(c).alias("supported"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 8).alias("query_id"), "embedding")
    asked = vectors.filter("vec_id % 8 = 0").select("query_id", F.col("embedding").alias("question"))
    made = vectors.select("query_id", F.col("embedding").alias("generated"), (F.col("vec_id") % 5 == 0).alias("noncommittal")).join(asked, "query_id")
    parts = [V.context_precision(labels.withColumnRenamed("quality", "verdict")), V.supported_share(stated("quality"), "faithfulness")]
    parts += [V.supported_share(stated("toxic"), "context_recall"), V.answer_relevancy(made)]
    return V.metric_means(reduce(DataFrame.unionByName, parts))


@query(
    "eval_dataset",
    f"""WITH {_RANKED} SELECT v.query_id, v.question, 'respuesta' AS answer, list(page_content ORDER BY rank) AS contexts, CASE WHEN v.query_id <> 2 THEN 'verdad ' || v.query_id END AS ground_truth
    FROM {_ASKED} JOIN r ON r.query_id = v.query_id WHERE rank <= 3 GROUP BY ALL""",
)
def eval_dataset(spark, sf_dir):
    answers = questions(spark).select("query_id", "question", F.lit("respuesta").alias("answer"))
    truths = questions(spark).filter("query_id <> 2").select("query_id", F.concat(F.lit("verdad "), F.col("query_id").cast("string")).alias("ground_truth"))
    return V.dataset(answers, _ranked(spark, sf_dir), truths)


@query(
    "chat_state",
    "SELECT conv_id, string_agg(turn || ':' || role || ':' || text, '|' ORDER BY turn) AS messages, count(*)::INTEGER AS n_messages FROM conversations WHERE text <> '' GROUP BY conv_id",
)
def chat_state(spark, sf_dir):
    rows = A.chat_state(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    shown = F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["turn"].cast("string"), m["role"], m["text"])), "|")
    return rows.select("conv_id", shown.alias("messages"), "n_messages")


@query(
    "enrich_chunks",
    r"""WITH p AS (SELECT doc_id, source, list_filter(string_split_regex(concat_ws(chr(10) || chr(10), 'source: ' || source, text), '\s+'), lambda x: x <> '') AS ts FROM documents)
    SELECT doc_id, source, array_to_string(ts[1:12], ' ') AS summary, list_transform(list_sort(list_transform(list_distinct(ts), lambda w: {'n': -length(w), 'w': w}))[1:5], lambda x: x.w) AS keywords,
    NULL::VARCHAR AS entities, NULL::VARCHAR AS enrich_error FROM p""",
)
def enrich_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("page_content"))
    return E.enrich_chunks(docs).drop("page_content")


@query("enrich_files", ORACLES["enrich_chunks"])
def enrich_files(spark, sf_dir):
    """The chunks of all documents, a file a document, in two runs: the second finds the first one's replies and files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("page_content"))
    folder = shared_folder(spark)
    ledger.enrich_files(docs.filter("length(page_content) % 2 = 0"), folder, file="doc_id", key="doc_id")
    ledger.enrich_files(docs, folder, file="doc_id", key="doc_id")
    done = ledger.enriched(spark, folder, docs.schema)
    return done.select("doc_id", "source", "summary", "keywords", "entities", F.lit(None).cast("string").alias("enrich_error"))


@query("embed_offline", "SELECT doc_id, 64 AS dimensions, CASE WHEN regexp_matches(text, '\\S') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents")
def embed_offline(spark, sf_dir):
    made = E.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return made.select("doc_id", F.size("embedding").alias("dimensions"), F.round(norm, 3).alias("norm"))


# --- Index loading and joins.


@query("incremental_anti_join", "SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0")
def incremental_anti_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return I.only_new(docs.unionAll(docs), docs.filter("doc_id % 3 = 0"), "doc_id")


@query("skip_existing", "SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id < 3)")
def skip_existing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return I.skip_existing(docs, docs.filter("doc_id < 3"))


@query(
    "metadata_left_join",
    "SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'csv' ELSE d.lang END AS lang, l.toxic::VARCHAR AS tema FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def metadata_left_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(F.lit("/x/caso_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source"))
    raw = table(spark, sf_dir, "labels").select(
        F.concat(F.lit(" caso_"), F.col("doc_id").cast("string"), F.lit(".pdf ")).alias("Archivo"), F.when(F.col("quality") == 1, "csv").otherwise(" ").alias("lang"),
        F.col("toxic").cast("string").alias("tema"), F.lit(1).alias("at"),
    )
    return files.with_metadata(docs, files.last_by_key(raw, "Archivo", "at")).select("doc_id", "lang", "tema")


@query(
    "ingest_progress",
    "SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE doc_id % 3 = 0) AS n_known, count(*) FILTER (WHERE doc_id % 3 <> 0) AS n_new FROM documents GROUP BY source",
)
def ingest_progress(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return I.progress(docs, docs.filter("doc_id % 3 = 0"), "doc_id")


@query(
    "load_counts",
    f"""SELECT count(*) AS documents, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE doc_id % 2 = 0)) AS matched,
    (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id % 2 = 0) AS metadata_rows, 4 * count(*) AS sections,
    (SELECT count(*) FROM ({SECTION_SQL}) WHERE page_content <> '') AS sections_with_content FROM documents""",
)
def load_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("caso_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source"))
    metadata = table(spark, sf_dir, "labels").filter("doc_id % 2 = 0").select(F.concat(F.lit("caso_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("Archivo"))
    return I.load_counts(docs, metadata, S.split_documents(documents(spark, sf_dir)))


@query(
    "prompt_build",
    f"""WITH {_RANKED}, c AS (SELECT query_id, string_agg(concat_ws(chr(10), '[doc' || rank || ' | source=' || source || ' | chunk_id=' || chunk_id || ']', 'Sección: ' || section_name, 'Resumen: ' || summary, page_content),
        chr(10) || chr(10) ORDER BY rank) AS context FROM r GROUP BY query_id)
    SELECT query_id, CASE WHEN query_id % 2 = 0 THEN '' ELSE '{A.SYSTEM}' || chr(10) || chr(10) END || 'Contexto:' || chr(10) || context || chr(10) || chr(10) || 'Pregunta: ' || question AS prompt FROM c JOIN {_ASKED} USING (query_id)""",
)
def prompt_build(spark, sf_dir):
    rows = A.context(_ranked(spark, sf_dir)).join(questions(spark), "query_id")
    with_system, folded = (A.prompt(F.col("question"), F.col("context"), s) for s in (True, False))
    return rows.select("query_id", F.when(F.col("query_id") % 2 == 0, with_system).otherwise(folded).alias("prompt"))


_GOLD = """'{"' || CASE turn % 3 WHEN 0 THEN 'page_content' WHEN 1 THEN 'text' ELSE 'content' END || '": "t' || conv_id || '_' || turn || '", "metadata": {"keywords": ["a", "b' || turn || '"]' ||
    CASE WHEN turn % 2 = 0 THEN ', "chunk_id": "k' || conv_id || '_' || turn || '"' ELSE '' END || '}}'"""


@query(
    "gold_records",
    """SELECT CASE WHEN turn % 2 = 0 THEN 'k' || conv_id || '_' || turn ELSE 'g' || conv_id || '.jsonl_line_' || turn END AS chunk_id, 'g' || conv_id || '.jsonl' AS source,
    't' || conv_id || '_' || turn AS page_content, 'a, b' || turn AS keywords_str, 'Palabras clave: a, b' || turn || chr(10) || chr(10) || 't' || conv_id || '_' || turn AS embed_text FROM conversations""",
)
def gold_records(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    lines = rows.select(F.expr(_GOLD).alias("value"), F.concat(F.lit("/gold/g"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("file"), F.col("turn").alias("position"))
    blank = lines.withColumn("value", F.lit("  "))
    return I.gold_records(lines.unionAll(blank)).select("chunk_id", "source", "page_content", "keywords_str", "embed_text")


@query("metadata_sanitize", """SELECT doc_id, lang, '["' || lang || '","' || source || '"]' AS tags, '{"q":' || quality || '}' AS facts FROM documents JOIN labels USING (doc_id)""")
def metadata_sanitize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return I.sanitize(docs.select("doc_id", "lang", F.array("lang", "source").alias("tags"), F.struct(F.col("quality").alias("q")).alias("facts")))


@query("collection_scan", "SELECT doc_id::VARCHAR AS id, n_chars FROM documents WHERE text <> ''")
def collection_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("page_content"), "n_chars")
    return I.collection(docs).select("id", "n_chars")


# --- Sources, sinks and streams, through the shared folder.


@query("jsonl_roundtrip", "SELECT lang AS source_stem, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang")
def jsonl_roundtrip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("page_content"), F.concat(F.lit("/d/"), "lang", F.lit(".md")).alias("source"), "doc_id")
    folder = shared_folder(spark)
    files.write_jsonl(docs, folder)
    return files.read_jsonl(spark, folder).groupBy("source_stem").agg(F.count("*").alias("n"), F.sum(F.length("page_content")).alias("chars"))


@query("load_by_source", "SELECT doc_id::VARCHAR AS doc_id FROM documents WHERE lang = 'fr'")
def load_by_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("page_content"), F.concat(F.lit("/d/"), "lang", F.lit(".md")).alias("source"), "doc_id")
    folder = shared_folder(spark)
    files.write_jsonl(docs, folder)
    return files.read_jsonl(spark, folder, "fr").select(F.col("metadata").getItem("doc_id").alias("doc_id"))


@query("list_keys", "SELECT DISTINCT lang AS folder FROM documents")
def list_keys(spark, sf_dir):
    folder = shared_folder(spark)
    table(spark, sf_dir, "documents").select(F.lit("x").alias("page_content"), F.concat("lang", F.lit(".md")).alias("source")).distinct().transform(lambda d: files.write_jsonl(d, folder) or d)
    return files.list_keys(spark, folder, ".json").select(F.regexp_extract("path", "source_stem=([^/]*)/", 1).alias("folder")).distinct()


@query("streaming_ingest", "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids FROM documents")
def streaming_ingest(spark, sf_dir):
    """Two runs over the same files: the second adds nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = shared_folder(spark)
    docs.write.parquet(f"{folder}/in")
    for n in range(2):
        rows = ingest.follow(spark, f"{folder}/in", docs.schema)
        ingest.index_new(rows, f"{folder}/index", f"{folder}/state{n}", "doc_id").awaitTermination()
    return commits.collection(spark, f"{folder}/index", docs.schema).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"))


@query(
    "gold_load_twice",
    """SELECT DISTINCT CASE WHEN turn % 2 = 0 THEN 'k' || conv_id || '_' || turn ELSE 'g' || conv_id || '.jsonl_line_' || turn END AS chunk_id,
    '["a","b' || turn || '"]' AS keywords FROM conversations""",
)
def gold_load_twice(spark, sf_dir):
    """Whole gold records, maps included, in two loads that overlap and a repeated one."""
    rows = table(spark, sf_dir, "conversations")
    lines = rows.select(F.expr(_GOLD).alias("value"), F.concat(F.lit("/gold/g"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("file"), F.col("turn").alias("position"))
    gold, path = I.gold_records(lines), f"{shared_folder(spark)}/gold"
    commits.load(gold.filter("length(page_content) % 3 <> 0"), path, "first")
    for batch in ("second", "second"):
        commits.load(gold, path, batch)
    return commits.collection(spark, path, gold.schema).select("chunk_id", F.col("metadata").getItem("keywords").alias("keywords"))


@query("streaming_progress", "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def streaming_progress(spark, sf_dir):
    """The windowed counts of the stream, over the table's files as one backlog."""
    events = table(spark, sf_dir, "events").select("ts", "event_type")
    return ingest.progress(events).select("event_type", F.col("w.start").alias("start"), "n")


@query(
    "streaming_windows",
    """SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL""",
)
def streaming_windows(spark, sf_dir):
    """Windowed counts in append mode: the windows that the watermark has passed when the backlog is done."""
    schema = table(spark, sf_dir, "events").schema
    folder = shared_folder(spark)
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select("ts", "event_type")
    ingest.backlog(ingest.closed_windows(events), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(T.StructType([schema["event_type"], T.StructField("start", schema["ts"].dataType), T.StructField("n", T.LongType())])).parquet(f"{folder}/out")


@query(
    "observed_load",
    "SELECT count(*) AS n_rows, count(*) FILTER (length(trim(text)) > 0) AS with_text, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents",
)
def observed_load(spark, sf_dir):
    """The figures of a streamed load, taken as its rows pass and told by a listener, summed over its batches."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder, figures = shared_folder(spark), "rows long, with_text long, chars long"
    docs.write.parquet(f"{folder}/in")
    log = ingest.ProgressLog(spark, f"{folder}/progress", "load")
    spark.streams.addListener(log)
    try:
        rows = ingest.follow(spark, f"{folder}/in", docs.schema, files_per_batch=100)
        told = ingest.counted(rows, "load", with_text=F.count_if(F.length(F.trim("text")) > 0), chars=F.sum(F.length(F.coalesce("text", F.lit("")))))
        log.finish(ingest.backlog(told, f"{folder}/table", f"{folder}/state"))
    finally:
        spark.streams.removeListener(log)
    return log.rows(figures).agg(F.sum("rows").alias("n_rows"), F.sum("with_text").alias("with_text"), F.sum("chars").alias("chars"))


def chat_turns(rows: DataFrame) -> DataFrame:
    """Questions and answers with the number of their first event, dealt by conversation over as many tasks as there are cores or more."""
    said = rows.filter("role IN ('user', 'assistant')").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    size = F.when(F.col("role") == "user", 1).otherwise(F.size(F.split("text", " ", -1)) + 2).cast("long")
    start = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return said.repartition(tasks, "conv_id").select("conv_id", "role", "text", start.alias("start"))


def turn_events(turns: DataFrame) -> DataFrame:
    """Turns as the events of a server: questions, then words, sources and an end, an error for every seventh length."""
    user, long, words = F.col("role") == "user", F.length("text"), F.split("text", " ", -1)
    links, end = F.concat(F.lit("n"), long.cast("string")), F.when(long % 7 == 0, "error").otherwise("done")
    told = F.when(user, F.array("text")).otherwise(F.concat(words, F.array(links, F.lit("no"))))
    # Below the generator, so that a turn is split once and not for each of its words.
    whole = turns.select("conv_id", "start", user.alias("user"), end.alias("end"), (F.size(words) - 1).alias("last"), told.alias("told"))
    rows = whole.select("conv_id", "start", "user", "end", "last", F.posexplode("told").alias("at", "text"))
    at, last = F.col("at"), F.col("last")
    kind = F.when(F.col("user"), "user").when(at <= last, "token").when(at == last + 1, "sources").otherwise(F.col("end"))
    text = F.when(~F.col("user") & (at < last), F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    return rows.select("conv_id", (F.col("start") + at).alias("seq"), F.timestamp_seconds(F.lit(1_704_067_200)).alias("ts"), kind.alias("kind"), text.alias("text"))


def chat_events(rows: DataFrame) -> DataFrame:
    """Conversations as events."""
    return turn_events(chat_turns(rows))


_CHAT = r"""WITH r AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE role IN ('user', 'assistant') AND conv_id IS NOT NULL),
    o AS (SELECT *, row_number() OVER w AS k, coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE len(string_split(text, ' ')) + 2 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seq
        FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
    x AS (SELECT *, lead(role) OVER w AS next, lead(text) OVER w AS reply FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
    s AS (SELECT *, CASE WHEN next IS NULL THEN 'expired' WHEN next = 'user' THEN 'cut' WHEN length(reply) % 7 = 0 THEN 'error' ELSE 'done' END AS status FROM x WHERE role = 'user')
    SELECT conv_id, seq, text AS question, CASE status WHEN 'done' THEN reply WHEN 'cut' THEN '' END AS answer, CASE WHEN status = 'done' THEN 'n' || length(reply) END AS sources,
    status, CASE WHEN status = 'error' THEN 'no' END AS detail FROM s"""


@query("chat_fold", _CHAT)
def chat_fold(spark, sf_dir):
    return chat.fold_table(chat_events(table(spark, sf_dir, "conversations")))


@query("chat_stream", f"SELECT * FROM ({_CHAT}) WHERE status <> 'expired'")
def chat_stream(spark, sf_dir):
    """The same events in two halves, each with every other event, the stream being started again between them."""
    events = turn_events(stored(chat_turns(table(spark, sf_dir, "conversations"))))
    folder = shared_folder(spark)
    for half in range(2):
        events.filter(F.col("seq") % 2 == 1 - half).write.mode("append").parquet(f"{folder}/in")
        rows = ingest.follow(spark, f"{folder}/in", events.schema)
        ingest.backlog(chat.fold_stream(rows), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(chat.fold_table(events).schema).parquet(f"{folder}/out")
