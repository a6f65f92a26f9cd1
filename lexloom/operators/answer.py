"""From ranked chunks to cited context, prompts, answers and their sources."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import fixed
from lexloom.functions.text import clean_answer, source_preview, title
from lexloom.operators import enrich
from lexloom.operators.postings import checked
from lexloom.session import stored

NO_ANSWER = fixed.NO_ANSWER
#: Ranked documents, a few numbers each, up to which they are broadcast to the texts.
RANKED = 1_000_000
SYSTEM = "Responde solo con el contexto dado y cita cada afirmación como [docN]."


def _filled(df: DataFrame, names: tuple[str, ...]) -> Column:
    found = [F.nullif(F.col(f"`{n}`"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def context_blocks(ranked: DataFrame, text: str = "page_content") -> DataFrame:
    """Adds ``block``: ``[docN | source=... | chunk_id=...]``, the filled header lines, and the text."""
    number = F.col("rank").cast("string")
    source = F.coalesce(F.col("source"), F.lit(fixed.UNKNOWN_SOURCE)) if "source" in ranked.columns else F.lit(fixed.UNKNOWN_SOURCE)
    chunk = F.coalesce(_filled(ranked, ("chunk_id", "id")), F.concat(F.lit("doc_"), number))
    head = F.concat(F.lit("[doc"), number, F.lit(" | source="), source, F.lit(" | chunk_id="), chunk, F.lit("]"))
    labelled = [F.when(_filled(ranked, names).isNotNull(), F.concat(F.lit(f"{label}: "), _filled(ranked, names))) for label, names in fixed.CONTEXT_LINES]
    return ranked.withColumn("block", F.concat_ws("\n", head, *labelled, F.col(text)))


def context(ranked: DataFrame, text: str = "page_content") -> DataFrame:
    """``query_id, context``: the blocks in rank order between blank lines. A query has a bounded number of them."""
    rows = context_blocks(ranked, text).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "block"))).alias("b"))
    return rows.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"))


def prompt(question: Column, context_text: Column, supports_system: bool) -> Column:
    """The human turn; the system text is folded into it for models without a system role."""
    human = F.concat(F.lit("Contexto:\n"), context_text, F.lit("\n\nPregunta: "), question)
    return human if supports_system else F.concat(F.lit(SYSTEM + "\n\n"), human)


def sources(ranked: DataFrame, text: str = "page_content") -> DataFrame:
    """``query_id, rank, content, source, title, metadata`` for display."""
    own = F.coalesce(_filled(ranked, ("title", "book_title")), title(F.col("source")), F.lit(""))
    meta = [c for c in ranked.columns if c not in ("query_id", "rank", "score", "source", text)]
    return ranked.select(
        "query_id", "rank", source_preview(F.col(text)).alias("content"), F.coalesce("source", F.lit("")).alias("source"),
        own.alias("title"), F.to_json(F.struct(*meta)).alias("metadata"),
    )


def citations(answers: DataFrame, answer: str = "answer", key: str = "query_id") -> DataFrame:
    """``key, n``: the documents an answer cites as ``[docN]``, in order of mention, each once."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.col(answer), F.lit(r"\[doc(\d+)\]"), F.lit(1)), lambda n: n.cast("int")))
    return answers.select(key, F.posexplode(found).alias("mention", "n"))


def link_citations(answers: DataFrame, ranked: DataFrame, answer: str = "answer") -> DataFrame:
    """Citations with the document they mean; ``missing`` where there is no such document."""
    cited = citations(answers, answer)
    told = cited.join(ranked.select("query_id", F.col("rank").alias("n"), "doc_id"), ["query_id", "n"], "left")
    return told.withColumn("missing", F.col("doc_id").isNull())


def generate_answers(queries: DataFrame, retrieve, chunks: DataFrame, provider: enrich.Provider | None = None, k: int = 5, k_candidates: int = 10, limit_to_k: bool = False, enrich_first: bool = True) -> DataFrame:
    """``query_id, question, expanded_query, answer, n_docs, error`` for a table of questions.

    ``retrieve(queries, k)`` gives the fused union of ``k_candidates`` from each list; all of it is passed on unless
    ``limit_to_k`` asks for k.
    """
    service = provider or enrich.OfflineProvider()
    asked = stored(enrich.enrich_queries(queries, service, enrich_first))
    ranked = retrieve(asked.select("query_id", F.col("expanded_query").alias("question"), *(c for c in queries.columns if c not in ("query_id", "question"))), k_candidates)
    if limit_to_k:
        ranked = ranked.filter(F.col("rank") <= k)
    ranked = stored(ranked)
    # A few documents a question find their texts, which are not shuffled for them.
    told = context(checked(ranked, RANKED).join(chunks, "doc_id"))
    counts = ranked.groupBy("query_id").agg(F.count("*").alias("n_docs"))
    rows = asked.select("query_id", "question", "expanded_query").join(told, "query_id", "left").join(counts, "query_id", "left")
    rows = rows.withColumn("context", F.coalesce("context", F.lit(""))).withColumn("__prompt", prompt(F.col("question"), F.col("context"), service.supports_system))
    replied = enrich.generate(rows, "__prompt", "__answer", service)
    empty = (F.coalesce(F.col("n_docs"), F.lit(0)) == 0) & (F.coalesce("__answer", F.lit("")) == "")
    answer = F.when(empty, F.lit(NO_ANSWER)).otherwise(clean_answer(F.coalesce("__answer", F.lit(""))))
    return replied.select("query_id", "question", "expanded_query", answer.alias("answer"), F.coalesce("n_docs", F.lit(0).cast("long")).alias("n_docs"), F.col("__answer_error").alias("error"))


REQUEST = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("question", T.StringType()),
        T.StructField("k", T.IntegerType()),
        T.StructField("k_candidates", T.IntegerType()),
    ]
)


def valid_requests(requests: DataFrame) -> DataFrame:
    """Defaults filled in (4 and 8) and requests outside the limits marked in ``error``."""
    k, c = F.coalesce("k", F.lit(4)), F.coalesce("k_candidates", F.lit(8))
    error = (
        F.when(F.coalesce(F.length("question"), F.lit(0)) < 1, "question is empty")
        .when(~k.between(1, 8), "k is not in 1..8")
        .when(~c.between(4, 20), "k_candidates is not in 4..20")
    )
    return requests.withColumns({"k": k, "k_candidates": c, "error": error})


def events(answers: DataFrame, ranked_sources: DataFrame, words: int = 1) -> Iterator[tuple[int | None, str, str]]:
    """Per query, as a server would send them: ``token`` events, then ``sources``, then ``done``.

    A query whose ``error`` is told, or that has no answer, gives one ``error`` event instead; where the job itself
    fails, a last ``error`` event without a query ends the stream. Rows come to the driver one partition at a time.
    """
    listed = ranked_sources.groupBy("query_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("rank", "source", "title", "content")))).alias("sources"))
    told = answers if "error" in answers.columns else answers.withColumn("error", F.lit(None).cast("string"))
    try:
        for row in told.join(listed, "query_id", "left").orderBy("query_id").toLocalIterator():
            if row["error"] is not None or row["answer"] is None:
                yield row["query_id"], "error", row["error"] or "no answer"
                continue
            parts = row["answer"].split(" ")
            for at in range(0, len(parts), words):
                yield row["query_id"], "token", " ".join(parts[at : at + words]) + (" " if at + words < len(parts) else "")
            yield row["query_id"], "sources", row["sources"] or "[]"
            yield row["query_id"], "done", ""
    except Exception as e:  # whoever listens must learn that no more will come
        yield None, "error", f"{type(e).__name__}: {e}"[:500]


def chat_state(events_table: DataFrame) -> DataFrame:
    """Fold of ``conv_id, turn, role, text``: messages in order, blank ones not shown; partial answers before an error stay."""
    shown = events_table.filter(F.coalesce("text", F.lit("")) != "")
    rows = shown.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    return rows.withColumn("n_messages", F.size("messages"))
