"""Index tables: gold records, BM25 postings and statistics, vectors, and loading only what is new."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import fixed
from lexloom.functions.text import WHITE_SPACE, base_name, embedding_text, rx, strip
from lexloom.operators.postings import blocks, checked, numbered
from lexloom.session import stored


#: Distinct query tokens up to which they are broadcast, and up to which they are looked for in the texts.
MANY_TOKENS, FEW_TOKENS = 100_000, 1000
#: Distinct query tokens up to which each task looks them up while it reads the texts; tokens a task counts before it passes them on.
HELD_TOKENS, COUNTED = 1_000_000, 500_000


def tokens(text):
    """White-space tokens as they are, not lower-cased."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rx(r"\s+"), -1), lambda t: t != "")


_BREAKS = re.compile(f"[{WHITE_SPACE}]+")


def words(text: str | None) -> list[str]:
    """:func:`tokens` of a text in Python, whose own split also breaks at four control characters."""
    text = text or ""
    return [w for w in _BREAKS.split(text) if w] if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``text`` to ``token, df``; a row without a token has the number of documents and ``total``, that of all their tokens."""

    def told(found: dict, total: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64()), pa.array([total if t is None else 0 for t in found], pa.int64())], ["token", "df", "total"])

    found, n, total = Counter(), 0, 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            own = words(text)
            n, total = n + 1, total + len(own)
            found.update(set(own))
            if len(found) > COUNTED:
                yield told(found, 0)
                found = Counter()
    yield told({None: n, **found}, total)


def _looked_up(names):
    """Batches of ``doc_id, text`` to ``doc_id, dl, t, tf`` of the documents that hold any of the broadcast tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = names.value
        for batch in batches:
            ids, lengths, ends, ts, tfs = [], [], [0], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = words(text)
                for w, n in Counter(own).items():
                    if (t := number.get(w)) is not None:
                        ts.append(t)
                        tfs.append(n)
                if len(ts) > ends[-1]:
                    ids.append(doc_id)
                    lengths.append(len(own))
                    ends.append(len(ts))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(x, np.int32))) for x in (ts, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int32()), *lists], ["doc_id", "dl", "t", "tf"])

    return run


@dataclass(frozen=True)
class Bm25Index:
    """``postings(token, doc_id, tf, dl)``, ``terms(token, df, idf)``, ``stats(n, avgdl)``, ``docs(doc_id, dl)``.

    An index that is not stored has ``occurrences(token, doc_id, dl)`` as well, from which a query takes its tokens
    before anything is counted.
    """

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    docs: DataFrame
    occurrences: DataFrame | None = None
    #: ``token`` once per document and token, of an index in memory.
    raw: DataFrame | None = None
    decimals: int = 9
    #: ``doc_id, dl, tokens`` once per document, of an index in memory.
    texts: DataFrame | None = None
    #: ``raw`` of the whole index, and the share of the mean idf that a negative one becomes.
    whole: DataFrame | None = None
    epsilon: float = fixed.BM25_EPSILON
    #: ``doc_id, text`` as given, of an index in memory.
    given: DataFrame | None = None

    #: Documents of stored segments that are deleted; an index in memory has none.
    dead = None

    def about(self, asked: DataFrame) -> Bm25Index:
        """This index with the postings of few asked tokens only, all figures kept; the texts are read and split once.

        What is kept stands as a table: a row per document with its length and its occurrences of these tokens.
        ``terms`` and ``whole`` are those of the whole index.
        """
        wanted = [] if self.texts is None else [row["token"] for row in asked.select("token").distinct().limit(FEW_TOKENS + 1).collect()]
        if not 0 < len(wanted) <= FEW_TOKENS:
            return self
        near = stored(self.texts.select("doc_id", "dl", F.filter("tokens", lambda t: t.isin(wanted)).alias("tokens")))
        return replace(_index(near, self.terms, self.decimals), whole=self.whole, epsilon=self.epsilon)

    def blocks(self, asked: DataFrame, avgdl: float) -> tuple[DataFrame, DataFrame]:
        """The blocks of the tokens of ``asked(query_id, token, times)`` and ``query_id, token, w``.

        Where nothing is stored, the tokens go to the occurrences and only theirs are counted and shuffled, once; the
        corpus's mean idf, which needs all tokens, is counted only where a token's own is negative.
        """
        near, terms, weighed = self._asked(asked)
        return stored(blocks(near, terms, avgdl or 1.0)), weighed

    def found(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The postings ``token, doc_id, tf, dl`` of the asked tokens, and ``query_id, token, w``."""
        near, _, weighed = self._asked(asked)
        return near, weighed

    def _asked(self, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        wanted = asked.select("token").distinct()
        if self.occurrences is None:
            near = self.postings.join(checked(wanted, MANY_TOKENS), "token", "left_semi")
            terms = self.terms.join(checked(wanted, MANY_TOKENS), "token", "left_semi")
        else:
            found = self.occurrences.join(checked(wanted, MANY_TOKENS), "token", "left_semi")
            near = stored(found.groupBy("token", "doc_id", "dl").agg(F.count("*").alias("tf")))
            terms = self._terms_of(wanted)
        terms = stored(terms.select("token", "df", "idf"))
        weighed = asked.join(terms, "token").select("query_id", "token", (F.col("times") * F.col("idf")).alias("w"))
        return near, terms, weighed

    def read_for(self, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int, float] | None:
        """For many queries over an index in memory: ``doc_id, dl, t, tf`` a document, ``token, t``, ``query_id, token, w``, n and avgdl.

        Texts are split inside the tasks that read them, once to count documents by token and once for the asked tokens,
        so that no occurrence is a row. None where the index is stored or more than ``HELD_TOKENS`` are asked.
        """
        if self.given is None:
            return None
        names = stored(numbered(asked.select(F.col("token").alias("doc_id"))).select(F.col("doc_id").alias("token"), F.col("nth").cast("int").alias("t")))
        if names.count() > HELD_TOKENS:
            return None
        told = self.given.select("text").mapInArrow(_counted, "token string, df long, total long")
        told = stored(told.groupBy("token").agg(F.sum("df").alias("df"), F.sum("total").alias("total")))
        n, total = next(((r["df"], r["total"]) for r in told.filter("token IS NULL").collect()), (0, 0))
        raw = told.filter("token IS NOT NULL").select("token", "df", raw_idf(F.lit(n), F.col("df"), self.decimals).alias("idf"))
        terms = self._floored(stored(raw.join(checked(names), "token", "left_semi")), lambda: raw)
        weighed = asked.join(terms, "token").select("query_id", "token", (F.col("times") * F.col("idf")).alias("w"))
        held = self.given.sparkSession.sparkContext.broadcast({r["token"]: r["t"] for r in names.collect()})
        rows = self.given.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_looked_up(held), "doc_id long, dl int, t array<int>, tf array<int>")
        return rows, names, weighed, n, round(total / n, self.decimals) if n else 0.0

    def _terms_of(self, wanted: DataFrame) -> DataFrame:
        n = self.stats.first()["n"]
        counted = self.raw.join(checked(wanted, MANY_TOKENS), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
        told = stored(counted.withColumn("idf", raw_idf(F.lit(n), F.col("df"), self.decimals)))
        each = lambda: self.whole.groupBy("token").agg(F.count("*").alias("df")).select(raw_idf(F.lit(n), F.col("df"), self.decimals).alias("idf"))
        return self._floored(told, each)

    def _floored(self, told: DataFrame, each) -> DataFrame:
        """Terms with a share of the mean of ``each()`` for a negative idf; the mean is taken only where there is one."""
        if told.filter("idf < 0").isEmpty():
            return told
        mean = each().agg(F.round(F.avg("idf"), self.decimals)).first()[0]
        return told.withColumn("idf", F.when(F.col("idf") < 0, F.round(F.lit(self.epsilon) * F.lit(mean), self.decimals)).otherwise(F.col("idf")))

    def ids(self) -> DataFrame:
        return self.docs.select("doc_id")

    def rows_an_id(self) -> int:
        return self.docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 1

    def write(self, path: str, buckets: int = 256) -> None:
        """The four tables under ``path``; postings in folders by a hash of the token."""
        bucket = F.pmod(F.xxhash64("token"), F.lit(buckets)).alias("bucket")
        self.postings.select("*", bucket).repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(8))).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        for name in ("terms", "stats", "docs"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")


def read_bm25(spark: SparkSession, path: str) -> Bm25Index:
    """An index that :meth:`Bm25Index.write` stored, whole; for pruned reads and upkeep see :mod:`lexloom.operators.segments`."""
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("terms", "stats", "docs")}
    return Bm25Index(spark.read.parquet(f"{path}/postings").drop("bucket"), **tables)


def raw_idf(n, df, decimals: int = 9):
    return F.round(F.log(n - df + 0.5) - F.log(df + 0.5), decimals)


def bm25_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", epsilon: float = fixed.BM25_EPSILON, decimals: int = 9) -> Bm25Index:
    """One shuffle for postings, one for document frequencies; a negative idf becomes ``epsilon`` times the mean.

    Figures are rounded so that the order of summation cannot change ranks.
    """
    split = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("tokens")).withColumn("dl", F.size("tokens"))
    index = _index(split, None, decimals)
    df = index.raw.groupBy("token").agg(F.count("*").alias("df"))
    raw = df.crossJoin(F.broadcast(index.stats.select("n"))).withColumn("raw", raw_idf(F.col("n"), F.col("df"), decimals))
    mean = raw.agg(F.round(F.avg("raw"), decimals).alias("mean"))  # a single row
    idf = F.when(F.col("raw") < 0, F.round(F.lit(epsilon) * F.col("mean"), decimals)).otherwise(F.col("raw"))
    terms = raw.crossJoin(F.broadcast(mean)).select("token", "df", idf.alias("idf"))
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return replace(index, terms=terms, texts=split, whole=index.raw, epsilon=epsilon, given=given)


def _index(split: DataFrame, terms: DataFrame | None, decimals: int) -> Bm25Index:
    """The tables of ``split(doc_id, dl, tokens)`` beside the given terms."""
    lengths = split.select("doc_id", "dl")
    stats = lengths.agg(F.count("*").alias("n"), F.round(F.avg("dl"), decimals).alias("avgdl"))
    # Terms are counted inside the row's own partition, so a posting leaves it once per term and document.
    exploded = split.select("doc_id", "dl", F.explode("tokens").alias("token"))
    postings = exploded.groupBy("token", "doc_id", "dl").agg(F.count("*").alias("tf"))
    distinct = split.select(F.explode(F.array_distinct("tokens")).alias("token"))
    return Bm25Index(postings, terms, stats, lengths, exploded, distinct, decimals)


GOLD = T.StructType(
    [
        T.StructField("page_content", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


def gold_records(lines: DataFrame, value: str = "value", file: str = "file", position: str = "position") -> DataFrame:
    """JSON lines as ``chunk_id, source, page_content, keywords_str, summary, embed_text, metadata``.

    The text is the first of three names that is filled; blank lines and blank texts go; a missing id is made from
    file and line; keyword arrays are joined; complex metadata stay JSON strings.
    """
    rec = lines.filter(strip(F.col(value)) != "").withColumn("r", F.from_json(value, GOLD))
    full = lambda c: F.nullif(c, F.lit(""))
    text = F.coalesce(full(F.col("r.page_content")), full(F.col("r.text")), full(F.col("r.content")), F.lit(""))
    meta = F.coalesce(F.col("r.metadata"), F.create_map().cast("map<string,string>"))
    name = base_name(F.col(file))
    words = F.array_join(F.from_json(F.col("meta").getItem("keywords"), "array<string>"), ", ")
    out = rec.select(name.alias("file"), F.col(position).alias("position"), text.alias("page_content"), meta.alias("meta")).filter(strip(F.col("page_content")) != "")
    made = F.concat_ws("", F.col("file"), F.lit("_line_"), F.col("position").cast("string"))
    out = out.select(
        F.coalesce(full(F.col("meta").getItem("chunk_id")), made).alias("chunk_id"),
        F.coalesce(F.col("meta").getItem("source"), F.col("file")).alias("source"),
        "page_content",
        F.coalesce(words, F.col("meta").getItem("keywords_str")).alias("keywords_str"),
        F.col("meta").getItem("summary").alias("summary"),
        F.col("meta").alias("metadata"),
    )
    return out.withColumn("embed_text", embedding_text(F.col("page_content"), F.col("keywords_str"), F.col("summary")))


def sanitize(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON strings; scalars as they are."""
    complex_types = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*(F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, complex_types) else F.col(f"`{f.name}`") for f in df.schema))


def only_new(gold: DataFrame, index: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows whose key the index lacks; of rows that share a key one is kept, that with the least digest of all columns.

    Keeping one and appending once is deliberate: a retried batch must not index a chunk again. Columns may be maps,
    whose entries count in the order of their keys. Rows without a key are left out: they could not be told apart from
    those that are loaded.
    """
    fresh = gold.filter(F.col(key).isNotNull()).join(index.select(key), key, "left_anti")
    told = F.sha2(F.to_json(F.struct(*(_comparable(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fresh.schema))), 256)
    least = fresh.groupBy(key).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in gold.columns)), told).alias("__r"))
    return least.select("__r.*")


def _comparable(value, kind: T.DataType):
    """Maps as sorted arrays of entries, at any depth below arrays and structs of them."""
    if isinstance(kind, T.MapType):
        return F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("k"), F.to_json(F.struct(_comparable(e["value"], kind.valueType).alias("v"))).alias("v"))))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _comparable(x, kind.elementType))
    if isinstance(kind, T.StructType) and kind.fields:
        return F.struct(*(_comparable(value.getField(f.name), f.dataType).alias(f.name) for f in kind))
    return value


def skip_existing(silver: DataFrame, gold: DataFrame, file: str = "source") -> DataFrame:
    """Rows of files that have no gold yet."""
    return silver.join(gold.select(file).distinct(), file, "left_anti")


def progress(gold: DataFrame, index: DataFrame, key: str = "chunk_id", file: str = "source") -> DataFrame:
    """Per file: its rows, those the index has, and those that are new; what a load would report."""
    known = index.select(key).distinct().withColumn("__known", F.lit(1))
    joined = gold.select(key, file).join(known, key, "left")
    counts = joined.groupBy(file).agg(F.count("*").alias("n_rows"), F.count("__known").alias("n_known"))
    return counts.withColumn("n_new", F.col("n_rows") - F.col("n_known"))


def load_counts(docs: DataFrame, metadata: DataFrame, sections: DataFrame, key: str = "Archivo", source: str = "source", text: str = "page_content") -> DataFrame:
    """One row: documents, metadata rows, documents that have such a row, sections, and sections with content."""
    pdf = F.regexp_replace(base_name(F.col(source)), r"\.md$", ".pdf")
    keys = metadata.select(F.col(key).alias("__key")).distinct()
    found = docs.select(pdf.alias("__key")).join(keys.withColumn("__m", F.lit(1)), "__key", "left")
    counted = found.agg(F.count("*").alias("documents"), F.count("__m").alias("matched"))
    filled = sections.agg(F.count("*").alias("sections"), F.count(F.nullif(F.col(text), F.lit(""))).alias("sections_with_content"))
    # Each side is one row.
    return counted.crossJoin(keys.agg(F.count("*").alias("metadata_rows"))).crossJoin(filled)


def append_index(rows: DataFrame, path: str, batch: int = fixed.INDEX_BATCH) -> None:
    rows.write.mode("append").option("maxRecordsPerFile", max(batch, 1) * 1000).parquet(path)


def collection(index: DataFrame, row_id: str = "chunk_id", text: str = "page_content") -> DataFrame:
    """The stored rows with text, with an ``id`` in any case."""
    has = "id" in index.columns
    return index.filter(F.coalesce(F.col(text), F.lit("")) != "").withColumn("id", F.coalesce(F.col("id"), F.col(row_id)) if has else F.col(row_id))
