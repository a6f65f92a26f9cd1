"""Model calls behind a small protocol, with a deterministic offline provider as the default.

Calls run in Arrow batches inside the executors; an error marks its row and spares the others.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import fixed
from lexloom.functions.text import strip


class Provider(Protocol):
    """What the engine asks of a model service; instances must pickle."""

    name: str
    supports_system: bool

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...

    def generate(self, prompts: Sequence[str]) -> list[str]: ...


@dataclass(frozen=True)
class OfflineProvider:
    """Hashed token vectors and replies made from the prompt; equal input, equal output."""

    name: str = "offline"
    supports_system: bool = True
    dimensions: int = 64

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = [0.0] * self.dimensions
            for token in text.split():
                h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
                vector[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            if not any(vector) and text.strip("\t\n\f\r "):  # tokens that cancel out, or rarer white space only
                vector[int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big") % self.dimensions] = 1.0
            norm = sum(x * x for x in vector) ** 0.5 or 1.0
            out.append([x / norm for x in vector])
        return out

    def generate(self, prompts: Sequence[str]) -> list[str]:
        out = []
        for prompt in prompts:
            words = sorted(set(prompt.split()), key=lambda w: (-len(w), w))[:5]
            out.append(json.dumps({"summary": " ".join(prompt.split()[:12]), "keywords": words, "expanded_query": " ".join(prompt.split()[-8:])}, ensure_ascii=False))
        return out


def choose_provider(candidates: Sequence[tuple[str, Callable[[], Provider | None]]]) -> Provider:
    """The first candidate that is configured; its maker gives None where it is not."""
    for _, make in candidates:
        if (made := make()) is not None:
            return made
    raise LookupError("no provider is configured; tried " + (", ".join(name for name, _ in candidates) or "none"))


@dataclass
class Slots:
    """One lane of a rate: times ``period`` seconds apart, each taken once; the clock can be replaced for tests."""

    period: float
    now: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    next: float = float("-inf")

    def take(self) -> float:
        """Sleep until the next free time, take it and return it."""
        at = max(self.next, self.now())
        self.next = at + self.period
        while (ahead := at - self.now()) > 0:
            self.sleep(ahead)
        return at


def with_retries(call: Callable, tries: int = 3, base: float = 2.0, sleep: Callable[[float], None] = time.sleep):
    """The call's result; waits 2, 4, 8... seconds between tries and raises what the last one raised."""
    for n in range(tries):
        try:
            return call()
        except Exception:
            if n == tries - 1:
                raise
            sleep(base * 2**n)


def lanes(calls_per_minute: int, at_once: int) -> int:
    """Into how many lanes a rate is split: as many as may run at once, each with the same whole number of calls."""
    return max(n for n in range(1, max(1, min(calls_per_minute, at_once)) + 1) if calls_per_minute % n == 0)


def generate(
    df: DataFrame, prompt: str, output: str, provider: Provider | None = None, calls_per_minute: int | None = None, batch: int = 32, tries: int = 1, backoff: float = 2.0
) -> DataFrame:
    """Adds ``output`` (null on failure) and ``<output>_error``.

    Prompts go in batches; where a batch fails, its prompts go one by one, each up to ``tries`` times. A rate holds for
    the whole job: rows are dealt over a few partitions, each a lane that makes one call at a time in its own time slot,
    so no minute sees more calls than stated however many tasks there are. A task that runs again calls again.
    """
    service = provider or OfflineProvider()
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    split = lanes(calls_per_minute, df.sparkSession.sparkContext.defaultParallelism) if calls_per_minute else 1
    period = 60.0 * split / calls_per_minute if calls_per_minute else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = None
        if calls_per_minute:
            slots = Slots(period)
            time.sleep(period * (TaskContext.get().partitionId() % split) / split)

        def one(text: str) -> str:
            if slots:
                slots.take()
            return service.generate([text])[0]

        def told(texts: list[str]) -> list[tuple[str | None, str | None]]:
            if not slots and len(texts) > 1:
                try:
                    return [(reply, None) for reply in service.generate(texts)]
                except Exception:  # one of them: find out which
                    pass
            out: list[tuple[str | None, str | None]] = []
            for text in texts:
                try:
                    out.append((with_retries(lambda text=text: one(text), tries, backoff), None))
                except Exception as e:  # a failed call marks its row
                    out.append((None, f"{type(e).__name__}: {e}"[:500]))
            return out

        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                rows = told([text or "" for text in part.column(prompt).to_pylist()])
                made = [pa.array([r[k] for r in rows], pa.string()) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, output, f"{output}_error"])

    dealt = df.repartition(split) if calls_per_minute else df
    return dealt.mapInArrow(run, ", ".join([*fields, f"`{output}` string", f"`{output}_error` string"]))


def embed(df: DataFrame, text: str, output: str = "embedding", provider: Provider | None = None, batch: int = 64, tries: int = 3, backoff: float = 2.0) -> DataFrame:
    """Adds the embedding of ``text`` as an array of floats; a batch that fails is tried again, with growing waits."""
    service = provider or OfflineProvider()
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != output]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                texts = [t or "" for t in part.column(text).to_pylist()]
                made = with_retries(lambda texts=texts: service.embed(texts), tries, backoff)
                kept = [(n, c) for n, c in zip(part.schema.names, part.columns, strict=True) if n != output]
                yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(made, pa.list_(pa.float32()))], [*(n for n, _ in kept), output])

    return df.mapInArrow(run, ", ".join([*fields, f"`{output}` array<float>"]))


def json_text(reply: Column) -> Column:
    """The JSON of a reply: inside a code fence if there is one, from the first brace to the last."""
    fenced = F.regexp_extract(reply, r"(?is)```(?:json)?\s*(.*?)```", 1)
    bare = strip(F.when(fenced != "", fenced).otherwise(reply))
    block = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(block != "", block).otherwise(bare)


CHUNK_FACTS = "struct<summary:string,keywords:array<string>,entities:array<struct<type:string,text:string>>>"


def chunk_prompt(columns: Sequence[str], text: str = "page_content") -> Column:
    """The metadata lines of a chunk and its text."""
    meta = F.concat_ws("\n", *(F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in ("source", "title", "section_name", "section_heading") if c in columns))
    return F.concat_ws("\n\n", meta, F.col(text))


def chunk_facts(told: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` and what ``__reply`` says of a chunk."""
    facts = F.from_json(json_text(F.col("__reply")), CHUNK_FACTS)
    return told.withColumn("__f", facts).select(*columns, "__f.summary", "__f.keywords", "__f.entities", F.col("__reply_error").alias("enrich_error"))


def enrich_chunks(chunks: DataFrame, provider: Provider | None = None, calls_per_minute: int | None = None, text: str = "page_content", tries: int = 1) -> DataFrame:
    """Adds ``summary, keywords, entities``; null where the call or its reply fails."""
    asked = chunks.withColumn("__prompt", chunk_prompt(chunks.columns, text))
    return chunk_facts(generate(asked, "__prompt", "__reply", provider, calls_per_minute, tries=tries), chunks.columns)


def expanded_query(reply: Column, question: Column) -> Column:
    """The reply's expanded query, or the question where the reply is no JSON object or leaves it blank."""
    told = F.get_json_object(json_text(reply), "$.expanded_query")
    return F.when(F.coalesce(strip(told), F.lit("")) == "", question).otherwise(told)


def enrich_queries(queries: DataFrame, provider: Provider | None = None, enabled: bool = True) -> DataFrame:
    if not enabled:
        return queries.withColumn("expanded_query", F.col("question"))
    told = generate(queries, "question", "__reply", provider)
    return told.withColumn("expanded_query", expanded_query(F.col("__reply"), F.col("question"))).drop("__reply", "__reply_error")
