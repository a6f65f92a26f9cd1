"""Exchanges of a chat folded from its events: in a stream with a state per conversation, and over a whole table.

Events are ``conv_id, seq, ts, kind, text``; ``seq`` counts a conversation's events from 0. A ``user`` event opens an
exchange. ``token`` events append to its answer, ``sources`` gives the answer's sources (the last one counts), ``done``
closes it, ``error`` closes it and drops the partial answer. A ``user`` event while an answer is open closes that one as
far as it was told (``cut``). Events outside an open exchange and of other kinds change nothing. Null texts are empty;
events without ``conv_id``, ``seq`` or ``ts`` are left out; of events with one ``seq`` one counts. Other columns are
ignored. A row an exchange: ``conv_id, seq`` (of the question), ``question, answer, sources, status, detail``.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

#: Events of a conversation that one task numbers in the fold of a table.
BLOCK = 4096

STATE = "next long, asked long, question string, answer string, sources string, ahead string, seen long"
FIELDS = ("seq", "question", "answer", "sources", "status", "detail")


@dataclass
class Fold:
    """A conversation so far: the number of its next event, the open exchange, and events that came before their turn."""

    next: int = 0
    asked: int | None = None
    question: str | None = None
    pieces: list[str] = field(default_factory=list)
    sources: str | None = None
    ahead: dict[int, tuple[str, str]] = field(default_factory=dict)
    closed: list[tuple] = field(default_factory=list)

    def take(self, events: Iterable[tuple[int, str, str]]) -> None:
        for seq, kind, text in events:
            if seq >= self.next:
                self.ahead.setdefault(seq, (kind, text))
            while self.next in self.ahead:
                self.step(self.next)

    def step(self, seq: int) -> None:
        kind, text = self.ahead.pop(seq)
        self.next = seq + 1
        if kind == "user":
            self.close("cut")
            self.asked, self.question = seq, text
        elif self.asked is not None:
            if kind == "token":
                self.pieces.append(text)
            elif kind == "sources":
                self.sources = text
            elif kind in ("done", "error"):
                self.close(kind, text if kind == "error" else None)

    def close(self, status: str, detail: str | None = None) -> None:
        if self.asked is not None:
            kept = status in ("done", "cut")
            self.closed.append((self.asked, self.question, "".join(self.pieces) if kept else None, self.sources if kept else None, status, detail))
        self.asked, self.question, self.pieces, self.sources = None, None, [], None

    def expire(self) -> None:
        """No more is awaited: gaps are passed over and an open answer is dropped."""
        for seq in sorted(self.ahead):
            self.step(seq)
        self.close("expired")


def _clean(events: DataFrame) -> DataFrame:
    rows = events.filter("conv_id IS NOT NULL AND seq IS NOT NULL AND ts IS NOT NULL")
    return rows.select("conv_id", F.col("seq").cast("long").alias("seq"), "ts", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"))


def fold_stream(events: DataFrame, late: str = "10 minutes", idle_ms: int = 1_800_000) -> DataFrame:
    """Closed exchanges of a stream of events, each once, in append mode.

    Events may come in any order and in any number of batches: those ahead of their turn wait in the state. Where the
    watermark (``late`` behind the newest event) is ``idle_ms`` past a conversation's last event, gaps are passed over
    and an open answer is ``expired``. After a second such time the conversation is forgotten; what still comes of it
    then waits for an expiry of its own. Events behind the watermark are dropped. The state holds an open answer and
    what waits, never closed exchanges.
    """
    key = events.schema["conv_id"].dataType.simpleString()

    def fold(conv: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told, seen = Fold(), 0
        if state.exists:
            start, asked, question, answer, sources, ahead, seen = state.get
            told = Fold(start, asked, question, [answer] if answer else [], sources, {s: (k, t) for s, k, t in json.loads(ahead)})
        if state.hasTimedOut:
            if told.asked is None and not told.ahead:
                state.remove()
                return
            told.expire()
            seen = state.getCurrentWatermarkMs()
        else:
            for rows in batches:
                told.take(zip(rows["seq"].tolist(), rows["kind"].tolist(), rows["text"].tolist(), strict=True))
                seen = max(seen, int(rows["ms"].max()))
        ahead = json.dumps([[s, k, t] for s, (k, t) in told.ahead.items()], ensure_ascii=False)
        state.update((told.next, told.asked, told.question, "".join(told.pieces), told.sources, ahead, seen))
        state.setTimeoutTimestamp(max(seen + idle_ms, state.getCurrentWatermarkMs() + 1))
        if told.closed:
            # By columns: a table of a few rows costs a third less so, and there is one a conversation and batch.
            yield pd.DataFrame({"conv_id": [conv[0]] * len(told.closed), **dict(zip(FIELDS, map(list, zip(*told.closed, strict=True)), strict=True))})

    rows = _clean(events).withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    schema = f"conv_id {key}, seq long, question string, answer string, sources string, status string, detail string"
    return rows.groupBy("conv_id").applyInPandasWithState(fold, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def fold_table(events: DataFrame) -> DataFrame:
    """All exchanges of a table of events, as if every conversation had expired.

    The question that an event belongs to is carried within blocks of ``BLOCK`` events and from block to block, so that
    a conversation of any length is spread over tasks; only the events of one exchange meet in a row.
    """
    rows = _clean(events).dropDuplicates(["conv_id", "seq"]).withColumn("block", F.floor(F.col("seq") / BLOCK))
    user = F.when(F.col("kind") == "user", F.col("seq"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.max(user).alias("last"))
    blocks = blocks.select("conv_id", "block", F.max("last").over(before).alias("carried"), F.max("last").over(Window.partitionBy("conv_id")).alias("newest"))
    within = Window.partitionBy("conv_id", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("own", F.max(user).over(within)).join(blocks, ["conv_id", "block"]).withColumn("asked", F.coalesce("own", "carried"))

    def of(kind: str):
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("seq", "text"))))

    end = F.min(F.when(F.col("kind").isin("done", "error"), F.struct("seq", "kind", "text"))).alias("end")
    met = placed.filter("asked IS NOT NULL").groupBy("conv_id", "asked").agg(
        F.max(F.when(F.col("seq") == F.col("asked"), F.col("text"))).alias("question"), F.first("newest").alias("newest"), end, of("token").alias("tokens"), of("sources").alias("links")
    )
    status = F.coalesce(F.col("end.kind"), F.when(F.col("asked") < F.col("newest"), "cut").otherwise("expired"))

    def told(pieces: str):
        return F.transform(F.filter(pieces, lambda x: F.col("end").isNull() | (x["seq"] < F.col("end.seq"))), lambda x: x["text"])

    kept = status.isin("done", "cut")
    return met.select(
        "conv_id", F.col("asked").alias("seq"), "question", F.when(kept, F.array_join(told("tokens"), "")).alias("answer"),
        F.when(kept, F.try_element_at(told("links"), F.lit(-1))).alias("sources"), status.alias("status"), F.when(status == "error", F.col("end.text")).alias("detail"),
    )


def messages(exchanges: DataFrame) -> DataFrame:
    """``conv_id, seq, part, role, text, sources``: the questions, and the answers that were not dropped, blank ones not shown."""
    asked = F.struct(F.lit(0).alias("part"), F.lit("user").alias("role"), F.col("question").alias("text"), F.lit(None).cast("string").alias("sources"))
    answered = F.struct(F.lit(1).alias("part"), F.lit("assistant").alias("role"), F.col("answer").alias("text"), F.col("sources"))
    rows = exchanges.select("conv_id", "seq", F.explode(F.array(asked, answered)).alias("m")).select("conv_id", "seq", "m.*")
    return rows.filter(F.coalesce("text", F.lit("")) != "")
