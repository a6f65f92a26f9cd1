"""Exchanges, progress and replies over batches, restarts and crashes."""

from __future__ import annotations

import json
import os
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from lexloom.operators import enrich as E
from lexloom.operators import ledger
from lexloom.streaming import chat, ingest

EVENT = "conv_id long, seq long, ts timestamp, kind string, text string"
START = datetime(2024, 1, 1)


def event(conv, seq, kind, text=None, minute=0):
    return conv, seq, START + timedelta(minutes=minute), kind, text


TOLD = [
    event(1, 0, "token", "nobody asked"), event(1, 1, "user", "q1"), event(1, 2, "token", "par"), event(1, 3, "token", "tial"), event(1, 4, "error", "broken"),
    event(1, 5, "token", "too late"), event(1, 6, "user", "q2"), event(1, 7, "token", "a "), event(1, 8, "sources", "[1]"), event(1, 9, "token", None),
    event(1, 10, "sources", "[2]"), event(1, 11, "token", "b"), event(1, 12, "done"), event(1, 13, "done"),
    event(2, 0, "user", "q"), event(2, 1, "token", "cut "), event(2, 2, "strange", "x"), event(2, 3, "user", None), event(2, 4, "done"), event(2, 5, "user", "open"), event(2, 6, "token", "never shown"),
]
CLOSED = {
    (1, 1, "q1", None, None, "error", "broken"), (1, 6, "q2", "a b", "[2]", "done", None),
    (2, 0, "q", "cut ", None, "cut", None), (2, 3, "", "", None, "done", None),
}
NOWHERE = [(None, 0, START, "user", "x"), (3, None, START, "user", "x"), (3, 0, None, "user", "x")]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def drain(spark, folder, batches, **how):
    """Each batch of events, the stream being started again for it."""
    for batch in batches:
        spark.createDataFrame(batch, EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = ingest.follow(spark, f"{folder}/in", spark.createDataFrame([], EVENT).schema)
        ingest.backlog(chat.fold_stream(stream, **how), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_fold_of_a_table(spark, monkeypatch):
    want = sorted([*CLOSED, (2, 5, "open", None, None, "expired", None)], key=repr)
    for block in (4096, 2):
        monkeypatch.setattr(chat, "BLOCK", block)
        assert rows(chat.fold_table(spark.createDataFrame([*TOLD, *TOLD[:7], *NOWHERE], EVENT))) == want
    shown = chat.messages(chat.fold_table(spark.createDataFrame(TOLD, EVENT))).filter("conv_id = 1").orderBy("seq", "part").collect()
    assert [(r.role, r.text) for r in shown] == [("user", "q1"), ("user", "q2"), ("assistant", "a b")]


def test_fold_of_a_stream_in_any_order(spark, tmp_path):
    told = [*TOLD, *TOLD[:5]]
    random.Random(4).shuffle(told)
    got = drain(spark, f"file://{tmp_path}", [told[:9], told[9:16] + NOWHERE, told[16:], TOLD[:8]])
    assert rows(got) == sorted(CLOSED, key=repr)


def test_open_answers_expire_and_late_events_go(spark, tmp_path):
    first = [event(1, 0, "user", "q"), event(1, 1, "token", "half"), event(2, 0, "user", "gap"), event(2, 2, "token", "x"), event(2, 3, "done")]
    clock = [event(9, 0, "user", "tick", 60)]
    after = [event(1, 2, "done", None, 61), event(1, 3, "user", "again", 61), event(1, 4, "done", None, 61), event(3, 0, "user", "late", 1), event(3, 1, "done", None, 1), event(9, 1, "done", None, 61)]
    got = drain(spark, f"file://{tmp_path}", [first, clock, after], late="1 minute", idle_ms=600_000)
    assert rows(got) == sorted([
        (1, 0, "q", None, None, "expired", None), (2, 0, "gap", "x", None, "done", None), (1, 3, "again", "", None, "done", None), (9, 0, "tick", "", None, "done", None),
    ], key=repr)


def test_empty_tables(spark):
    assert rows(chat.fold_table(spark.createDataFrame([], EVENT))) == []


def test_windows_close_once_and_late_rows_go(spark, tmp_path):
    folder, schema = f"file://{tmp_path}", "ts timestamp, event_type string"
    out = None
    for minutes in ([5, 20, 65], [150], [10, 130, 300]):
        spark.createDataFrame([(START + timedelta(minutes=m), "a") for m in minutes], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = ingest.follow(spark, f"{folder}/in", spark.createDataFrame([], schema).schema)
        ingest.backlog(ingest.closed_windows(stream), f"{folder}/out", f"{folder}/state").awaitTermination()
        out = sorted((r.start.hour, r.n) for r in spark.read.parquet(f"{folder}/out").collect())
    assert out == [(0, 2), (1, 1), (2, 2)]


def test_progress_a_row_a_batch(spark, tmp_path):
    folder, schema = f"file://{tmp_path}", "i long, text string"
    log = ingest.ProgressLog(spark, f"{folder}/progress", "load")
    assert rows(log.rows("rows long")) == []
    spark.streams.addListener(log)
    try:
        for n in range(3):
            spark.createDataFrame([(i, "x" * i) for i in range(n + 1)], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            stream = ingest.follow(spark, f"{folder}/in", spark.createDataFrame([], schema).schema)
            from pyspark.sql import functions as F

            log.finish(ingest.backlog(ingest.counted(stream, "load", chars=F.sum(F.length("text"))), f"{folder}/out", f"{folder}/state"))
    finally:
        spark.streams.removeListener(log)
    assert rows(log.rows("rows long, chars long")) == [(0, 1, 1, 0), (1, 2, 2, 1), (2, 3, 3, 3)]


class Counting(E.OfflineProvider):
    """Notes its calls in a file; fails at some prompts and kills its job at others."""

    def __init__(self, notes, fails=(), kills=()):
        super().__init__()
        object.__setattr__(self, "notes", str(notes))
        object.__setattr__(self, "fails", tuple(fails))
        object.__setattr__(self, "kills", tuple(kills))

    def generate(self, prompts):
        if any(k in p for p in prompts for k in self.kills):
            raise KeyboardInterrupt
        if any(f in p for p in prompts for f in self.fails):
            raise RuntimeError("no")
        with open(self.notes, "a", encoding="utf-8") as out:
            out.write("".join(json.dumps(p) + "\n" for p in prompts))
        return super().generate(prompts)


def calls(notes):
    return Counter(json.loads(line) for line in open(notes, encoding="utf-8")) if os.path.exists(notes) else Counter()


def test_equal_prompts_are_called_once(spark, tmp_path):
    df = spark.createDataFrame([(i, f"p{i % 5}", "old") for i in range(40)] + [(40, None, "old")], "i long, p string, out string")
    notes, path = tmp_path / "calls", f"file://{tmp_path}/ledger"
    plain = {r.i: r.o for r in E.generate(df.select("i", "p"), "p", "o").collect()}
    for _ in range(2):
        got = ledger.generate_once(df, "p", "out", path, Counting(notes), parts=3)
        assert got.columns == ["i", "p", "out", "out_error"]
        assert {r.i: r.out for r in got.collect()} == plain
    assert calls(notes) == Counter({**{f"p{i}": 1 for i in range(5)}, "": 1})
    assert ledger.generate_once(df.limit(0), "p", "out", f"{path}2", parts=3).count() == 0


def test_only_missing_replies_are_called_after_a_crash(spark, tmp_path):
    df = spark.createDataFrame([(i, f"prompt {i}") for i in range(60)], "i long, p string")
    notes, path = tmp_path / "calls", f"file://{tmp_path}/ledger"
    with pytest.raises(Exception):
        ledger.generate_once(df, "p", "out", path, Counting(notes, kills=["prompt 7"]), parts=6)
    kept = {r.digest for r in ledger.replies(spark, path).collect()}
    before = calls(notes)
    told = ledger.generate_once(df, "p", "out", path, Counting(notes), parts=6).collect()
    again = calls(notes) - before
    assert len(told) == 60 and all(r.out and r.out_error is None for r in told)
    assert sum(again.values()) == 60 - len(kept) and set(again.values()) == {1}


def test_files_count_when_all_their_chunks_do(spark, tmp_path):
    rows_ = [("a", "a1", "fine"), ("a", "a2", "bad one"), ("b", "b1", "fine too"), (None, "c1", "alone"), (None, "c2", "bad alone")]
    chunks = spark.createDataFrame(rows_, "source string, chunk_id string, page_content string")
    notes, path = tmp_path / "calls", f"file://{tmp_path}/gold"
    done = lambda: {r.chunk_id for r in ledger.enriched(spark, path, chunks.schema).collect()}
    assert ledger.enrich_files(chunks, path, Counting(notes, fails=["bad"]), parts=2) == 2 and done() == {"b1", "c1"}
    before = calls(notes)
    assert ledger.enrich_files(chunks, path, Counting(notes), parts=2) == 3 and done() == {"a1", "a2", "b1", "c1", "c2"}
    assert sum((calls(notes) - before).values()) == 2
    assert ledger.enrich_files(chunks, path, Counting(notes), parts=2) == 0 and len(calls(notes)) == 5


def test_a_turn_is_split_once_for_its_events(spark):
    """Not once for each word, which is quadratic in the length of a turn; the events of a long answer give its text."""
    from lexloom.plans.retrieval_queries import chat_events

    long = " ".join(f"w{i}" for i in range(20_000))
    rows = spark.createDataFrame([(1, 0, "user", "a b"), (1, 1, "assistant", long), (1, 2, "assistant", None)], "conv_id long, turn long, role string, text string")
    events = chat_events(rows)
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "split(" not in plan.split("Generate")[0]
    found = sorted((r["seq"], r["kind"], r["text"]) for r in events.collect())
    assert [s for s, _, _ in found] == list(range(1 + 20_002 + 3)) and found[0] == (0, "user", "a b")
    assert "".join(t for _, k, t in found if k == "token") == long
    assert found[20_001:] == [(20_001, "sources", f"n{len(long)}"), (20_002, "done" if len(long) % 7 else "error", "no"), (20_003, "token", ""), (20_004, "sources", "n0"), (20_005, "error", "no")]
