"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton of labelled text recognises every substring of it. A text is parsed greedily
into the longest phrases that the automaton holds (the sequential parsing of Ziv and Merhav); the language that
needs the fewest phrases, weighted with log2 of its reference's length as in the cross-entropy estimate, wins.

Greedy parsing restarts at the root, so automaton and restart fold into one table of (state, symbol) -> (state,
phrases ended). numpy walks many texts through all languages at once, one symbol of each text a step, longest texts
first; when few texts are left their rest is walked one by one. Whole texts, and no phrase is ever cut.

Learning sees a bounded sample of labelled rows, whole texts all of them: per language at most ``DOCUMENTS``, in order
of the hashes of their ids (the least of each of ``CLASSES`` classes), of at most ``LONGEST`` code points each and
``CHARACTERS`` together; a language with longer documents only is learned from its shortest one, whole, whose length is
then the one bound on its table. Repeated documents count once. Every letter of the sample is a symbol of its own; the table is
dense for the ``ALPHABET`` most frequent and sparse for the others. Only text and label are used. Driver and workers
hold the sample, a few hundred kilobytes per language; workers build the tables.

Defined results: null texts and texts without a letter give ``und`` with score 0; without labelled text every
language is ``und``; with one language known its score is 1; ties go to the first language by code point; rows
with a null id or label are predicted but not learned from; an empty table gives an empty table; extra columns
pass through :func:`predict`.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DOCUMENTS, LONGEST, CHARACTERS = 64, 16_000, 64_000
CLASSES = 256
ALPHABET = 61
#: Symbols walked together, and the number of texts below which they are walked singly.
AT_ONCE, FEW = 1 << 22, 12
#: Languages up to which the picked ids are broadcast.
MANY_LANGUAGES = 1000
SEED = 11
UNKNOWN = "und"
#: Symbols: 1 is any run of non-letters, 2 any letter that the references lack; letters follow.
GAP, RARE = 1, 2


def held_out(doc_id):
    """The documents that learning must not see."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> dict[str, list[str]]:
    """Sample texts per language, from labelled rows that are not held out."""
    told = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    told = told.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    told = told.filter(F.length("text") >= 1).withColumn("h", F.xxhash64(F.lit(SEED), "doc_id")).withColumn("th", F.xxhash64("text"))
    # Documents within the bound come first, by hash; beyond it, the shortest.
    told = told.withColumn("n", F.length("text").cast("long")).withColumn("long", F.when(F.col("n") > LONGEST, F.col("n")).otherwise(0))
    # The least of each class, so repeated rows meet map-side and a language ships CLASSES short rows a task at most.
    least = told.groupBy("lang", F.pmod("h", F.lit(CLASSES)).alias("class")).agg(F.min(F.struct("long", "h", "doc_id", "th", "n")).alias("x"))
    order = W.partitionBy("lang").orderBy("x.long", "x.h", "x.doc_id", "x.th")
    place, upto = F.row_number().over(order), F.sum("x.n").over(order.rowsBetween(W.unboundedPreceding, 0))
    fits = (F.col("place") <= DOCUMENTS) & (F.col("upto") <= CHARACTERS) & (F.col("x.long") == 0)
    picked = least.withColumn("place", place).withColumn("upto", upto).filter((F.col("place") == 1) | fits)
    picked = picked.select("lang", "x.doc_id", "x.h", "x.th")
    few = picked.select("lang").distinct().count() <= MANY_LANGUAGES
    rows = told.drop("h", "n", "long").join(F.broadcast(picked) if few else picked, ["lang", "doc_id", "th"])
    rows = rows.groupBy("lang", "h", "th").agg(F.first("text").alias("text")).collect()
    found: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["h"], r["text"])):
        if row["text"] not in (own := found.setdefault(row["lang"], [])):
            own.append(row["text"])
    return found


def _automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in step[p]:
            step[p][s] = new
            p = link[p]
        if p >= 0:
            q = step[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(step[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(s) == q:
                    step[p][s] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Parser:
    def __init__(self, samples: tuple[tuple[str, tuple[str, ...]], ...]):
        self.languages = [name for name, _ in samples]
        letters: Counter[str] = Counter()
        for _, texts in samples:
            own = Counter(c for t in texts for c in t.lower() if c.isalpha())
            n = sum(own.values()) or 1
            letters.update({c: k / n for c, k in own.items()})
        known = [c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))]
        self.size = ALPHABET + 3  # symbols from here on are in the sparse table
        self.most = len(known) + self.size
        self.symbol = _letters().astype(np.int32)
        for k, c in enumerate(known):
            self.symbol[ord(c)] = 3 + k
        tables, self.root, self.bits = [], [], []
        sparse: dict[int, int] = {}
        base = 0
        for _, texts in samples:
            reference = np.concatenate([self.symbols(t) for t in texts] or [np.empty(0, np.int32)])
            steps = _automaton(reference.tolist())
            table = self._fold(steps, base)
            sparse.update(((base + state) * self.most + s, 4 * (base + to)) for state, moves in enumerate(steps) for s, to in moves.items() if s >= self.size)
            self.root.append(base)
            self.bits.append(math.log2(max(2, len(reference))))
            base += len(table)
            tables.append(table)
        self.table = np.concatenate(tables).ravel() if tables else np.empty(0, np.int32)
        self.sparse = sparse
        self.keys = np.array(sorted(sparse), np.int64)
        self.moves = np.array([sparse[k] for k in self.keys.tolist()], np.int32)

    def _fold(self, steps: list[dict[int, int]], base: int) -> np.ndarray:
        """4 * next state + phrases ended, for every state and symbol."""
        table = np.zeros((len(steps), self.size), np.int32)
        first = np.full(self.size, 4 * base + 1, np.int32)  # a symbol unknown here is a phrase of its own
        for s, to in steps[0].items():
            if s < self.size:
                first[s] = 4 * (base + to)
        table[:] = first + 1  # the phrase so far ends and another begins
        table[0] = first
        for state, moves in enumerate(steps):
            for s, to in moves.items():
                if s < self.size:
                    table[state, s] = 4 * (base + to)
        return table

    def _find(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The sparse table's moves; -1 where there is none."""
        if not len(self.keys):
            return np.full(state.shape, -1, np.int32)
        wanted = state.astype(np.int64) * self.most + symbols
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.moves[at], np.int32(-1))

    def _rare_moves(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """As the dense table gives them, for symbols beyond it; states are languages x symbols."""
        root = np.array(self.root, np.int32)[:, None]
        first = self._find(np.broadcast_to(root, state.shape), symbols)
        first = np.where(first < 0, 4 * root + 1, first) + (state != root)
        own = self._find(state, symbols)
        return np.where(own < 0, first, own).astype(np.int32)

    def symbols(self, text: str) -> np.ndarray:
        """Symbols of a text, each run of non-letters as one."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.symbol[points]
        gap = out == GAP
        return out[~(gap & np.concatenate(([True], gap[:-1])))]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Languages x texts: the number of phrases."""
        counts = np.zeros((len(self.languages), len(texts)), np.int64)
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        at = 0
        while at < len(order) and len(texts[order[at]]) and self.languages:
            block, size = [], 0
            while at < len(order) and (not block or size + len(texts[order[at]]) <= AT_ONCE):
                block.append(order[at])
                size += len(texts[order[at]])
                at += 1
            counts[:, block] = self._walk([texts[k] for k in block])
        return counts

    def _walk(self, texts: list[np.ndarray]) -> np.ndarray:
        """Of texts whose lengths descend."""
        lengths = np.array([len(t) for t in texts])
        flat = np.concatenate(texts)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        root = np.array(self.root, np.int32)[:, None]
        state = np.repeat(root, len(texts), axis=1)
        ended = np.zeros(state.shape, np.int64)
        rare = bool((flat >= self.size).any())
        together = int(lengths[FEW - 1]) if len(texts) >= FEW else 0
        n = len(texts)
        for step in range(together):
            while lengths[n - 1] <= step:
                n -= 1
            symbols = flat[starts[:n] + step]
            own = state[:, :n]
            high = symbols >= self.size if rare else None
            if rare and high.any():
                moved = self.table[own * self.size + np.where(high, RARE, symbols)]
                moved[:, high] = self._rare_moves(own[:, high], symbols[high])
            else:
                moved = self.table[own * self.size + symbols]
            ended[:, :n] += moved & 3
            state[:, :n] = moved >> 2
        table, size, most, sparse = memoryview(self.table), self.size, self.most, self.sparse
        for k in range(min(len(texts), FEW)):
            rest = texts[k][together:].tolist()
            for l, top in enumerate(self.root):
                now, count = int(state[l, k]), 0
                for s in rest:
                    if s < size:
                        move = table[now * size + s]
                    else:
                        move = sparse.get(now * most + s)
                        if move is None:
                            move = sparse.get(top * most + s, 4 * top + 1) + (now != top)
                    count += move & 3
                    now = move >> 2
                state[l, k] = now
                ended[l, k] += count
        return ended + (state != root)  # the last phrase

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        symbols = [self.symbols(t) if t else np.empty(0, np.int32) for t in texts]
        lettered = [bool((s != GAP).any()) for s in symbols]
        cost = self.phrases(symbols) * np.array(self.bits)[:, None] if self.languages else np.zeros((0, len(texts)))
        names, scores = [], []
        for k, has in enumerate(lettered):
            if not has or not self.languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            order = np.argsort(cost[:, k], kind="stable")
            best = cost[order[0], k]
            names.append(self.languages[order[0]])
            scores.append(1.0 if len(order) == 1 else float(1 - best / cost[order[1], k]))
        return names, scores


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """RARE at every letter's code point, GAP elsewhere."""
    return np.array([RARE if unicodedata.category(chr(c))[0] == "L" else GAP for c in range(0x110000)], np.uint8)


@lru_cache(maxsize=2)
def _parser(samples) -> Parser:
    return Parser(samples)


def predict(docs: DataFrame, samples: dict[str, list[str]], text: str = "text") -> DataFrame:
    """The input plus ``lang_pred`` and ``score``; only ``text`` is read."""
    frozen = tuple((name, tuple(samples[name])) for name in sorted(samples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(frozen)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                names, scores = parser.predict(part.column(text).to_pylist())
                kept = [(n, c) for n, c in zip(part.schema.names, part.columns, strict=True) if n not in ("lang_pred", "score")]
                yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*(n for n, _ in kept), "lang_pred", "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in ("lang_pred", "score")]
    return docs.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"]))


def digest(docs: DataFrame) -> DataFrame:
    samples = learn(docs)
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return predict(rows, samples).select("doc_id", "held_out", "lang_pred", "score")
