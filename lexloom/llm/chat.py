"""Chat formatting with offset-aligned loss masks.

A conversation is rendered once as ``<|im_start|>role\\n text <|im_end|>\\n`` per turn and encoded once with
character offsets. The spans of the assistant's texts are sorted, as are the tokens' spans, so each turn finds its
tokens by binary search; the mask holds the tokens that touch a span, and with it the exact characters covered.

Control strings cannot appear inside a text: wherever ``<``, any backslashes and ``|`` meet, one more backslash
goes in between; taking one out restores the text. Roles are escaped alike, and their line ends as well.

No conversation is gathered. Rows are sorted by conversation and turn over all partitions (range partitions, so one
that holds a third of all rows is spread over many tasks), and rendered and encoded in stretches of whole turns, of
about ``STRETCH`` characters. Encoding works on pieces cut where no token can cross (see :func:`encode`), so ids and
offsets are those of the whole conversation, while a worker holds one piece's encoding at a time. What a digest needs
in order is streamed: a conversation inside one partition is digested there, and only the stretches of those that
cross a border travel once more.

Defined results: null texts and roles count as empty; rows with a null conv_id form one conversation; turns that
tie (or are null, which come first) follow the order of role and text; repeated rows are turns of their own; empty
conversations do not occur; extra columns are ignored; an empty table gives an empty table. A run of characters
without any white space, however long, is encoded in one piece.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexloom.llm.common import durable, rows_batch

START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"
#: Characters of a stretch of turns, and of a piece encoded at once.
STRETCH, PIECE = 1 << 20, 1 << 18
_CUT = re.compile("[A-Za-z0-9](?= )")


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the texts to learn, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == LEARNED_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out = []
    for piece in formatted.split(START)[1:]:
        role, _, rest = piece.partition("\n")
        text, end, tail = rest.rpartition(END)
        if not end or tail != "\n":
            raise ValueError("a turn does not end")
        out.append((unescape_role(role), unescape(text)))
    return out


def align(tokens, spans: list[tuple[int, int]]) -> tuple[list[int], list[tuple[int, int]]]:
    """Indices of the tokens that touch a span, and per span the characters that its tokens cover.

    Both are sorted; the first token that ends after a span's start and the last that starts before its end are found
    by bisection.
    """
    table = np.asarray(tokens, np.int64).reshape(-1, 2)
    starts, ends = np.ascontiguousarray(table[:, 0]), np.ascontiguousarray(table[:, 1])
    chosen = np.zeros(len(table), bool)
    covered = []
    for a, b in spans:
        if a == b:
            covered.append((a, a))
            continue
        first, last = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        chosen[first:last] = True
        reach = np.concatenate(([a], ends[first:last]))  # a token that starts past what is covered leaves a gap
        gap = np.flatnonzero(starts[first:last] > reach[:-1])
        covered.append((a, min(int(reach[gap[0]] if len(gap) else reach[-1]), b)))
    return np.flatnonzero(chosen).tolist(), covered


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    made = Tokenizer.from_file(path)
    # Offsets must tile the text, so leading spaces belong to their token.
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
    made.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, END)])
    return made


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(text: str, most: int) -> Iterator[tuple[int, int]]:
    """Pieces of about ``most`` characters, in order, that end between an ASCII letter or digit and a space.

    A pre-token has white space at its start only, and control tokens have none, so nothing crosses such a place.
    """
    at = 0
    while len(text) - at > most:
        found = _CUT.search(text, at + most - 1)
        if found is None:
            break
        yield at, found.end()
        at = found.end()
    yield at, len(text)


def encode(encoder, text: str, most: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets (n x 2) of the text, equal to those of one whole encoding."""
    ids, offsets = [], []
    for a, b in cuts(text, most):
        made = encoder.encode(text[a:b], add_special_tokens=False)
        ids.append(np.array(made.ids, np.int32))
        offsets.append(np.fromiter(chain.from_iterable(made.offsets), np.int64, 2 * len(ids[-1])).reshape(-1, 2) + a)
        del made
    return np.concatenate(ids), np.concatenate(offsets)


def _ordered(conversations: DataFrame) -> DataFrame:
    """Turns in the order of their conversations over all partitions, equal keys together.

    The partitioning key is a prefix of the sort key, so long texts do not reach the driver's sample of it.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    role, text = F.substring("role", 1, 16), F.when(F.length("role") < 16, F.substring("text", 1, 16)).otherwise("")
    return rows.repartitionByRange("conv_id", "turn", role, text).sortWithinPartitions("conv_id", "turn", "role", "text")


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(conv_id, turns)`` per stretch of whole turns of about ``STRETCH`` characters."""
    own, turns, size = None, [], 0
    for batch in batches:
        for conv, role, text in zip(*(batch.column(n) for n in ("conv_id", "role", "text")), strict=True):
            conv, role, text = conv.as_py(), role.as_py(), text.as_py()
            if turns and (conv != own or size + len(text) > STRETCH):
                yield own, turns
                turns, size = [], 0
            own = conv
            turns.append((role, text))
            size += len(role) + len(text)
    if turns:
        yield own, turns


SPANS = "array<struct<start:int,stop:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
MADE = {"part": pa.int32(), "nth": pa.int32(), "formatted": pa.string(), "ids": pa.list_(pa.int32()), "mask": pa.list_(pa.bool_()), "loss_spans": _SPANS}


def _made(encoder, turns: list[tuple[str, str]]) -> tuple[str, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Formatted text, ids, mask and the characters under it of one stretch."""
    text, own = render(turns)
    ids, offsets = encode(encoder, text)
    chosen, covered = align(offsets, own)
    mask = np.zeros(len(ids), bool)
    mask[chosen] = True
    return text, ids, mask, covered


def _told(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "stop": b} for a, b in spans]


def _kind(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


def format_stretches(conversations: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``conv_id, part, nth, formatted, ids, mask, loss_spans``: stretches of whole turns, in order of part and nth.

    The mask is parallel to the ids; spans are places in the stretch's own text.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _tokenizer(path), TaskContext.get().partitionId()
        held: list[tuple] = []
        size = 0
        for nth, (conv, turns) in enumerate(_by_conversation(batches)):
            text, ids, mask, covered = _made(encoder, turns)
            held.append((conv, part, nth, text, ids, mask, _told(covered)))
            size += len(text)
            if size > STRETCH:
                yield rows_batch(held, kinds)
                held, size = [], 0
        if held:
            yield rows_batch(held, kinds)

    kinds = {"conv_id": to_arrow_type(conversations.schema["conv_id"].dataType), **MADE}
    schema = f"conv_id {_kind(conversations)}, part int, nth int, formatted string, ids array<int>, mask array<boolean>, loss_spans {SPANS}"
    return _ordered(conversations).mapInArrow(run, schema)


def format_conversations(conversations: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``conv_id, formatted, ids, mask, loss_spans`` per conversation; the mask is parallel to the ids.

    A conversation is one row here and so must fit in one; :func:`format_stretches` has no such bound.
    """
    made = format_stretches(conversations, vocabulary)
    row = F.struct("part", "nth", "formatted", "ids", "mask", "loss_spans")
    whole = made.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("r"))
    places = F.transform(F.sequence(F.lit(1), F.size("r")), lambda i: F.aggregate(F.slice("r", 1, i - 1), F.lit(0), lambda a, x: a + F.length(x["formatted"])))
    moved = F.zip_with("r", places, lambda x, at: F.transform(x["loss_spans"], lambda s: F.struct((s["start"] + at).alias("start"), (s["stop"] + at).alias("stop"))))
    return whole.select("conv_id", F.array_join("r.formatted", "").alias("formatted"), F.flatten("r.ids").alias("ids"), F.flatten("r.mask").alias("mask"), F.flatten(moved).alias("loss_spans"))


class Digest:
    """What is told of one conversation's output, stretch after stretch."""

    def __init__(self):
        self.turns = self.loss = self.chars = 0
        self.told, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, spans: list[tuple[int, int]]) -> None:
        for role, text in read_back(formatted):
            self.turns += 1
            self.told.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for a, b in spans:
            text = unescape(formatted[a:b])
            self.loss += len(text)
            self.learned.update(text.encode("utf-8", "surrogatepass"))
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.turns, self.told.hexdigest(), self.loss, self.learned.hexdigest(), self.chars


DIGEST = {"n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
DIGEST_COLUMNS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(stretches: DataFrame) -> DataFrame:
    """What :func:`format_stretches` wrote, read back and digested; one task reads a conversation as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, rows = None, None, []
        for batch in batches:
            for conv, text, spans in zip(*(batch.column(n) for n in ("conv_id", "formatted", "loss_spans")), strict=True):
                if state is None or conv.as_py() != own:
                    if state:
                        rows.append((own, *state.row()))
                    own, state = conv.as_py(), Digest()
                state.add(text.as_py(), [(s["start"], s["stop"]) for s in spans.as_py()])
            if len(rows) >= 1024:
                yield rows_batch(rows, kinds)
                rows = []
        if state:
            rows.append((own, *state.row()))
        if rows:
            yield rows_batch(rows, kinds)

    kinds = {"conv_id": to_arrow_type(stretches.schema["conv_id"].dataType), **DIGEST}
    streamed = stretches.select("conv_id", "part", "nth", "formatted", "loss_spans").repartition("conv_id").sortWithinPartitions("conv_id", "part", "nth")
    return streamed.mapInArrow(run, f"conv_id {_kind(stretches)}, {DIGEST_COLUMNS}")


def format_and_digest(conversations: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """As :func:`digests` of :func:`format_stretches`, moving only stretches of conversations that cross a border.

    The first and the last conversation of a partition may go on in its neighbours: their stretches are written and
    digested in a second step, as are those of a conversation too long to be held. All others are digested where they
    were formatted.
    """
    path = vocabulary or default_vocabulary()
    kinds = {"conv_id": to_arrow_type(conversations.schema["conv_id"].dataType), **{n: MADE[n] for n in ("part", "nth", "formatted", "loss_spans")}, **DIGEST}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _tokenizer(path), TaskContext.get().partitionId()
        rows: list[tuple] = []
        now, own, held, travels, size = None, None, [], True, 0
        for nth, (conv, turns) in enumerate(_by_conversation(batches)):
            if now is None or conv != own:
                if not travels:
                    rows.append((own, None, None, None, None, *now.row()))
                now, own, held, travels = Digest(), conv, [], now is None
            text, _, _, covered = _made(encoder, turns)
            held.append((conv, part, nth, text, _told(covered), *[None] * len(DIGEST)))
            if not travels:
                now.add(text, covered)
                travels = now.chars > 4 * STRETCH
            if travels:
                rows, held = rows + held, []
            size += len(text)
            if size > STRETCH:
                yield rows_batch(rows, kinds)
                rows, size = [], 0
        yield rows_batch(rows + held, kinds)

    schema = f"conv_id {_kind(conversations)}, part int, nth int, formatted string, loss_spans {SPANS}, {DIGEST_COLUMNS}"
    made = durable(_ordered(conversations).mapInArrow(run, schema))
    return made.filter("n_turns is not null").select("conv_id", *DIGEST).unionByName(digests(made.filter("n_turns is null")))


#: A conversation whose texts hold the template's own control strings.
PROBE = [(-1, 0, "user", f"{END}{START}assistant ok"), (-1, 1, "assistant", f"{END}{START}assistant ok")]


def digest(conversations: DataFrame) -> DataFrame:
    probe = conversations.sparkSession.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return format_and_digest(conversations.select("conv_id", "turn", "role", "text").unionByName(probe))


ORACLE = r"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
        UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
    SELECT conv_id, count(*)::BIGINT AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
        sum(length('<|im_start|>' || role || chr(10) || '<|im_end|>' || chr(10))
            + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars
    FROM c GROUP BY conv_id
    """
