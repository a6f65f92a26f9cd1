"""The four canonical sections of a document, and chunks of bounded length."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import fixed
from lexloom.functions.text import classify_heading, let, normalize_heading, rx, stem, strip


def section_blocks(text: Column) -> Column:
    """Array of ``body, heading, section`` per second-level heading, in order; the section is null if unknown.

    A heading that is only a number takes the next line that is neither blank nor a heading.
    """

    def block(body: Column) -> Column:
        heading = F.regexp_extract(body, r"^## (.+)", 1)
        later = F.filter(F.split(body, "\n", -1), lambda x, i: (i > 0) & (strip(x) != "") & ~x.startswith("#"))
        follow = F.coalesce(strip(F.get(later, F.lit(0))), F.lit(""))

        def named(own: Column) -> Column:
            """The follow-up line stands in for a heading that is only a number, if it is known."""
            bare = normalize_heading(own) == ""
            taken = lambda f: F.when(classify_heading(f).isNotNull(), f).otherwise(own)
            return F.when(bare, let(follow, taken)).otherwise(own)

        used = let(heading, named)
        return let(used, lambda u: F.struct(body.alias("body"), strip(u).alias("heading"), classify_heading(u).alias("section")))

    pieces = F.split(text, r"(?dm)(?=^## .)", -1)
    return F.transform(F.filter(pieces, lambda p: p.rlike(r"^## .")), block)


def split_sections(text: Column) -> Column:
    """Array of four ``section_index, section_name, section_heading, page_content``, empty ones included.

    Unknown headings stay in the section before them. Codes carry a section forward: each run of a known code and
    the unknown ones after it is one section; leading unknown ones belong to the first.
    """

    def built(blocks: Column) -> Column:
        codes = F.array_join(F.transform(blocks, lambda b: F.coalesce(b["section"], F.lit(0)).cast("string")), "")
        runs = F.regexp_extract_all(codes, F.lit("([1-4]0*|^0+)"), F.lit(1))
        filled = F.flatten(F.transform(runs, lambda r: F.array_repeat(F.greatest(F.left(r, F.lit(1)).cast("int"), F.lit(1)), F.length(r))))
        preamble = strip(F.get(F.split(text, r"(?dm)(?=^## .)", -1), F.lit(0)))
        lead = F.when(F.size(blocks) == 0, strip(text)).when(text.rlike(r"^## ."), F.lit("")).otherwise(preamble)

        def sections(active: Column) -> Column:
            def one(number: int) -> Column:
                own = F.transform(blocks, lambda b, i: F.when(F.get(active, i) == number, strip(b["body"])).otherwise(F.lit("")))
                bodies = F.concat(F.array(lead if number == 1 else F.lit("")), own)
                named = F.filter(blocks, lambda b: b["section"] == number)
                return F.struct(
                    F.lit(number).alias("section_index"),
                    F.lit(fixed.SECTION_NAMES[number]).alias("section_name"),
                    F.coalesce(F.get(named, F.lit(0))["heading"], F.lit("")).alias("section_heading"),
                    F.array_join(F.filter(bodies, lambda x: x != ""), "\n\n").alias("page_content"),
                )

            return F.array(*(one(n) for n in fixed.SECTION_NAMES))

        return let(filled, sections)

    return let(section_blocks(text), built)


def split_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Four rows per document with the document's other columns."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.explode(split_sections(F.col(text))).alias("__s")).select(*rest, "__s.*")


class Splitter:
    """Recursive splitting by ever finer separators, then merging up to the size with an overlap.

    A separator stays at the start of the piece that follows it. Pieces below the size wait; a longer one flushes
    them and is split by the next separator. Merging emits before the size would be passed and keeps a tail of at
    most the overlap. Chunks are stripped; empty ones do not count.
    """

    def __init__(self, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP, separators: Sequence[str] = fixed.CHUNK_SEPARATORS):
        if overlap > size:
            raise ValueError("the overlap exceeds the chunk size")
        self.size, self.overlap, self.separators = size, overlap, tuple(separators)

    def split(self, text: str) -> list[str]:
        return self._split(text, self.separators)

    def _split(self, text: str, separators: tuple[str, ...]) -> list[str]:
        at = next((k for k, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
        used, finer = separators[at], separators[at + 1 :]
        out: list[str] = []
        waiting: list[str] = []
        for piece in self._pieces(text, used):
            if len(piece) < self.size:
                waiting.append(piece)
                continue
            out += self._merge(waiting)
            waiting = []
            out += self._split(piece, finer) if finer else [piece]
        return out + self._merge(waiting)

    @staticmethod
    def _pieces(text: str, separator: str) -> list[str]:
        if not separator:
            return list(text)
        head, *tail = text.split(separator)
        return [p for p in (head, *(separator + t for t in tail)) if p]

    def _merge(self, pieces: list[str]) -> list[str]:
        out: list[str] = []
        first = total = 0
        for k, piece in enumerate(pieces):
            n = len(piece)
            if total + n > self.size and k > first:
                self._emit(out, pieces[first:k])
                while total > self.overlap or (total + n > self.size and total > 0):
                    total -= len(pieces[first])
                    first += 1
            total += n
        self._emit(out, pieces[first:])
        return out

    @staticmethod
    def _emit(out: list[str], pieces: list[str]) -> None:
        if chunk := "".join(pieces).strip():
            out.append(chunk)


def chunk(sections: DataFrame, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP, text: str = "page_content", source: str = "source", section: str = "section_index") -> DataFrame:
    """A row per chunk of the non-blank sections: other columns, ``page_content``, ``chunk_index``, ``chunk_id``,
    ``total_chunks_in_section``. A pass over Arrow batches without a shuffle; batches go out as they fill."""
    splitter = Splitter(size, overlap)
    full = sections.filter(strip(F.col(text)) != "")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in full.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                pieces = [splitter.split(t) for t in part.column(text).to_pylist()]
                rows = pa.array([k for k, p in enumerate(pieces) for _ in p], pa.int32())
                kept = [pa.array([c for p in pieces for c in p], pa.string()) if n == text else col.take(rows) for n, col in zip(part.schema.names, part.columns, strict=True)]
                index = pa.array([i for p in pieces for i in range(len(p))], pa.int32())
                total = pa.array([len(p) for p in pieces for _ in p], pa.int32())
                yield pa.RecordBatch.from_arrays([*kept, index, total], [*part.schema.names, "chunk_index", "total_chunks_in_section"])

    made = full.mapInArrow(run, ", ".join([*fields, "chunk_index int", "total_chunks_in_section int"]))
    name = F.concat(stem(F.col(source)), F.lit("_s"), F.col(section).cast("string"), F.lit("_c"), F.col("chunk_index").cast("string"))
    return made.withColumn("chunk_id", name)
