"""Document clean-up as column expressions, so that twelve steps still run in one stage without a shuffle.

Sequential rules become regular expressions over code strings with one character per line or paragraph: greedy,
non-overlapping, left to right, which is what a global replacement does.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import fixed
from lexloom.functions.text import (
    ODD_LETTERS, clean_markdown, fix_ocr_chars, let, lines, normalize_furniture_line, paragraphs, remove_footnote_numbers, rx, strip,
)


def _joined(parts: Column, separator: str = "\n") -> Column:
    return F.array_join(parts, separator)


def _share(part: Column, whole: Column) -> Column:
    return part.cast("double") / whole


def remove_noisy_lines(text: Column, ratio: float = fixed.NOISE_RATIO) -> Column:
    def kept(s: Column) -> Column:
        symbols = F.length(s) - F.length(F.regexp_replace(s, rx(r"[^\p{L}\p{N}\s]+"), ""))
        prose = ~s.rlike(rx(fixed.INSTITUTIONAL_NOISE)) & (_share(symbols, F.length(s)) < ratio)
        return (s == "") | s.rlike(rx(fixed.MARKDOWN_STRUCTURE)) | prose

    return _joined(F.filter(lines(text), lambda line: let(strip(line), kept)))


def strip_frontmatter_noise(text: Column) -> Column:
    """Junk lines go before the first second-level heading, if that is the third line or later."""

    def kept(s: Column) -> Column:
        letters = F.length(s) - F.length(F.regexp_replace(s, r"\p{L}+", ""))
        return (s == "") | (~s.rlike(rx(fixed.FRONT_JUNK)) & (_share(letters, F.length(s)) >= fixed.FRONT_LETTER_RATIO))

    def after(ls: Column) -> Column:
        def before(first: Column) -> Column:
            return F.when(first < 2, text).otherwise(_joined(F.filter(ls, lambda x, i: (i >= first) | let(strip(x), kept))))

        return let(F.array_position(F.transform(ls, lambda x: strip(x).startswith("## ")), True) - 1, before)

    return let(lines(text), after)


def remove_figure_legends(text: Column) -> Column:
    connector = rx(r"(?i)\b(" + "|".join(fixed.CONNECTORS) + r")\b")

    def kept(paragraph: Column) -> Column:
        def judged(ls: Column) -> Column:
            short = F.size(F.filter(ls, lambda x: F.length(x) < fixed.LEGEND_LINE_LENGTH))
            legend = (F.size(ls) >= fixed.LEGEND_LINES) & (short >= fixed.LEGEND_LINES) & (_share(short, F.size(ls)) >= fixed.LEGEND_SHARE)
            return ~legend | _joined(ls, " ").rlike(connector)

        return let(F.filter(F.transform(lines(paragraph), strip), lambda x: x != ""), judged)

    return _joined(F.filter(paragraphs(text), kept), "\n\n")


#: Every rule needs one of these in its line, in lower case, or a number at the start, so a line without any is spared the rules.
REFERENCE_HINTS = (
    "ver", "folio", "cuaderno", "archivo", "expediente", "http", "drive", "sharepoint", "pdf", "radicaci", "demanda", "ponente",
    "magistrad", "secretari", "medio", "pag", "pág",
)


def _needed(pattern: str) -> str | None:
    """A word, in lower case, that a rule needs."""
    if pattern.endswith(r"\s*:"):
        return ":"
    words = ("pdf", "folio", "archivo", "electr", "http", "ver", "cuaderno", "expediente", "medio")
    return None if "|" in pattern else next((w for w in words if w in pattern), None)


def _numbered(pattern: str) -> bool:
    """Whether a rule is for lines that start with a number."""
    return re.match(r"(\(\?i\))?\^\\s\*\\d\{1,2\}", pattern) is not None


def reference_score(line: Column) -> Column:
    """Points of the rules table, and one more for a short line that has any."""

    def scored(s: Column, low: Column, odd: Column, numbered: Column) -> Column:
        points = F.lit(0)
        for pattern, value, stripped, below in fixed.REFERENCE_RULES:
            hit = (s if stripped else line).rlike(rx(pattern))
            word = _needed(pattern)
            hit = (low.contains(word) | odd) & hit if word else hit
            hit = numbered & hit if _numbered(pattern) else hit
            points = points + F.when(hit & (F.length(s) < below) if below else hit, value).otherwise(0)
        return let(points, lambda p: p + F.when((p > 0) & (F.length(s) < fixed.REFERENCE_SHORT_LINE), 1).otherwise(0))

    def judged(low: Column, odd: Column, numbered: Column) -> Column:
        hinted = odd | numbered
        for word in REFERENCE_HINTS:
            hinted = hinted | low.contains(word)
        return F.when(hinted, let(strip(line), lambda s: scored(s, low, odd, numbered))).otherwise(F.lit(0))

    numbered = F.regexp_extract(line, rx(r"^(\s*\d)?"), 1) != ""
    return let(F.lower(line), lambda low: let(line.rlike(ODD_LETTERS), lambda odd: let(numbered, lambda n: judged(low, odd, n))))


def is_internal_reference(line: Column) -> Column:
    return reference_score(line) >= fixed.REFERENCE_THRESHOLD


def remove_internal_references(text: Column) -> Column:
    text = F.regexp_replace(text, rx(fixed.PAGE_LEAD), "$1")
    return _joined(F.filter(lines(text), lambda x: ~is_internal_reference(x)))


def remove_citation_blocks(text: Column, reach: int = fixed.CITATION_REACH) -> Column:
    """Anchors go, and what follows them within reach until a break.

    Codes: A anchor, B break, E blank, N other. A paragraph goes if the codes up to it, the last ``reach + 1`` of
    them, end in an anchor, then only N and E, then itself as N.
    """

    def code(s: Column) -> Column:
        marked = s.startswith("#") | s.startswith("|")
        numbered = s.rlike(rx(r"^\d{1,3}\.\s"))
        short = F.length(s) < fixed.CITATION_SHORT
        return (
            F.when(s == "", "E")
            .when(s.rlike(rx(fixed.CITATION_ANCHOR)) & ~marked, "A")
            .when(marked | numbered | ~(s.rlike(rx(fixed.CITATION_FRAGMENT)) | short), "B")
            .otherwise("N")
        )

    def kept(ps: Column) -> Column:
        def by(codes: Column) -> Column:
            def goes(i: Column) -> Column:
                seen = F.substring(codes, F.greatest(i - (reach - 1), F.lit(1)), F.least(i + 1, F.lit(reach + 1)))
                return seen.rlike("(A|A[NE]*N)$")

            return F.filter(ps, lambda p, i: ~goes(i))

        return _joined(let(_joined(F.transform(ps, lambda p: let(strip(p), code)), ""), by), "\n\n")

    return let(paragraphs(text), kept)


def _merge_pairs(parts: Column, should: "callable", merged: "callable") -> Column:
    """Greedy merging of neighbours, a merged pair not looked at again.

    ``should`` sees stripped parts. The code string has 1 where part i should take part i + 1; replacing ``1.`` by ``MS`` walks it as the greedy
    rule does: M takes its successor, S is the one taken.
    """

    def by(ps: Column) -> Column:
        def codes(bare: Column) -> Column:
            pair = lambda a, i: let(F.get(bare, i + 1), lambda b: F.coalesce(should(a, b), F.lit(False)))
            return _joined(F.transform(bare, lambda a, i: F.when(pair(a, i), "1").otherwise("0")), "")

        acts = F.regexp_replace(let(F.transform(ps, strip), codes), "1.", "MS")

        def act(a: Column) -> Column:
            at = lambda i: F.substring(a, i + 1, F.lit(1))
            made = F.transform(ps, lambda p, i: F.when(at(i) == "M", merged(p, F.get(ps, i + 1))).when(at(i) == "S", F.lit(None)).otherwise(p))
            return F.array_compact(made)

        return let(acts, act)

    return let(parts, by)


def _starts_lower(text: Column) -> Column:
    return F.left(text, F.lit(1)).rlike(r"^\p{javaLowerCase}")


def _last(text: Column) -> Column:
    return F.right(text, F.lit(1))


def is_enumeration(line: Column) -> Column:
    return line.rlike(rx(fixed.ENUMERATION))


def is_decision_start(line: Column) -> Column:
    return line.rlike(rx(fixed.DECISION_START))


def repair_layout_breaks(text: Column) -> Column:
    def should(a: Column, b: Column) -> Column:
        special = a.rlike(r"^[#\-*•]") | is_enumeration(a) | is_decision_start(a)
        # The cheap tests come first; few lines reach the patterns.
        return _starts_lower(b) & (a != "") & ~_last(a).isin(*".;:!?\"')") & ~special & ~is_enumeration(b) & ~is_decision_start(b)

    return _joined(_merge_pairs(lines(text), should, lambda a, b: F.concat(strip(a), F.lit(" "), strip(b))))


#: Longer than any word that leaves a paragraph dangling, so its start is seen within the window.
DANGLING_WINDOW = 16


def reconstruct_paragraphs(text: Column, passes: int = 3) -> Column:
    def should(a: Column, b: Column) -> Column:
        barred = a.startswith("#") | b.startswith("#") | b.rlike(rf"^(- \?|[*\-]\s+[{fixed.UPPER_LETTERS}]|\p{{Nd}}[.)])")
        closed = F.substring(a, -3, 3).rlike(rx(r"[.;:?!]['’”\"]\s*$"))
        unended = ~_last(a).isin(*".;:?!\"')»")
        lower = _starts_lower(b)
        joins = (
            (unended & lower)
            | (unended & b.startswith("-") & b.rlike(rx(rf"^-\s+[{fixed.LOWER_LETTERS}]")))
            | (a.endswith(",") & lower)
            | F.right(a, F.lit(DANGLING_WINDOW)).rlike(rx(fixed.DANGLING_TAIL))
        )
        return joins & ~barred & ~closed

    text = F.regexp_replace(text, rf"([{fixed.LETTERS}])-\n([{fixed.LOWER_LETTERS}])", "$1$2")
    parts = F.filter(paragraphs(text), lambda p: strip(p) != "")
    for _ in range(passes):
        parts = _merge_pairs(parts, should, lambda a, b: F.concat(strip(a), F.lit(" "), strip(b)))
    return _joined(parts, "\n\n")


def remove_repeated_blocks(text: Column) -> Column:
    """Every copy of a paragraph that occurs twice goes, the first too; found by sorting, not by comparing all."""

    def kept(ps: Column) -> Column:
        norm = lambda p: strip(F.regexp_replace(p, r"!\[[^\]]*\]\([^)]+\)", ""))

        def single(s: Column) -> Column:
            twin = lambda x, i: (x["n"] == F.get(s, i - 1)["n"]) | (x["n"] == F.get(s, i + 1)["n"])
            alone = F.filter(s, lambda x, i: (x["n"] == "") | ~F.coalesce(twin(x, i), F.lit(False)))
            return F.array_sort(F.transform(alone, lambda x: x["i"]))

        ordered = F.sort_array(F.transform(ps, lambda p, i: F.struct(norm(p).alias("n"), i.alias("i"))))
        return _joined(F.transform(let(ordered, single), lambda i: F.get(ps, i)), "\n\n")

    return let(paragraphs(text), kept)


def split_pages(text: Column) -> Column:
    """Pages at explicit marks if these give three, else bins that close once they exceed the page length."""

    def marked(pages: Column) -> Column:
        return F.when(F.size(pages) >= 3, pages).otherwise(let(paragraphs(text), binned))

    def binned(ps: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.array(F.lit(0)).alias("cuts"))

        def step(acc: Column, p: Column) -> Column:
            size = acc["size"] + F.length(p)
            full = size > fixed.PAGE_CHARS
            return F.struct(
                (acc["n"] + 1).alias("n"),
                F.when(full, 0).otherwise(size).alias("size"),
                F.when(full, F.concat(acc["cuts"], F.array(acc["n"] + 1))).otherwise(acc["cuts"]).alias("cuts"),
            )

        def cut(cuts: Column) -> Column:
            ends = F.array_distinct(F.concat(cuts, F.array(F.size(ps))))
            return F.transform(
                F.sequence(F.lit(0), F.size(ends) - 2),
                lambda i: _joined(F.slice(ps, F.get(ends, i) + 1, F.get(ends, i + 1) - F.get(ends, i)), "\n\n"),
            )

        return let(F.aggregate(ps, start, step, lambda a: a["cuts"]), cut)

    return let(F.split(text, rx(fixed.PAGE_MARK), -1), marked)


def repeated_furniture(pages: Column, share: float = fixed.FURNITURE_SHARE) -> Column:
    """Sorted normal forms of lines at page tops and bottoms that recur over enough pages."""

    def ends(page: Column) -> Column:
        def both(ls: Column) -> Column:
            four = F.concat(F.slice(ls, 1, 2), F.slice(ls, -2, 2))
            return F.when(F.size(ls) >= 4, four).otherwise(F.array().cast("array<string>"))

        return let(F.filter(F.transform(lines(page), strip), lambda x: x != ""), both)

    def often(found: Column) -> Column:
        return F.filter(F.array_distinct(found), lambda x: F.size(F.filter(found, lambda y: y == x)) >= F.size(pages) * F.lit(share))

    norms = F.transform(F.flatten(F.transform(pages, ends)), normalize_furniture_line)
    fit = F.filter(norms, lambda x: F.length(x).between(4, 149))
    return F.when(F.size(pages) < 3, F.array().cast("array<string>")).otherwise(F.array_sort(let(fit, often)))


def remove_furniture(text: Column, furniture: Column) -> Column:
    kept = _joined(F.filter(lines(text), lambda x: ~F.array_contains(furniture, normalize_furniture_line(x))))
    return F.when(F.size(furniture) == 0, text).otherwise(kept)


#: The clean-up steps in their order, which matters; images need files and are a table operator.
STEPS = (
    ("frontmatter", strip_frontmatter_noise),
    ("ocr", fix_ocr_chars),
    ("noisy_lines", remove_noisy_lines),
    ("layout", repair_layout_breaks),
    ("references", remove_internal_references),
    ("citation_blocks", remove_citation_blocks),
    ("legends", remove_figure_legends),
    ("paragraphs", reconstruct_paragraphs),
    ("footnotes", remove_footnote_numbers),
    ("repeats", remove_repeated_blocks),
    ("markdown", clean_markdown),
)


def adaptive_cleanup(df: DataFrame, text: str = "text", output: str = "clean") -> DataFrame:
    """All steps in order; each is a projection of its own so that no text is computed twice."""
    step = "__step"
    out = df.withColumn(step, F.col(text))
    for _, apply in STEPS:
        out = out.withColumn(step, F.explode(F.array(apply(F.col(step)))))
    return out.withColumn(output, F.col(step)).drop(step)
