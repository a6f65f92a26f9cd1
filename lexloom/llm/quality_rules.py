"""Rule-based document quality, compiled from a threshold table into one projection (native).

Defined results: a null text counts as empty, so it has no words and fails the base rule; a null doc_id is
passed through; repeated rows get equal results; extra columns of the input are ignored by the query and kept
by :func:`filter_quality`; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import SPACE, let, packed, unpacked, words

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the languages served, in lower case; the capitalised form counts as well.
STOP_WORDS = {
    "en": "the of and to in is that it for on with as was be by are this at from or an not but have a",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o este",
    "fr": "de la le et les des en un une du que est dans qui par pour au sur pas plus ce il avec la",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an",
}


@dataclass(frozen=True)
class Rule:
    """Passes while ``low <= 1000 * numerator / denominator <= high``; a missing bound is open."""

    name: str
    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None

    def sql(self) -> str:
        """An integer comparison that Spark and other engines evaluate alike."""
        parts = []
        if self.low is not None:
            parts.append(f"1000 * {self.numerator} >= {self.low} * {self.denominator}")
        if self.high is not None:
            parts.append(f"1000 * {self.numerator} <= {self.high} * {self.denominator}")
        return "(" + " AND ".join(parts) + ")"


#: The method's verdict; bounds are per mille.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2000, 14000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("shouting", "n_upper", "word_chars", None, 400),
    Rule("stop_words", "n_stop", "n_words", 20, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 500),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 900),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 300),
)

BASE_FAILED = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"


def verdict_sql(rules: tuple[Rule, ...] = RULES) -> str:
    return f"(NOT {BASE_FAILED} AND " + " AND ".join(r.sql() for r in rules) + ")"


def stop_forms() -> list[str]:
    plain = sorted({w for line in STOP_WORDS.values() for w in line.split()})
    return sorted({f for w in plain for f in (w, w[:1].upper() + w[1:])})


def _repeated_words(w: Column, window: int) -> Column:
    """Words covered by windows that occur at least twice; linear but for the sort of texts with repeats."""

    def covered(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twin(s: Column) -> Column:
            return F.array_sort(
                F.array_compact(
                    F.transform(
                        s,
                        lambda x, i: F.when(
                            (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"]
                        ),
                    )
                )
            )

        def total(p: Column) -> Column:
            gaps = F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(window)), F.lit(window)))
            return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

        repeated = let(let(order, twin), total)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(repeated)

    starts = F.sequence(F.lit(1), F.size(w) - (window - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, window)))
    return F.when(F.size(w) < window, F.lit(0)).otherwise(let(hashes, covered))


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def measure(df: DataFrame, text: str = "text", output: str = "quality") -> DataFrame:
    """The input with one struct column of counts, replacing any of its name; built-in expressions, no shuffle."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    forms = stop_forms()

    def lines_of(x: Column) -> Column:
        full = F.filter(F.split(x, "\n"), lambda l: F.length(F.translate(l, SPACE, "")) > 0)
        return let(
            full,
            lambda ls: F.struct(
                F.size(ls).cast("long").alias("n_lines"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                F.size(F.filter(ls, lambda l: F.btrim(l, F.lit(SPACE)).rlike("^[-*•●▪]")))
                .cast("long").alias("n_bullet_lines"),
                F.size(F.filter(ls, lambda l: F.btrim(l, F.lit(SPACE)).rlike("(\\.\\.\\.|…)$")))
                .cast("long").alias("n_ellipsis_lines"),
            ),
        )

    def words_of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x: x.isin(forms))).cast("long").alias("n_stop"),
            _repeated_words(w, WINDOW).cast("long").alias("n_repeat_words"),
        )

    stats = F.struct(
        (F.length(t) - _without(t, SPACE)).cast("long").alias("word_chars"),
        _without(t, SYMBOLS).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        let(words(t), words_of).alias("w"),
        lines_of(t).alias("l"),
    )
    # A generator gives one evaluation of the struct whatever reads its fields later.
    out = packed(df, s=F.explode(F.array(stats)))
    s = F.col("s")
    fields = [s["word_chars"], s["n_symbols"], s["n_upper"], *(s["w"][x] for x in ("n_words", "n_stop", "n_repeat_words"))]
    names = ["word_chars", "n_symbols", "n_upper", "n_words", "n_stop", "n_repeat_words"]
    lines = ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines")
    quality = F.struct(*(f.alias(n) for f, n in zip(fields, names, strict=True)), *(s["l"][x].alias(x) for x in lines))
    return out.select(*(F.col("row").getField(c).alias(c) for c in df.columns if c != output), quality.alias(output))


def _on_struct(sql: str, output: str = "quality") -> str:
    names = {r.numerator for r in RULES} | {r.denominator for r in RULES} | {"n_words", "n_repeat_words"}
    for name in sorted(names):
        sql = sql.replace(name, f"{output}.{name}")
    return sql


def score(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``measure`` plus ``base_failed`` and ``kept``."""
    return measure(df, text).withColumns(
        {"base_failed": F.expr(_on_struct(BASE_FAILED)), "kept": F.expr(_on_struct(verdict_sql(rules)))}
    )


def filter_quality(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of the input that pass, with the input's columns."""
    measured = measure(packed(df, text=F.col(f"`{text}`")))
    return unpacked(measured.filter(_on_struct(verdict_sql(rules))), df.columns)


def digest(docs: DataFrame) -> DataFrame:
    q = F.col("quality")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    scored = score(docs.select("doc_id", "text"))
    return scored.select("doc_id", *(q[n].alias(n) for n in names), "base_failed", "kept")


def oracle() -> str:
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in stop_forms())
    space = r"[\x20\x09-\x0D]"
    return f"""
    WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, list_filter(string_split_regex(text, '{space}+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
    g AS (SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS gram
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
    c AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
    r AS (SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n_repeat_words
        FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM c) GROUP BY rid),
    m AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(text, '{space}', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
        len(regexp_extract_all(text, '\\p{{Lu}}'))::BIGINT AS n_upper,
        len(list_filter(ws, lambda x: x IN ({stop})))::BIGINT AS n_stop,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        len(list_filter(ls, lambda x: regexp_matches(x, '^{space}*[-*•●▪]')))::BIGINT AS n_bullet_lines,
        len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…){space}*$')))::BIGINT AS n_ellipsis_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words
        FROM w LEFT JOIN r USING (rid))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        {BASE_FAILED} AS base_failed, {verdict_sql()} AS kept FROM m
    """
