"""Queries of the text operators over decorated documents, with DuckDB oracles."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lexloom.functions import fixed, text as T
from lexloom.operators import cleanup
from lexloom.plans.adapter import documents, documents_sql, quote
from lexloom.session import table

QUERIES: dict = {}
ORACLES: dict = {}

WORD = r"[^\pL\pN_]"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


# --- SQL of the oracles.


def q(pattern: str) -> str:
    return quote(pattern)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def lines(x: str) -> str:
    return rf"(CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace({x}, '\n$', ''), chr(10)) END)"


def paras(x: str) -> str:
    return f"string_split({x}, chr(10) || chr(10))"


def join(xs: str, sep: str = "chr(10)") -> str:
    return f"array_to_string({xs}, {sep})"


def full_paras(x: str) -> str:
    return f"list_filter(list_transform({paras(x)}, lambda z: {strip('z')}), lambda z: z <> '')"


def count(x: str, pattern: str) -> str:
    """Matches of a pattern; its word boundaries are made Unicode-aware where it is only words.

    RE2 knows ASCII boundaries only, so boundaries become one separator on each side, and separators are doubled
    first so that neighbours do not compete for one.
    """
    words = re.fullmatch(r"(\(\?i\))?\\b\(([\w |áéíóúüñ]+)\)\\b", pattern)
    if not words:
        return f"len(regexp_extract_all({x}, {q(pattern)}))"
    terms = words[2].replace(" ", " +")
    return f"len(regexp_extract_all(regexp_replace({x}, '({WORD})', '\\1\\1', 'g'), {q(f'{words[1] or str()}(?:^|{WORD})(?:{terms})(?:{WORD}|$)')}))"


def has_word(x: str, terms: str, flags: str = "(?i)") -> str:
    return f"regexp_matches({x}, {q(f'{flags}(^|{WORD})({terms})({WORD}|$)')})"


def rowwise(sql: str, separator: str = "\n\n") -> str:
    return f"SELECT doc_id, {sql} AS result FROM ({documents_sql(separator)})"


def over(expr, separator: str = "\n\n"):
    """A query that applies a column expression to the decorated documents."""

    def run(spark, sf_dir):
        return documents(spark, sf_dir, separator).select("doc_id", expr(F.col("text")).alias("result"))

    return run


def register(name: str, expr, oracle: str | None, separator: str = "\n\n") -> None:
    query(name, oracle and rowwise(oracle, separator))(over(expr, separator))


# --- Projections.

NORMALIZED = strip(r"regexp_replace(regexp_replace(regexp_replace(text, '[\r\x0b\x0c\x{a0}]', ' ', 'g'), '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")
register("normalize_text", T.normalize_text, NORMALIZED)


@query(
    "title_from_source",
    "SELECT doc_id, source || '_fallo_' || doc_id || '.txt' AS source, replace(source, '_', ' ') || ' fallo ' || doc_id AS title FROM documents",
)
def title_from_source(spark, sf_dir):
    path = F.concat(F.lit("/tmp/casos/"), "source", F.lit("_fallo_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    docs = table(spark, sf_dir, "documents").withColumn("p", path)
    return docs.select("doc_id", T.base_name(F.col("p")).alias("source"), T.title(F.col("p")).alias("title"))


HEADING = (
    "strip_accents(regexp_replace(regexp_replace(lower(h), '^(?:[ivxlcdm]+|[0-9]+(?:\\.[0-9]+)*)([.):\\-\\s]|$)', '\\1'), '^[.):\\-\\s]+', ''))"
)
HEADING = f"{strip(f'''regexp_replace(regexp_replace({HEADING}, '[^\\pL\\pN_\\s]', ' ', 'g'), '\\s+', ' ', 'g')''')}"


def _headings(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = F.posexplode(F.regexp_extract_all("text", F.lit(r"(?dm)^## (.+)$"), F.lit(1)))
    return docs.select("doc_id", found.alias("pos", "heading"))


_HEADINGS_SQL = f"""SELECT doc_id, unnest(range(len(hs))) AS pos, unnest(hs) AS h FROM
    (SELECT doc_id, regexp_extract_all(text, '(?m)^## (.+)$', 1) AS hs FROM ({documents_sql()}))"""


@query("heading_normalize", f"SELECT doc_id, pos::INTEGER AS pos, {HEADING} AS result FROM ({_HEADINGS_SQL})")
def heading_normalize(spark, sf_dir):
    return _headings(spark, sf_dir).select("doc_id", "pos", T.normalize_heading(F.col("heading")).alias("result"))


def _classify_sql(norm: str) -> str:
    whens = "".join(
        f" WHEN {' OR '.join(f'starts_with({norm}, {q(v)})' for v in variants)} THEN {number}" for number, variants in fixed.SECTION_VARIANTS.items()
    )
    return f"(CASE{whens} END)"


@query("section_classify", f"SELECT doc_id, pos::INTEGER AS pos, {_classify_sql('n')}::INTEGER AS section FROM (SELECT doc_id, pos, {HEADING} AS n FROM ({_HEADINGS_SQL}))")
def section_classify(spark, sf_dir):
    return _headings(spark, sf_dir).select("doc_id", "pos", T.classify_heading(F.col("heading")).alias("section"))


def _ocr_sql() -> str:
    """Boundaries through captured neighbours; each rule runs twice since neighbours may be shared."""
    edge = r"([^\pL\pN_]|$)"
    rules = [
        (rf"ci6nes{edge}", r"ciones\1"), (rf"ci6n{edge}", r"ción\1"), (rf"([{fixed.LETTERS}])6n{edge}", r"\1ón\2"),
        (rf"([{fixed.LETTERS}])6s{edge}", r"\1ós\2"), (rf"([{fixed.LOWER_LETTERS}])6([{fixed.LOWER_LETTERS}])", r"\1ó\2"),
        (rf"(^|[^\pL\pN_])0([{fixed.LOWER_LETTERS}])", r"\1o\2"), (rf"([{fixed.LOWER_LETTERS}])0{edge}", r"\1o\2"),
        (rf"(^|[^\pL\pN_])l[0O]s{edge}", r"\1los\2"), (rf"(^|[^\pL\pN_])d[0O]s{edge}", r"\1dos\2"),
        (rf"(?i)(^|[^\pL\pN_])pr[0O]ceso{edge}", r"\1proceso\2"), (rf"(?i)(^|[^\pL\pN_])c[0O]nsejo{edge}", r"\1consejo\2"),
    ]
    x = "text"
    for pattern, replacement in rules:
        for _ in range(2):
            x = f"regexp_replace({x}, {q(pattern)}, {q(replacement)}, 'g')"
    return x


register("ocr_fix", T.fix_ocr_chars, _ocr_sql())


def _footnotes_sql() -> str:
    """Numbers after words of citation are fenced off with a mark first; neighbours shared by matches need two runs."""
    letter, words = f"[{fixed.LETTERS}]", "|".join(fixed.CITATION_WORDS)
    mark, edge, after = "\x02", r"([^\pL\pN_]|$)", r"([\s.,;:!?\)\]]|$)"
    quoted = after.replace(r"\]]", "\\]\"']")
    year = r"((?:^|[^\pL\pN_])(?:1[89]\d\d|20\d\d))"
    rules = [
        (rf"(?i)((?:{words})\s+{letter}{{2,}})(\d)", rf"\1{mark}\2"), (rf"(?i)((?:^|[^{fixed.LETTERS}])(?:{words}))(\d)", rf"\1{mark}\2"),
        (rf"({letter}{{2,}})\d{{1,2}}{edge}", r"\1\2"), (mark, ""),
        (rf"(?i)((?:{words})\s+{letter}{{2,}}\s+)(\d)", rf"\1{mark}\2"), (rf"(?i)((?:^|[^{fixed.LETTERS}])(?:{words})\s+)(\d)", rf"\1{mark}\2"),
        (rf"({letter}{{2,}})\s+(?:[0-4]?\d|5[0-5]){quoted}", r"\1\2"), (mark, ""),
        (rf"([)\]’”'\"])\s+\d{{1,2}}{after}", r"\1\2"), (rf"{year}\d{edge}", r"\1\2"),
        (rf"{year}\s+\d{{1,2}}(\s*[.,;:!?\)\]]|\s+[{fixed.LOWER_LETTERS}]|\s*$)", r"\1\2"),
        (rf"((?:^|[^\pL\pN_])[A-Z][\pL\pN_-]*-\d{{2,4}})\s+\d{{1,2}}{after}", r"\1\2"),
    ]
    x = "text"
    for pattern, replacement in rules:
        for _ in range(2):
            x = f"regexp_replace({x}, {q(pattern)}, {q(replacement)}, 'g')"
    return x


register("footnote_strip", T.remove_footnote_numbers, _footnotes_sql())
_NUMBER = "list_filter(list_transform(ls[i + 1:i + 15], lambda y: regexp_extract(y, '^(\\d{1,3})\\.\\s', 1)), lambda y: y <> '')[1]::INTEGER"
_BODY = f"regexp_extract(x, {q(fixed.HEADING_BODY)}, 2)"
_SPLIT = f"""array_to_string(flatten(list_transform(ls, lambda x, i: CASE WHEN NOT regexp_matches(x, {q(fixed.HEADING_BODY)}) THEN [x]
    ELSE [regexp_extract(x, {q(fixed.HEADING_BODY)}, 1), CASE WHEN {_NUMBER} >= 2 AND NOT regexp_matches({_BODY}, '^\\d+\\.\\s') THEN ({_NUMBER} - 1) || '. ' || {_BODY} ELSE {_BODY} END] END)), chr(10))"""
_SPLIT_SQL = f"SELECT doc_id, {_SPLIT} AS result FROM (SELECT doc_id, {lines('text')} AS ls FROM ({documents_sql()}))"
query("heading_body_split", _SPLIT_SQL)(over(T.split_heading_body))
query(
    "markdown_clean",
    f"""SELECT doc_id, {strip(r"regexp_replace(regexp_replace(regexp_replace(result, '\n{3,}', chr(10) || chr(10), 'g'), '([^\n])\n(#{1,6}\s)', '\1' || chr(10) || chr(10) || '\2', 'g'), '(?m)[ \t]+$', '', 'g')")} || chr(10) AS result FROM ({_SPLIT_SQL})""",
)(over(T.clean_markdown))
register("image_refs_relative", lambda t: T.relativize_image_refs(t, "/data"), r"regexp_replace(text, '(!\[[^\]]*\]\()/data/([^)]+)\)', '\1./\2)', 'g')")
register(
    "furniture_normalize",
    lambda t: F.transform(T.lines(t), T.normalize_furniture_line),
    "list_transform(" + lines("text") + r", lambda z: lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(z, '(?i)(^|[^\pL\pN_])(pág\.?|página|page)\s*\d+($|[^\pL\pN_])', '\1\3', 'g'), '(^|[^\pL\pN_])\d{1,4}\s*$', '\1'), '^\s*\d{1,4}\s+', ''), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')))",
    "\n",
)


@query(
    "embedding_text",
    """SELECT doc_id, CASE WHEN kw IS NULL AND sm IS NULL THEN text ELSE concat_ws(chr(10), 'Palabras clave: ' || kw, 'Resumen: ' || sm) || chr(10) || chr(10) || text END AS embed_text,
    concat_ws(' ', text, kw, sm) AS bm25_text FROM
    (SELECT d.doc_id, text, CASE WHEN quality = 1 THEN lang END AS kw, CASE WHEN toxic = 0 THEN source END AS sm FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
)
def embedding_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    kw, sm = F.when(F.col("quality") == 1, F.col("lang")), F.when(F.col("toxic") == 0, F.col("source"))
    return docs.select("doc_id", T.embedding_text(F.col("text"), kw, sm).alias("embed_text"), T.bm25_text(F.col("text"), kw, sm).alias("bm25_text"))


@query("source_preview", f"SELECT doc_id, CASE WHEN length(t) > 500 THEN left(t, 500) || '...' ELSE t END AS content FROM (SELECT doc_id, replace({strip('text')}, chr(10), ' ') AS t FROM documents)")
def source_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.source_preview(F.col("text")).alias("content"))


_SUFFIXED = ("'(fuente: doc ' || turn || ')'", "' (doc' || turn || ', chunk 2)  '", "''")
_SUFFIX_SQL = f"text || CASE turn % 3 WHEN 0 THEN ' ' || {_SUFFIXED[0]} WHEN 1 THEN {_SUFFIXED[1]} ELSE {_SUFFIXED[2]} END"


@query("clean_answer", rf"SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace({_SUFFIX_SQL}, '\s*\(fuente:[^)]+\)\s*$', ''), '\s*\((doc|chunk)[^)]*\)\s*$', ''), '^\s+|\s+$', '', 'g') AS result FROM conversations")
def clean_answer(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("a", F.expr(_SUFFIX_SQL))
    return rows.select("conv_id", "turn", T.clean_answer(F.col("a")).alias("result"))


_MESSAGE_SQL = "'**Título**' || chr(10) || text || chr(13) || chr(10) || '- uno [doc' || turn || ']' || chr(10) || '1. dos'"


@query(
    "prepare_markdown",
    rf"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '\r\n|\r', chr(10), 'g'),
    '([^\n])\n([ \t]*[-*+] |[ \t]*\d+\. )', '\1' || chr(10) || chr(10) || '\2', 'g'),
    '(?m)^(\*\*[^*\n]+\*\*[^\n]*)\n([^\n])', '\1' || chr(10) || chr(10) || '\2', 'g'),
    '\[doc(\d+)\]', '[[doc\1]](#docref-\1)', 'g') AS result FROM (SELECT conv_id, turn, {_MESSAGE_SQL} AS m FROM conversations)""",
)
def prepare_markdown(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("m", F.expr(_MESSAGE_SQL.replace("chr(", "char(")))
    return rows.select("conv_id", "turn", T.prepare_markdown(F.col("m")).alias("result"))


# --- Filters.

_FRONT = f"""(CASE WHEN list_position(list_transform({lines('text')}, lambda z: starts_with({strip('z')}, '## ')), true) > 2 THEN
    {join(f'''list_filter({lines('text')}, lambda z, i: i >= list_position(list_transform({lines('text')}, lambda y: starts_with({strip('y')}, '## ')), true)
    OR {strip('z')} = '' OR (NOT regexp_matches({strip('z')}, {q(fixed.FRONT_JUNK)})
    AND len(regexp_extract_all({strip('z')}, '\\pL')) / length({strip('z')}) >= 0.5))''')} ELSE text END)"""
register("frontmatter_strip", cleanup.strip_frontmatter_noise, _FRONT, "\n")
_NOISY = join(f"""list_filter({lines('text')}, lambda z: {strip('z')} = '' OR regexp_matches({strip('z')}, {q(fixed.MARKDOWN_STRUCTURE)})
    OR (NOT regexp_matches({strip('z')}, {q(fixed.INSTITUTIONAL_NOISE)})
    AND len(regexp_extract_all({strip('z')}, '[^\\pL\\pN\\s]')) / length({strip('z')}) < 0.45))""")
register("noisy_line_filter", cleanup.remove_noisy_lines, _NOISY, "\n")
_LEGEND_LINES = f"list_filter(list_transform({lines('p')}, lambda z: {strip('z')}), lambda z: z <> '')"
_SHORT = f"len(list_filter({_LEGEND_LINES}, lambda z: length(z) < 35))"
_LEGEND = join(
    f"""list_filter({paras('text')}, lambda p: len({_LEGEND_LINES}) < 3 OR {_SHORT} < 3 OR {_SHORT} / len({_LEGEND_LINES}) < 0.6
    OR {has_word(join(_LEGEND_LINES, "' '"), '|'.join(fixed.CONNECTORS))})""",
    "chr(10) || chr(10)",
)
_SHORT_LINES = "regexp_replace(text, '([.,]) ', '\\1' || chr(10), 'g')"
query("figure_legend_filter", f"SELECT doc_id, {_LEGEND} AS result FROM (SELECT doc_id, {_SHORT_LINES} AS text FROM ({documents_sql()}))")(
    over(lambda t: cleanup.remove_figure_legends(F.regexp_replace(t, r"([.,]) ", "$1\n")))
)


def _reference_sql(x: str) -> str:
    s = strip(x)
    total = " + ".join(
        f"(CASE WHEN regexp_matches({s if stripped else x}, {q(p)}){f' AND length({s}) < {below}' if below else ''} THEN {points} ELSE 0 END)"
        for p, points, stripped, below in fixed.REFERENCE_RULES
    )
    return f"({total})"


_LINE_ROWS = f"SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, {lines('text')} AS ls FROM ({documents_sql(chr(10))}))"
_SCORED = f"SELECT doc_id, pos, line, CASE WHEN p > 0 AND length({strip('line')}) < 80 THEN p + 1 ELSE p END AS score FROM (SELECT *, {_reference_sql('line')} AS p FROM ({_LINE_ROWS}))"


@query("internal_ref_score", f"SELECT doc_id, pos::INTEGER AS pos, score::INTEGER AS score FROM ({_SCORED})")
def internal_ref_score(spark, sf_dir):
    docs = documents(spark, sf_dir, "\n").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    return docs.select("doc_id", "pos", cleanup.reference_score(F.col("line")).alias("score"))


_LED = f"SELECT doc_id, regexp_replace(text, {q(fixed.PAGE_LEAD)}, '\\1', 'g') AS text FROM ({documents_sql(chr(10))})"
_LED_ROWS = f"SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, {lines('text')} AS ls FROM ({_LED}))"
query(
    "internal_ref_filter",
    f"""SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE score < 3), '') AS result FROM
    (SELECT *, CASE WHEN p > 0 AND length({strip('line')}) < 80 THEN p + 1 ELSE p END AS score FROM (SELECT *, {_reference_sql('line')} AS p FROM ({_LED_ROWS})))
    GROUP BY doc_id""",
)(over(cleanup.remove_internal_references, "\n"))

_PARA_ROWS = f"SELECT doc_id, unnest(range(len(ps))) AS pos, unnest(ps) AS para FROM (SELECT doc_id, {paras('text')} AS ps FROM ({documents_sql()}))"
query(
    "citation_block_removal",
    f"""WITH p AS (SELECT doc_id, pos, para, {strip('para')} AS s FROM ({_PARA_ROWS})),
    c AS (SELECT *, (regexp_matches(s, {q(fixed.CITATION_ANCHOR)}) AND NOT regexp_matches(s, '^[#|]')) AS anchor,
        (s <> '' AND (regexp_matches(s, '^[#|]') OR regexp_matches(s, '^\\d{{1,3}}\\.\\s')
            OR NOT (regexp_matches(s, {q(fixed.CITATION_FRAGMENT)}) OR length(s) < 70))) AS stop FROM p),
    w AS (SELECT *, max(CASE WHEN anchor THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
        max(CASE WHEN stop THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM c)
    SELECT doc_id, coalesce(string_agg(para, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE NOT (anchor OR (s <> '' AND a IS NOT NULL AND pos - a <= 19 AND (b IS NULL OR b <= a)))), '') AS result
    FROM w GROUP BY doc_id""",
)(over(cleanup.remove_citation_blocks))


def _greedy_sql(rows: str, should: str, separator: str) -> str:
    """Pair merging by gaps and islands: merges start at even places of each run of wanted merges."""
    return f"""WITH r AS ({rows}), n AS (SELECT *, lead(s) OVER d AS t FROM r WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
    e AS (SELECT *, coalesce({should}, false) AS e FROM n),
    g AS (SELECT *, sum(CASE WHEN e THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM e),
    k AS (SELECT *, e AND (row_number() OVER (PARTITION BY doc_id, coalesce(run, 0) ORDER BY pos) - 1) % 2 = 0 AS takes FROM g),
    x AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY doc_id ORDER BY pos), false) AS taken FROM k)
    SELECT doc_id, coalesce(string_agg(CASE WHEN takes THEN s || ' ' || t ELSE raw END, {separator} ORDER BY pos) FILTER (WHERE NOT taken), '') AS result FROM x GROUP BY doc_id"""


_SOFT = f"SELECT doc_id, regexp_replace(text, '([a-z]) (de|the|der|la) ', '\\1' || chr(10) || '\\2 ', 'g') AS text FROM ({documents_sql(chr(10))})"
_SOFT_ROWS = f"SELECT doc_id, pos, raw, {strip('raw')} AS s FROM (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS raw FROM (SELECT doc_id, {lines('text')} AS ls FROM ({_SOFT})))"
_ENUM, _DECIDE = q(fixed.ENUMERATION), q(fixed.DECISION_START)
query(
    "layout_merge",
    _greedy_sql(
        _SOFT_ROWS,
        f"s <> '' AND t <> '' AND NOT regexp_matches(s, '^[#\\-*•]') AND NOT regexp_matches(s, {_ENUM}) AND NOT regexp_matches(s, {_DECIDE}) AND NOT regexp_matches(t, {_ENUM}) AND NOT regexp_matches(t, {_DECIDE}) AND NOT regexp_matches(s, '[.;:!?\"'')]$') AND regexp_matches(t, '^\\p{{Ll}}')",
        "chr(10)",
    ),
)(over(lambda t: cleanup.repair_layout_breaks(F.regexp_replace(t, "([a-z]) (de|the|der|la) ", "$1\n$2 ")), "\n"))

_PARTS = "regexp_replace(text, '([,a-z]) (de|the|der|la) ', '\\1' || chr(10) || chr(10) || '\\2 ', 'g')"


def _paragraphs_sql() -> str:
    upper, lower, letters = fixed.UPPER_LETTERS, fixed.LOWER_LETTERS, fixed.LETTERS
    dangling = re.fullmatch(r"\(\?i\)\\b\((.*)\)\\s\*\$", fixed.DANGLING_TAIL)[1]
    should = f"""t IS NOT NULL AND NOT starts_with(s, '#') AND NOT starts_with(t, '#') AND NOT regexp_matches(t, '^(- \\?|[*\\-]\\s+[{upper}]|\\d[.)])')
        AND NOT regexp_matches(right(s, 3), '[.;:?!][''’”"]\\s*$')
        AND ((NOT regexp_matches(s, '[.;:?!"'')»]$') AND regexp_matches(t, '^(\\p{{Ll}}|-\\s+[{lower}])'))
            OR regexp_matches(s, {q(f'(?i)(^|{WORD})({dangling})$')}) OR (right(s, 1) = ',' AND regexp_matches(t, '^\\p{{Ll}}')))"""
    source = f"SELECT doc_id, regexp_replace({_PARTS}, '([{letters}])-\\n([{lower}])', '\\1\\2', 'g') AS result FROM ({documents_sql()})"
    for _ in range(3):
        rows = f"""SELECT doc_id, pos, raw, s FROM (SELECT doc_id, pos, raw, {strip('raw')} AS s FROM
            (SELECT doc_id, unnest(range(len(ps))) AS pos, unnest(ps) AS raw FROM (SELECT doc_id, {paras('result')} AS ps FROM ({source})))) WHERE s <> ''"""
        source = _greedy_sql(rows, should, "chr(10) || chr(10)")
    return f"SELECT d.doc_id, coalesce(r.result, '') AS result FROM documents d LEFT JOIN ({source}) r ON d.doc_id = r.doc_id"


query("paragraph_reconstruct", _paragraphs_sql())(over(lambda t: cleanup.reconstruct_paragraphs(F.regexp_replace(t, "([,a-z]) (de|the|der|la) ", "$1\n\n$2 "))))

query(
    "repeated_blocks",
    f"""SELECT doc_id, coalesce(string_agg(para, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE norm = '' OR n < 2), '') AS result FROM
    (SELECT *, count(*) OVER (PARTITION BY doc_id, norm) AS n FROM
        (SELECT *, {strip("regexp_replace(para, '!\\[[^\\]]*\\]\\([^)]+\\)', '', 'g')")} AS norm FROM ({_PARA_ROWS}))) GROUP BY doc_id""",
)(over(cleanup.remove_repeated_blocks))

query(
    "pages_split",
    f"""WITH RECURSIVE d AS (SELECT doc_id, {paras('text')} AS ps,
        string_split(regexp_replace(text, '(?i)\\n(pág\\.?\\s*\\d+|página\\s*\\d+|---+\\s*\\d+)', chr(1) || '\\1', 'g'), chr(1)) AS marked FROM ({documents_sql()})),
    b AS (SELECT doc_id, 1 AS i, length(ps[1]) AS size, 0 AS page, ps FROM d WHERE len(marked) < 3
        UNION ALL SELECT doc_id, i + 1, CASE WHEN size > 3000 THEN 0 ELSE size END + length(ps[i + 1]), page + CASE WHEN size > 3000 THEN 1 ELSE 0 END, ps FROM b WHERE i < len(ps))
    SELECT doc_id, page::INTEGER AS page, string_agg(ps[i], chr(10) || chr(10) ORDER BY i) AS result FROM b GROUP BY doc_id, page
    UNION ALL SELECT doc_id, unnest(range(len(marked)))::INTEGER, unnest(marked) FROM d WHERE len(marked) >= 3""",
)(lambda spark, sf_dir: documents(spark, sf_dir).select("doc_id", F.posexplode(cleanup.split_pages(F.col("text"))).alias("page", "result")))


def _paged(t):
    """Eight lines a page, the first and last of which carry running titles."""
    body = F.split(t, "\n", -1)
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size(body) - 1) / 8).cast("int")), lambda k: F.slice(body, k * 8 + 1, 8))
    return F.transform(pages, lambda p, k: F.concat(F.lit("Tribunal del Norte 3\n"), F.array_join(p, "\n"), F.lit("\nRelatoría  "), (k + 1).cast("string")))


_PAGED_SQL = f"""SELECT doc_id, k, 'Tribunal del Norte 3' || chr(10) || {join('b[k * 8 + 1:k * 8 + 8]')} || chr(10) || 'Relatoría  ' || (k + 1) AS page
    FROM (SELECT doc_id, b, unnest(range((len(b) - 1) // 8 + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS b FROM ({documents_sql(chr(10))})))"""
_FURNITURE_NORM = r"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(z, '(?i)(^|[^\pL\pN_])(pág\.?|página|page)\s*\d+($|[^\pL\pN_])', '\1\3', 'g'), '(^|[^\pL\pN_])\d{1,4}\s*$', '\1'), '^\s*\d{1,4}\s+', ''), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'))"
_FURNITURE_SQL = f"""WITH g AS ({_PAGED_SQL}),
    l AS (SELECT doc_id, k, list_filter(list_transform({lines('page')}, lambda z: {strip('z')}), lambda z: z <> '') AS ls FROM g),
    e AS (SELECT doc_id, unnest(list_concat(ls[1:2], ls[-2:])) AS z FROM l WHERE len(ls) >= 4),
    n AS (SELECT doc_id, {_FURNITURE_NORM} AS norm FROM e),
    c AS (SELECT doc_id, norm, count(*) AS n FROM n WHERE length(norm) BETWEEN 4 AND 149 GROUP BY doc_id, norm),
    t AS (SELECT doc_id, count(*) AS pages FROM g GROUP BY doc_id)"""


@query("page_furniture", f"{_FURNITURE_SQL} SELECT doc_id, norm, n FROM c JOIN t USING (doc_id) WHERE pages >= 3 AND n >= pages * 0.60".replace("SELECT doc_id, norm, n FROM c JOIN", "SELECT doc_id, norm FROM c JOIN"))
def page_furniture(spark, sf_dir):
    docs = documents(spark, sf_dir, "\n").select("doc_id", F.explode(F.array(_paged(F.col("text")))).alias("pages"))
    return docs.select("doc_id", F.explode(cleanup.repeated_furniture(F.col("pages"))).alias("norm"))


@query(
    "furniture_removed",
    f"""{_FURNITURE_SQL}, f AS (SELECT doc_id, norm FROM c JOIN t USING (doc_id) WHERE pages >= 3 AND n >= pages * 0.60),
    d AS (SELECT doc_id, string_agg(page, chr(10) ORDER BY k) AS text FROM g GROUP BY doc_id),
    r AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS z FROM (SELECT doc_id, {lines('text')} AS ls FROM d))
    SELECT r.doc_id, coalesce(string_agg(z, chr(10) ORDER BY pos) FILTER (WHERE f.norm IS NULL), '') AS result FROM r LEFT JOIN f ON r.doc_id = f.doc_id AND f.norm = {_FURNITURE_NORM} GROUP BY r.doc_id""",
)
def furniture_removed(spark, sf_dir):
    docs = documents(spark, sf_dir, "\n").select("doc_id", F.explode(F.array(_paged(F.col("text")))).alias("pages"))
    found = docs.select("doc_id", F.array_join("pages", "\n").alias("text"), F.explode(F.array(cleanup.repeated_furniture(F.col("pages")))).alias("f"))
    return found.select("doc_id", cleanup.remove_furniture(F.col("text"), F.col("f")).alias("result"))


def cleanup_sql() -> str:
    """The steps of :data:`lexloom.operators.cleanup.STEPS`, each oracle reading the rows of the one before it.

    Steps that regroup rows lose empty texts, which the last step takes up again.
    """
    page, whole, broken = (documents_sql(chr(10)), documents_sql(), f"SELECT doc_id, {_SHORT_LINES} AS text FROM ({documents_sql()})")
    steps = (
        (rowwise(_FRONT), whole), (rowwise(_ocr_sql()), whole), (rowwise(_NOISY), whole), (ORACLES["layout_merge"], _SOFT),
        (ORACLES["internal_ref_filter"], page), (ORACLES["citation_block_removal"], whole), (ORACLES["figure_legend_filter"], broken),
        (_paragraphs_sql().replace(_PARTS, "text"), whole), (rowwise(_footnotes_sql()), whole), (ORACLES["repeated_blocks"], whole),
        (ORACLES["markdown_clean"], whole),
    )
    ctes, before = [], whole
    for at, (sql, source) in enumerate(steps):
        ctes.append(f"s{at} AS MATERIALIZED ({sql.replace(source, before)})")
        before = f"SELECT doc_id, coalesce(result, '') AS text FROM documents LEFT JOIN s{at} USING (doc_id)"
    return f"WITH {', '.join(ctes)} SELECT doc_id, coalesce(result, '') AS result FROM s{len(steps) - 1}"


@query("adaptive_cleanup", cleanup_sql())
def adaptive_cleanup(spark, sf_dir):
    return cleanup.adaptive_cleanup(documents(spark, sf_dir)).select("doc_id", F.col("clean").alias("result"))
