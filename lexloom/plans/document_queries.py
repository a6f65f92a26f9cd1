"""Queries that profile, classify, segment and chunk documents, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import fixed, text as T
from lexloom.operators import cleanup, images, profile as P, sections as S
from lexloom.plans.adapter import documents, documents_sql
from lexloom.plans.text_queries import HEADING, _PARA_ROWS, _classify_sql, _reference_sql, cleanup_sql, count, full_paras, lines, paras, q, strip
from lexloom.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def sum_counts(x: str, patterns) -> str:
    return "(" + " + ".join(count(x, p) for p in patterns) + ")"


def unicode_words(pattern: str) -> str:
    """Word classes that RE2 takes as ASCII."""
    return pattern.replace(r"[^\w\s]", r"[^\pL\pN_\s]")


TERMS = P.term_pattern(fixed.COASTAL_TERMS)
WORDS = r"len(regexp_extract_all(text, '\S+'))"
LINE_COUNT = f"len({lines('text')})"
ROUND = 9


def _rounded(df, names):
    return df.select(*(F.round(c, ROUND).alias(c) if c in names else F.col(c) for c in df.columns))


_NOISE = sum_counts("text", [unicode_words(p) for p in fixed.OCR_NOISE]) + " / greatest(1.0, length(text) / 1000.0)"


@query(
    "doc_profile",
    f"""SELECT doc_id, round({sum_counts('text', fixed.LEGAL_CITATIONS)} / greatest(1.0, {WORDS} / 100.0), {ROUND}) AS legal_density,
    round({_NOISE}, {ROUND}) AS ocr_noise_score, ({_NOISE}) > 0.1 AS is_scanned,
    round({sum_counts('text', fixed.FOOTNOTE_STARTS)} / greatest(1.0, {LINE_COUNT} / 10.0), {ROUND}) AS footnote_density,
    round({count('text', TERMS)} / greatest(1.0, {WORDS} / 100.0), {ROUND}) AS term_density,
    greatest(1, len(regexp_extract_all(text, {q(fixed.PAGE_COUNT)})))::INTEGER AS total_pages,
    len({full_paras('text')})::INTEGER AS total_paragraphs FROM ({documents_sql()})""",
)
def doc_profile(spark, sf_dir):
    names = ("legal_density", "ocr_noise_score", "is_scanned", "footnote_density", "term_density", "total_pages", "total_paragraphs")
    out = documents(spark, sf_dir).select("doc_id", F.explode(F.array(P.profile(F.col("text"), names=names))).alias("p"))
    return _rounded(out.select("doc_id", *(F.col(f"p.{n}") for n in names)), {n for n in names if n.endswith(("density", "score"))})


_FULL_LENGTHS = f"list_filter(list_transform({lines('text')}, lambda z: length({strip('z')})), lambda n: n > 0)"


@query(
    "multi_column",
    f"""SELECT doc_id, CASE WHEN len(ls) < 10 OR len(ns) < 10 THEN false ELSE len(list_filter(ns, lambda n: n < list_sum(ns) / len(ns) * 0.4)) / len(ns) > 0.35 END AS result
    FROM (SELECT doc_id, {lines('text')} AS ls, {_FULL_LENGTHS} AS ns FROM ({documents_sql(chr(10))}))""",
)
def multi_column(spark, sf_dir):
    return documents(spark, sf_dir, "\n").select("doc_id", P.multi_column(T.lines(F.col("text"))).alias("result"))


_VARIED = "regexp_replace(text, '(?m)^(ver folio|pág\\.)', '#### \\1', 'g')"


@query(
    "heading_consistency",
    f"""SELECT doc_id, round(CASE WHEN len(lv) < 2 THEN 0.5 ELSE greatest(0.0, 1.0 - len(list_filter(range(2, len(lv) + 1), lambda i: abs(lv[i] - lv[i - 1]) > 1)) / len(lv)) END, {ROUND})::DOUBLE AS result
    FROM (SELECT doc_id, list_transform(list_filter({lines('text')}, lambda z: starts_with({strip('z')}, '#')), lambda z: length(regexp_extract({strip('z')}, '^\\S+'))) AS lv
    FROM (SELECT doc_id, {_VARIED} AS text FROM ({documents_sql(chr(10))})))""",
)
def heading_consistency(spark, sf_dir):
    docs = documents(spark, sf_dir, "\n").select("doc_id", F.regexp_replace("text", r"(?dm)^(ver folio|pág\.)", "#### $1").alias("text"))
    return docs.select("doc_id", F.round(P.heading_consistency(T.lines(F.col("text"))), ROUND).alias("result"))


_OFTEN = "coalesce(list_max(list_transform(list_distinct(s), lambda x: len(list_filter(s, lambda y: y = x)))) >= 3, false)"


@query(
    "furniture_likely",
    f"""WITH l AS (SELECT doc_id, {lines('text')} AS ls FROM ({documents_sql(chr(10))})),
    n AS (SELECT doc_id, ls, len(ls) AS n, least(50, len(ls) // 4) AS c FROM l),
    p AS (SELECT doc_id, n, CASE WHEN n < 20 THEN [] ELSE list_filter(ls, lambda x, i: (i - 1) % greatest(1, n // c) = 0)[1:c] END AS a, CASE WHEN n < 20 THEN [] ELSE ls[n - c + 1:n] END AS b FROM n),
    f AS (SELECT doc_id, n, list_filter(list_transform(a, lambda x: lower({strip('x')})), lambda x: length(x) BETWEEN 6 AND 99) AS a,
        list_filter(list_transform(b, lambda x: lower({strip('x')})), lambda x: length(x) BETWEEN 6 AND 99) AS b FROM p)
    SELECT doc_id, n >= 20 AND {_OFTEN.replace('(s', '(a').replace('filter(s', 'filter(a')} AS headers, n >= 20 AND {_OFTEN.replace('(s', '(b').replace('filter(s', 'filter(b')} AS footers FROM f""",
)
def furniture_likely(spark, sf_dir):
    docs = documents(spark, sf_dir, "\n").select("doc_id", F.explode(F.array(T.lines(F.col("text")))).alias("ls"))
    return docs.select("doc_id", P.furniture_likely(F.col("ls"), False).alias("headers"), P.furniture_likely(F.col("ls"), True).alias("footers"))


def _points_sql(x: str) -> dict[str, str]:
    starts = " OR ".join(f"starts_with({x}, {q(s)})" for s in fixed.METADATA_STARTS)
    points = {}
    for name, patterns in fixed.SECTION_PATTERNS.items():
        points[name] = sum_counts(f"lower({x})", patterns) + (f" + CASE WHEN {starts} THEN 2 ELSE 0 END" if name == "metadata" else "")
    return points


_FULL_ROWS = f"SELECT doc_id, unnest(range(len(ps)))::INTEGER AS pos, unnest(ps) AS para FROM (SELECT doc_id, {full_paras('text')} AS ps FROM ({documents_sql()}))"


def _classified_sql() -> str:
    points = _points_sql("para")
    names = list(points)
    cols = ", ".join(f"{p} AS {n}" for n, p in points.items())
    best = f"greatest({', '.join(names)})"
    kind = "CASE WHEN best < 1 THEN 'analysis' " + " ".join(f"WHEN {n} = best THEN '{n}'" for n in names) + " END"
    words = r"len(regexp_extract_all(para, '\S+'))"
    return f"""SELECT doc_id, pos, para, {kind} AS section_type, CASE WHEN best < 1 THEN 0.0 ELSE least(1.0, best / 5.0) END AS score,
        CASE WHEN {words} = 0 THEN 0.0 ELSE least(1.0, {count('para', TERMS)} * 100.0 / {words}) END AS relevance
        FROM (SELECT *, {best} AS best FROM (SELECT *, {cols} FROM ({_FULL_ROWS})))"""


def _blocks(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.posexplode(P.blocks(F.col("text"))).alias("pos", "b"))
    return docs.select("doc_id", "pos", "b.section_type", "b.score", "b.relevance")


@query("paragraph_classify", f"SELECT doc_id, pos, section_type, round(score, {ROUND})::DOUBLE AS score FROM ({_classified_sql()})")
def paragraph_classify(spark, sf_dir):
    return _rounded(_blocks(spark, sf_dir).select("doc_id", "pos", "section_type", "score"), {"score"})


@query("term_relevance", f"SELECT doc_id, pos, round(relevance, {ROUND})::DOUBLE AS relevance FROM ({_classified_sql()})")
def term_relevance(spark, sf_dir):
    return _rounded(_blocks(spark, sf_dir).select("doc_id", "pos", "relevance"), {"relevance"})


@query("section_counts", f"SELECT doc_id, section_type, count(*) AS n FROM ({_classified_sql()}) GROUP BY ALL")
def section_counts(spark, sf_dir):
    return _blocks(spark, sf_dir).groupBy("doc_id", "section_type").agg(F.count("*").alias("n"))


@query(
    "segmentation_score",
    f"""SELECT doc_id, round(least(100.0, count(DISTINCT section_type) / 8 * 50 + avg(score) * 30 + least(0.2, count(*) FILTER (WHERE relevance > 0.1) / count(*)) * 100), 6)::DOUBLE AS result
    FROM ({_classified_sql()}) GROUP BY doc_id""",
)
def segmentation_score(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.explode(F.array(P.blocks(F.col("text")))).alias("b")).filter(F.size("b") > 0)
    return docs.select("doc_id", F.round(P.segmentation_score(F.col("b")), 6).alias("result"))


def _entities_sql() -> str:
    """Entities as rows; neighbours get two separators, so that each match has its own."""
    edge = r"[^\pL\pN_]"
    parts = []
    for name, terms in fixed.ENTITY_TERMS.items():
        pattern = q(f"(?i)(?:^|{edge})({terms.replace(' ', ' +')})(?:{edge}|$)")
        parts.append(f"SELECT doc_id, '{name}' AS type, unnest(regexp_extract_all(t, {pattern}, 1)) AS e FROM d")
    return f"""WITH d AS (SELECT doc_id, regexp_replace(text, '({edge})', '\\1\\1', 'g') AS t FROM ({documents_sql()})),
        e AS ({' UNION ALL '.join(parts)})
        SELECT DISTINCT doc_id, type, regexp_replace(lower(e), '\\s+', ' ', 'g') AS entity FROM e"""


@query("entity_extract", _entities_sql())
def entity_extract(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.explode(P.entities(F.col("text"))).alias("type", "es"))
    return docs.select("doc_id", "type", F.explode("es").alias("entity"))


@query(
    "entity_counts",
    f"""SELECT doc_id, count(DISTINCT type) AS types, count(*) AS entities, round(least(100.0,
        (least(1.0, count(DISTINCT type) / 4.0) * 40 + least(1.0, count(*) / 10.0) * 30 + count(DISTINCT type) FILTER (WHERE type IN {tuple(fixed.KEY_ENTITIES)}) / 5.0 * 30) * 100), 6)::DOUBLE AS score
    FROM ({_entities_sql()}) GROUP BY doc_id""",
)
def entity_counts(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.explode(F.array(P.entities(F.col("text")))).alias("e")).filter(F.size("e") > 0)
    total = F.aggregate(F.map_values("e"), F.lit(0), lambda a, v: a + F.size(v)).cast("long")
    return docs.select("doc_id", F.size("e").cast("long").alias("types"), total.alias("entities"), F.round(P.entity_score(F.col("e"), F.lit(0.08)), 6).alias("score"))


_REFS = f"list_filter({lines('text')}, lambda z: {_reference_sql('z')} + CASE WHEN {_reference_sql('z')} > 0 AND length({strip('z')}) < 80 THEN 1 ELSE 0 END >= 3)"


@query(
    "footer_citation_scores",
    f"""SELECT doc_id, round(greatest(0.0, least(100.0, 100 - len(list_filter(fs, lambda z: regexp_matches(z, '^\\d{{1,2}}\\s{{2,}}'))) / len(fs) * 1000)), 6)::DOUBLE AS footer,
        round(greatest(0.0, least(100.0, 100 - (len(rs) + len(list_filter(ls, lambda z: regexp_matches({strip('z')}, '(?i)^\\s*\\d{{1,2}}\\s{{2,}}(En|Ver|Al|Corte|Consejo|Por|M\\.P)')))) / len(ls) * 800)), 6)::DOUBLE AS citation
    FROM (SELECT doc_id, {lines('text')} AS ls, list_filter(list_transform({lines('text')}, lambda z: {strip('z')}), lambda z: z <> '') AS fs, {_REFS} AS rs
        FROM (SELECT doc_id, regexp_replace(text, '(?m)^2\\. ', '2   ', 'g') AS text FROM ({documents_sql(chr(10))}))) WHERE len(fs) > 0""",
)
def footer_citation_scores(spark, sf_dir):
    docs = documents(spark, sf_dir, "\n").select("doc_id", F.regexp_replace("text", r"(?m)^2\. ", "2   ").alias("text")).filter(F.size(F.filter(T.lines(F.col("text")), lambda x: T.strip(x) != "")) > 0)
    return docs.select("doc_id", F.round(P.footer_score(F.col("text")), 6).alias("footer"), F.round(P.citation_score(F.col("text")), 6).alias("citation"))


@query(
    "paragraph_score",
    f"""SELECT doc_id, round(CASE WHEN n = 0 THEN 50.0 ELSE least(100.0, (CASE WHEN len(ps) / n BETWEEN 0.4 AND 0.85 THEN 50.0 WHEN len(ps) / n > 0.85 AND len(ps) / n <= 1.0 THEN 35.0 ELSE 20.0 END)
        + greatest(0.0, 50.0 - len(list_filter(range(1, len(ps)), lambda i: NOT regexp_matches(ps[i], '[.;:?!"'')]$') AND regexp_matches(ps[i + 1], '^\\p{{Ll}}'))) / greatest(1, len(ps)) * 200)) END, 6)::DOUBLE AS result
    FROM (SELECT d.doc_id, len({full_paras('d.text')}) AS n, list_filter(list_transform({paras('x.text')}, lambda z: {strip('z')}), lambda z: z <> '') AS ps
        FROM ({documents_sql()}) d JOIN (SELECT doc_id, replace(text, '.' || chr(10) || chr(10), '. ') AS text FROM ({documents_sql()})) x ON d.doc_id = x.doc_id)""",
)
def paragraph_score(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", F.replace("text", F.lit(".\n\n"), F.lit(". ")).alias("clean"))
    return docs.select("doc_id", F.round(P.paragraph_score(F.col("text"), F.col("clean")), 6).alias("result"))


def quality_sql() -> str:
    """The scores of the parts over originals and cleaned texts; documents without paragraphs or entities score as if they had none."""
    own, clean = documents_sql(), "SELECT doc_id, result AS text FROM cl"
    on_clean = lambda sql, source=own: sql.replace(source, clean)
    varied = f"SELECT doc_id, regexp_replace(text, '(?m)^2\\. ', '2   ', 'g') AS text FROM ({documents_sql(chr(10))})"
    broken = f"SELECT doc_id, replace(text, '.' || chr(10) || chr(10), '. ') AS text FROM ({own})"
    headings = ORACLES["heading_consistency"].replace(_VARIED, "text").replace(documents_sql(chr(10)), own)
    terms = f"{count('text', TERMS)} / greatest(1.0, {WORDS} / 100.0)"
    return f"""WITH cl AS MATERIALIZED ({cleanup_sql()}), o AS (SELECT doc_id, ({_NOISE}) AS noise, {terms} AS density FROM ({own})),
    b AS MATERIALIZED ({on_clean(_classified_sql())}), e AS MATERIALIZED ({on_clean(_entities_sql())}),
    pa AS ({ORACLES["paragraph_score"].replace(broken, clean)}), he AS ({headings}), fc AS ({on_clean(ORACLES["footer_citation_scores"], varied)}),
    se AS (SELECT doc_id, least(100.0, count(DISTINCT section_type) / 8 * 50 + avg(score) * 30 + least(0.2, count(*) FILTER (WHERE relevance > 0.1) / count(*)) * 100) AS score FROM b GROUP BY doc_id),
    sc AS (SELECT doc_id, string_agg(section_type || ':' || n, ',' ORDER BY section_type) AS section_counts FROM (SELECT doc_id, section_type, count(*) AS n FROM b GROUP BY ALL) GROUP BY doc_id),
    ec AS (SELECT doc_id, count(DISTINCT type) AS types, count(*) AS n, count(DISTINCT type) FILTER (WHERE type IN {tuple(fixed.KEY_ENTITIES)}) AS keys FROM e GROUP BY doc_id),
    j AS (SELECT o.doc_id, pa.result AS p, he.result * 100 AS h, CASE WHEN noise <= 0.05 THEN 100.0 ELSE greatest(20.0, 100.0 - (noise - 0.05) * 200) END AS oc,
        coalesce(footer, 50.0) AS f, coalesce(citation, 100.0) AS c, coalesce(se.score, 0.0) AS s, coalesce(section_counts, '') AS section_counts, coalesce(ec.n, 0) AS n,
        CASE WHEN types IS NULL THEN 0.0 ELSE least(100.0, (least(1.0, types / greatest(1.0, density * 50)) * 40 + least(1.0, ec.n / 10.0) * 30 + keys / 5.0 * 30) * 100) END AS e
        FROM o LEFT JOIN pa USING (doc_id) LEFT JOIN he USING (doc_id) LEFT JOIN fc USING (doc_id) LEFT JOIN se USING (doc_id) LEFT JOIN sc USING (doc_id) LEFT JOIN ec USING (doc_id))
    SELECT doc_id, round(p, 6)::DOUBLE AS paragraph_score, round(h, 6)::DOUBLE AS heading_score, round(oc, 6)::DOUBLE AS ocr_cleanup_score, round(f, 6)::DOUBLE AS footer_removal_score,
        round(c, 6)::DOUBLE AS citation_cleanup_score, round(s, 6)::DOUBLE AS section_segmentation_score, round(e, 6)::DOUBLE AS entity_score,
        round(p * 0.2 + f * 0.15 + oc * 0.15 + c * 0.1 + s * 0.2 + e * 0.2, 6)::DOUBLE AS final_quality, section_counts, n::INTEGER AS entity_count FROM j"""


@query("quality_report", quality_sql())
def quality_report(spark, sf_dir):
    """Scores to six places; the counts of sections as a list of ``type:n`` by type."""
    report = P.quality_report(cleanup.adaptive_cleanup(documents(spark, sf_dir)), "text", "clean").drop("text", "clean")
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("section_counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))), ",")
    return _rounded_to(report.withColumn("section_counts", listed), 6)


def _rounded_to(df, places: int):
    return df.select(*(F.round(n, places).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes))


# --- Sections.

SECTION_SQL = f"""WITH t AS (SELECT doc_id, string_split(regexp_replace(text, '(?m)^(## .)', chr(1) || '\\1', 'g'), chr(1)) AS ps FROM ({documents_sql()})),
    b AS (SELECT doc_id, unnest(range(len(ps))) AS pos, unnest(ps) AS body FROM t),
    h AS (SELECT *, regexp_extract(body, '^## (.+)', 1) AS h FROM b WHERE regexp_matches(body, '^## .')),
    k AS (SELECT *, coalesce({strip("list_filter(string_split(body, chr(10))[2:], lambda z: regexp_replace(z, '^\\s+|\\s+$', '', 'g') <> '' AND NOT starts_with(z, '#'))[1]")}, '') AS follow FROM h),
    n AS (SELECT doc_id, pos, body, h AS heading, follow, {HEADING} AS own FROM k),
    m AS (SELECT *, {HEADING.replace('lower(h)', 'lower(follow)')} AS next FROM n),
    c AS (SELECT doc_id, pos, body, CASE WHEN own = '' AND {_classify_sql('next')} IS NOT NULL THEN follow ELSE {strip('heading')} END AS heading,
        CASE WHEN own = '' THEN {_classify_sql('next')} ELSE {_classify_sql('own')} END AS section FROM m),
    a AS (SELECT *, coalesce(last_value(section IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS active FROM c),
    s AS (SELECT doc_id, n AS section_index FROM (SELECT DISTINCT doc_id FROM b) CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n)),
    w AS (SELECT doc_id, -1 AS pos, body, 1 AS active FROM b WHERE pos = 0 AND NOT regexp_matches(body, '^## .') UNION ALL SELECT doc_id, pos, body, active FROM a),
    p AS (SELECT doc_id, active, string_agg({strip('body')}, chr(10) || chr(10) ORDER BY pos) AS page_content FROM w WHERE {strip('body')} <> '' GROUP BY ALL),
    f AS (SELECT doc_id, section, first(heading ORDER BY pos) AS heading FROM c WHERE section IS NOT NULL GROUP BY ALL)
    SELECT s.doc_id, s.section_index, CASE s.section_index {' '.join(f'WHEN {k} THEN {q(v)}' for k, v in fixed.SECTION_NAMES.items())} END AS section_name,
        coalesce(f.heading, '') AS section_heading, coalesce(p.page_content, '') AS page_content
    FROM s LEFT JOIN p ON s.doc_id = p.doc_id AND s.section_index = p.active LEFT JOIN f ON s.doc_id = f.doc_id AND s.section_index = f.section"""


@query("split_sections", SECTION_SQL)
def split_sections(spark, sf_dir):
    return S.split_documents(documents(spark, sf_dir))


@query("section_first_heading", f"SELECT doc_id, section_index, section_heading FROM ({SECTION_SQL}) WHERE section_heading <> ''")
def section_first_heading(spark, sf_dir):
    return S.split_documents(documents(spark, sf_dir)).select("doc_id", "section_index", "section_heading").filter("section_heading <> ''")


def _sections(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat(F.lit("caso_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source"), F.lit(1).alias("section_index"), F.col("text").alias("page_content"))


@query("chunk_documents")
def chunk_documents(spark, sf_dir):
    return S.chunk(_sections(spark, sf_dir))


@query("chunk_coverage", "SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g'))::BIGINT AS letters, true AS in_size FROM documents WHERE regexp_matches(text, '\\S')")
def chunk_coverage(spark, sf_dir):
    """Chunks without overlap lose no character but white space, and none is longer than the size."""
    chunks = S.chunk(_sections(spark, sf_dir), fixed.CHUNK_SIZE, 0)
    letters = F.sum(F.length(F.regexp_replace("page_content", r"(?U)\s", "")))
    return chunks.groupBy("doc_id").agg(letters.alias("letters"), (F.max(F.length("page_content")) <= fixed.CHUNK_SIZE).alias("in_size"))


# --- Images: the features come from line items, a document being an order.

_FEATURES = (
    "l_orderkey AS doc_id", "(CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey) * 1000000 + l_suppkey AS pos", "CAST(l_quantity * 16 AS INTEGER) AS width",
    "CAST((l_suppkey * 37) % 700 AS INTEGER) AS height", "CAST(l_partkey % 7 AS VARCHAR(20)) AS md5", "l_extendedprice / 100 AS variance", "l_returnflag = 'A' AS has_context",
)


@query(
    "image_filter",
    f"""WITH f AS (SELECT *, width < 350 AND height < 350 AS small, width::BIGINT * height AS area FROM (SELECT {', '.join(_FEATURES)} FROM lineitem)),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, md5, small ORDER BY pos) AS nth FROM f),
    r AS (SELECT *, CASE WHEN small THEN 'too_small' WHEN nth > 1 THEN 'duplicate_hash' WHEN variance < 100 THEN 'low_variance' WHEN NOT has_context AND area < 250000 THEN 'no_semantic_context' END AS reason FROM n),
    l AS (SELECT *, bool_and(reason IS NOT NULL) OVER (PARTITION BY doc_id) AS lost, row_number() OVER (PARTITION BY doc_id ORDER BY area DESC, pos) AS place FROM r)
    SELECT doc_id, pos, CASE WHEN NOT (lost AND area >= 160000 AND place <= 2) THEN reason END AS remove_reason FROM l""",
)
def image_filter(spark, sf_dir):
    features = table(spark, sf_dir, "lineitem").selectExpr(*_FEATURES)
    return images.filter_images(features).select("doc_id", "pos", "remove_reason")


@query("image_refs", f"""SELECT doc_id, unnest(range(len(ts)))::INTEGER AS pos, unnest(ts) AS ref FROM (SELECT doc_id, regexp_extract_all(text, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1) AS ts FROM ({documents_sql()}))""")
def image_refs(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.posexplode(images.image_refs(F.col("text"))).alias("pos", "r"))
    return docs.select("doc_id", "pos", F.col("r.ref").alias("ref"))


#: Composed and decomposed forms of one name.
_NFC, _NFD = "plano ni\u00f1o.png", "plano nin\u0303o.png"


@query(
    "image_files",
    f"""WITH r AS (SELECT doc_id, unnest(range(len(ts)))::INTEGER AS pos FROM (SELECT doc_id, regexp_extract_all(text, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1) AS ts FROM ({documents_sql()})))
    SELECT doc_id, pos, CASE doc_id % 6 WHEN 0 THEN '/data/img/plano uno.png' WHEN 2 THEN '/data/img/{_NFD}' WHEN 3 THEN '/data/img/b/{_NFC}' WHEN 4 THEN '/data/other/plano uno.png' END AS file FROM r""",
)
def image_files(spark, sf_dir):
    """The file of each reference: found as written, not in another case, in the other composition, in the own folder only."""
    text = F.when(F.col("doc_id") % 6 == 1, F.replace("text", F.lit("plano uno"), F.lit("PLANO%20UNO"))).when(F.col("doc_id") % 6 == 2, F.replace("text", F.lit("plano uno.png"), F.lit(_NFC)))
    text = text.when(F.col("doc_id") % 6 == 3, F.replace("text", F.lit("/data/img/plano uno.png"), F.lit(_NFD))).when(F.col("doc_id") % 6 >= 4, F.replace("text", F.lit("/data/img/plano uno"), F.lit("../other/plano%20uno")))
    folder = F.when(F.col("doc_id") % 6 == 3, "/data/img/b").when(F.col("doc_id") % 6 == 5, "/data/img/b").otherwise("/data/img")
    docs = documents(spark, sf_dir)
    refs = docs.select("doc_id", folder.alias("folder"), F.posexplode(images.image_refs(F.coalesce(text, F.col("text")))).alias("pos", "r")).select("doc_id", "folder", "pos", F.col("r.ref").alias("ref"))
    stored = ["/data/img/plano uno.png", f"/data/img/{_NFD}", f"/data/img/b/{_NFC}", "/data/other/plano uno.png", "/data/img/plano dos.png"]
    return images.locate(refs, spark.createDataFrame([(x,) for x in stored], "path string")).select("doc_id", "pos", "file")


_PARTS = "SELECT doc_id, (doc_id % 101)::DOUBLE AS p, (doc_id % 97)::DOUBLE AS f, (doc_id % 89)::DOUBLE AS o, (doc_id % 83)::DOUBLE AS c, (doc_id % 79)::DOUBLE AS s, (doc_id % 73)::DOUBLE AS e FROM documents"


@query("final_quality", f"SELECT doc_id, round(p * 0.2 + f * 0.15 + o * 0.15 + c * 0.1 + s * 0.2 + e * 0.2, 6) AS final_quality FROM ({_PARTS})")
def final_quality(spark, sf_dir):
    parts = {"paragraph": 101, "footer": 97, "ocr": 89, "citation": 83, "segmentation": 79, "entity": 73}
    total = P.final_quality({n: (F.col("doc_id") % m).cast("double") for n, m in parts.items()})
    return table(spark, sf_dir, "documents").select("doc_id", F.round(total, 6).alias("final_quality"))


__all__ = ["ORACLES", "QUERIES", "_PARA_ROWS"]
