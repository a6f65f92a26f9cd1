"""Text and clean-up expressions against golden strings and sequential restatements of their rules."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lexloom.functions import fixed, text as T
from lexloom.operators import cleanup as C, profile as P


@pytest.fixture
def apply(spark):
    def run(expr, values):
        df = spark.createDataFrame(list(enumerate(values)), "i int, text string").coalesce(1)
        return [r.x for r in df.select("i", expr(F.col("text")).alias("x")).orderBy("i").collect()]

    return run


GOLDEN = [
    (T.normalize_text, "Linea con espacios   \nOtra linea\t\t\n\n\n\nfin\xa0x ", "Linea con espacios\nOtra linea\n\nfin x"),
    (T.title, "/tmp/casos/fallo_123.txt", "fallo 123"),
    (T.title, ".env", ".env"),
    (T.title, "", None),
    (T.base_name, "/tmp/casos/fallo_123.txt", "fallo_123.txt"),
    (T.normalize_heading, "IV.- CONSIDERACIONES   de la Sala: ", "consideraciones de la sala"),
    (T.normalize_heading, "1.2.3 Trámite", "tramite"),
    (T.normalize_heading, "Civil y penal", "y penal"),
    (T.normalize_heading, "IV.", ""),
    (T.classify_heading, "2. El recurso de apelación interpuesto", 2),
    (T.classify_heading, "Puntualmente las conclusiones", None),
    (T.classify_heading, "RESUELVE:", 4),
    (T.fix_ocr_chars, "concesi6n raz6n interés6s l0s pr0ceso 0bra ![ci6n](a/ci6n.png) obligaci6nes", "concesión razón interésós los proceso obra ![ci6n](a/ci6n.png) obligaciones"),
    (T.fix_ocr_chars, "token e6f6a b6c6d6e 6a6", "token eófóa bócódóe 6a6"),
    (T.remove_footnote_numbers, "jurisdicción14 contestó 6 a la ley 12 y el artículo 5, ley12", "jurisdicción contestó a la ley 12 y el artículo 5, ley12"),
    (T.remove_footnote_numbers, "INVEMAR) 13 en 20228 y 2021 32 , CPT-CAM-012-21 34", "INVEMAR) en 2022 y 2021 , CPT-CAM-012-21"),
    (T.remove_footnote_numbers, "valor 60 y 12345", "valor 60 y 12345"),
    (T.split_heading_body, "## 1.1. Posición de la parte. En síntesis, la parte actora\nx\n2. Segundo punto", "## 1.1. Posición de la parte.\n1. En síntesis, la parte actora\nx\n2. Segundo punto"),
    (T.clean_markdown, "a\n## B  \n\n\n\nc", "a\n\n## B\n\nc\n"),
    (lambda t: T.relativize_image_refs(t, "/d/x"), "![a](/d/x/i.png) ![b](/e/i.png)", "![a](./i.png) ![b](/e/i.png)"),
    (T.resolve_image_path, "<a%20b+c.png>", "a b+c.png"),
    (T.normalize_furniture_line, "  12 Tribunal   Superior página 3 ", "tribunal superior"),
    (T.normalize_entity, "  Espacio   PÚBLICO ", "espacio público"),
    (T.clean_answer, "Sí. (doc1, doc2) (fuente: x) ", "Sí."),
    (T.prepare_markdown, "a\r\n- b [doc2]\n**T**\nx", "a\n\n- b [[doc2]](#docref-2)\n**T**\n\nx"),
    (T.source_preview, "a\nb" + "c" * 600, "a b" + "c" * 497 + "..."),
    (C.remove_noisy_lines, "texto\n\n3001234567\n# x\n%%%% a\nFacebook: x", "texto\n\n# x"),
    (C.strip_frontmatter_noise, "1234567 x\nUn texto bueno\n\nab\n## H\n@@", "Un texto bueno\n\n## H\n@@"),
    (C.remove_figure_legends, "Norte\nSur\nMar km\n\nuno\ndos\nel que vive\n\nlargo", "uno\ndos\nel que vive\n\nlargo"),
    (C.remove_internal_references, "Ver folio 12\nun hecho\npág. 3 sigue\n12  Nota\nhttps://x.y", "un hecho\nsigue"),
    (C.remove_repeated_blocks, "a\n\nb\n\na\n\n![x](y)\n\nc", "b\n\n![x](y)\n\nc"),
    (C.repair_layout_breaks, "El hecho\nsigue aquí\ny más.\n# T\nabc\n1. x", "El hecho sigue aquí\ny más.\n# T\nabc\n1. x"),
    (C.reconstruct_paragraphs, "Uno de\n\nDos.\n\ninter-\nrumpida,\n\nsigue", "Uno de Dos.\n\ninterrumpida, sigue"),
]


@pytest.mark.parametrize("case", range(len(GOLDEN)))
def test_golden(apply, case):
    expr, given, wanted = GOLDEN[case]
    assert apply(expr, [given]) == [wanted]


def test_nulls_and_empties(apply):
    for _, step in C.STEPS:
        assert apply(step, [None]) == [None]
        assert apply(step, [""])[0] in ("", "\n")


def texts(separator: str, pieces: list[str], n: int = 400, longest: int = 14) -> list[str]:
    draw = random.Random(5)
    return [separator.join(draw.choice(pieces) for _ in range(draw.randint(0, longest))) for _ in range(n)]


#: Two lines that follow each other, and whether they are one sentence broken by the layout.
LINE_PAIRS = [
    ("El hecho", "sigue aquí", True), ("El hecho", "ñandú", True), ("jkl ", "  mno", True), ("El hecho", "Sigue aquí", False), ("El hecho", "7 días", False),
    ("El hecho.", "sigue", False), ("a saber:", "sigue", False), ("uno;", "sigue", False), ("¿cómo?", "sigue", False), ("¡ya!", "sigue", False), ('dijo "sí"', "sigue", False),
    ("(nota)", "sigue", False), ("Mayor,", "sigue", True), ("# Título", "sigue", False), ("- punto", "sigue", False), ("* punto", "sigue", False), ("• punto", "sigue", False),
    ("a) primero", "sigue", False), ("El hecho", "b) segundo", False), ("resuelve", "confirmar", False), ("El hecho", "resuelve confirmar", False), ("", "sigue", False),
]
#: The same of paragraphs.
PARAGRAPH_PAIRS = [
    ("El juez", "decidió así", True), ("El juez", "Decidió así", False), ("El juez.", "decidió", False), ("lo dicho,", "decidió", True), ("lo dicho,", "Decidió", False),
    ("en síntesis:", "decidió", False), ("«cita»", "decidió", False), ("(nota)", "decidió", False), ("El caso de la", "Corte Suprema", True), ("lo que", "Pide", True),
    ("El juez", "- otro punto", True), ("El juez", "- Otro punto", False), ("El juez.", "- otro punto", False), ("El juez", "2. segundo", False), ("El juez", "2) segundo", False),
    ("# Título", "sigue", False), ("El juez", "# Título", False), ('dijo."', "sigue", False), ("dijo.'", "sigue", False), ("El caso de la", "- ?", False), ("  El juez  ", "  ñoño ", True),
]


def test_which_lines_are_joined(apply):
    got = apply(C.repair_layout_breaks, [f"{a}\n{b}" for a, b, _ in LINE_PAIRS])
    assert got == [f"{a.strip()} {b.strip()}" if joined else f"{a}\n{b}" for a, b, joined in LINE_PAIRS]


def test_which_paragraphs_are_joined(apply):
    got = apply(lambda t: C.reconstruct_paragraphs(t, 1), [f"{a}\n\n{b}" for a, b, _ in PARAGRAPH_PAIRS])
    assert got == [f"{a.strip()} {b.strip()}" if joined else f"{a}\n\n{b}" for a, b, joined in PARAGRAPH_PAIRS]


def pairs_taken(flags: list[bool]) -> list[int]:
    """Greedy from the left: the first of each pair, given for every two neighbours whether they may join."""
    taken = []
    for i, may in enumerate(flags):
        if may and (not taken or taken[-1] < i - 1):
            taken.append(i)
    return taken


def test_merging_is_greedy(apply):
    """A word in lower case may join what stands before it, so a text's flags are those of its words' cases."""
    draw = random.Random(5)
    cases = [[draw.random() < 0.6 for _ in range(draw.randint(1, 14))] for _ in range(300)]
    words = [["Inicio", *(f"w{i}" if low else f"W{i}" for i, low in enumerate(flags))] for flags in cases]
    for expr, gap, passes in ((C.repair_layout_breaks, "\n", 1), (C.reconstruct_paragraphs, "\n\n", 3)):
        wanted = []
        for parts in words:
            parts = list(parts)
            for _ in range(passes):
                for i in reversed(pairs_taken([p[0].islower() for p in parts[1:]])):
                    parts[i : i + 2] = [f"{parts[i]} {parts[i + 1]}"]
            wanted.append(gap.join(parts))
        assert apply(expr, [gap.join(parts) for parts in words]) == wanted


def test_citation_blocks(apply):
    def removed(c):
        """One pass forward with the paragraphs still in reach of the last anchor."""
        kept, reach = [], 0
        for paragraph in c.split("\n\n"):
            s = paragraph.strip()
            marked = s.startswith(("#", "|"))
            if not marked and re.search(fixed.CITATION_ANCHOR, s):
                reach = fixed.CITATION_REACH
                continue
            within, reach = reach > 0, reach - 1
            if within and s:
                belongs = re.match(fixed.CITATION_FRAGMENT, s) or len(s) < fixed.CITATION_SHORT
                if belongs and not marked and not re.match(r"\d{1,3}\.\s", s):
                    continue
                reach = 0
            kept.append(paragraph)
        return "\n\n".join(kept)

    cases = texts("\n\n", ["Radicación: 123", "corto", "largo " * 20, "", "# T", "3. punto", "General de la " + "x" * 80, "# Radicación: 99", "otro"], longest=40)
    assert apply(C.remove_citation_blocks, cases) == [removed(c) for c in cases]


FOOTNOTES = [
    ("caso12", "caso"),
    ("caso12 y sala7.", "caso y sala."),
    ("ley7", "ley7"),
    ("ley 7", "ley 7"),
    ("Decreto 12, sala 7", "Decreto 12, sala"),
    ("el artículo caso12", "el artículo caso12"),
    ("a3", "a3"),
    ("caso 55", "caso"),
    ("caso 56", "caso 56"),
    ("caso 60 sala", "caso 60 sala"),
    ("caso 7x", "caso 7x"),
    ("caso 123", "caso 123"),
    ("caso123", "caso123"),
    ("(sala 7)", "(sala)"),
    ("sala 12, caso 3; fin", "sala, caso; fin"),
    ("ver folio 12 22.249.23", "ver folio.249.23"),
    ("caso 7 8 9 fin", "caso 9 fin"),
    ("caso 7 60", "caso 60"),
    ("ley 7 8 9", "ley 7 8 9"),
    ("sala) 12 34 56, CPT-012-21 34 55.", "sala) 56, CPT-012-21."),
    ("numeral  7", "numeral  7"),
    ("caso  7 fin", "caso fin"),
    ("LEY12 Sala12", "LEY12 Sala"),
    ("", ""),
]


def test_footnotes(apply):
    assert apply(T.remove_footnote_numbers, [a for a, _ in FOOTNOTES]) == [b for _, b in FOOTNOTES]


def test_pages(apply):
    def bins(c):
        out, held, size = [], [], 0
        for p in c.split("\n\n"):
            held.append(p)
            size += len(p)
            if size > fixed.PAGE_CHARS:
                out.append("\n\n".join(held))
                held, size = [], 0
        return out + (["\n\n".join(held)] if held else [])

    cases = texts("\n\n", ["x" * 900, "y" * 1500, "z" * 3001, "", "w" * 3000], longest=12)
    assert apply(C.split_pages, cases) == [bins(c) for c in cases]
    assert apply(C.split_pages, ["a\npág. 1 b\nPágina 2 c"]) == [["a", "pág. 1 b", "Página 2 c"]]


def test_furniture(apply):
    pages = "|".join(f"Tribunal {i}\nl{i}\nm{i}\nn{i}\nfin {i}" for i in range(5))
    found = apply(lambda t: C.repeated_furniture(F.split(t, r"\|")), [pages, "a\nb\nc\nd"])
    assert found == [["tribunal"], []]


def test_adaptive_cleanup_is_one_stage(spark):
    df = spark.createDataFrame([("## I. ANTECEDENTES\nEl hecho\nsigue jurisdicción14.",)], "text string")
    plan = C.adaptive_cleanup(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert C.adaptive_cleanup(df).first().clean.endswith("\n")


def test_quick_lists_match_alike():
    cases = texts(" ", ["ley", "Ley 3", "leyes", "LEY", "artículo 7", "playa", "PLAYAS", "bahía", "xplaya", "corte suprema"])
    for pattern in (*fixed.LEGAL_CITATIONS, r"(?i)\b(playa|playas|bahía)\b", r"\b(ley|artículo)\b", r"\d[a-z]"):
        for case in cases:
            assert re.findall(T.quick(pattern), case) == re.findall(pattern, case)


def test_strip_and_lines_equal_their_patterns(spark):
    """Every character of the basic plane at both ends; all line ends; stripping looks at no pattern."""
    every = [chr(c) + "a" + chr(c) + "b" + chr(c) * 2 for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(x,) for x in [*every, "", " ", "\u3000\n\t"]], "x string")
    assert df.filter(T.strip(F.col("x")) != F.regexp_replace("x", T.rx(r"\A\s+|\s+\z"), "")).count() == 0
    assert "regexp" not in df.select(T.strip(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()
    texts = ["", "\n", "a\r\nb\rc\n\nd\n", "\r\n", "\n\r", "\r\r\n\n", "a\x85b\u2028c\x0bd\x1ce", "\r\n\r\n", "á\r\n"]
    found = spark.createDataFrame([(x,) for x in texts], "x string").select("x", T.lines(F.col("x")).alias("ls")).collect()
    assert {r.x: r.ls for r in found} == {x: x.splitlines() for x in texts}


def test_quick_equals_its_pattern(spark):
    """A list of words counts alike with and without the look at the first letter, also for letters that only differ by case."""
    words = P.term_pattern(fixed.COASTAL_TERMS)
    texts = ["PLAYA playas, \u017fervidumbre Servidumbre", "xplaya playax É\u017ftuario", "MUELLE\u0130 emi\u017fario e\u017fpacio público", "corale\u017f"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    got = df.select(T.count_of(F.col("x"), words).alias("a"), F.regexp_count("x", F.lit(T.rx(words))).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and sum(r.a for r in got) > 4
    assert T.quick(words).index("(?=") < T.quick(words).index(r"\b")


def test_reference_hints_miss_no_rule(spark):
    """The points of a line are those of the rules alone, whichever case its letters have."""
    texts = ["VER PDF 12", "ver fol\u0131o 3", "ARCH\u0130VO x.pdf", "http\u017f://a", "ONEDR\u0130VE", "\u017fharepoint", "PÁG. 7", "Ver con\u017fiderando", "12  Corte", "expediente ELECTRÓNICO judicial", "Por medio del cual se", "nothing", "", "cuaderno 4", "Magi\u017ftrado: x", "pdf 12 del exped\u0131ente"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")

    def plain(line):
        s, points = T.strip(line), F.lit(0)
        for pattern, value, stripped, below in fixed.REFERENCE_RULES:
            hit = (s if stripped else line).rlike(T.rx(pattern))
            points = points + F.when(hit & (F.length(s) < below) if below else hit, value).otherwise(0)
        return points + F.when((points > 0) & (F.length(s) < fixed.REFERENCE_SHORT_LINE), 1).otherwise(0)

    got = df.select("x", C.reference_score(F.col("x")).alias("a"), plain(F.col("x")).alias("b")).collect()
    assert {r.x: r.a for r in got} == {r.x: r.b for r in got} and sum(r.a > 0 for r in got) > 8


def test_profile_computes_named_fields_only(spark):
    df = spark.createDataFrame([("# Alpha\nver folio\n" * 12 + "playa",)], "x string")
    whole = df.select(P.profile(F.col("x")).alias("p")).select("p.*").first().asDict()
    assert list(whole) == list(P.PROFILE) and whole["repeated_headers"]
    part = df.select(P.profile(F.col("x"), names=("term_density", "total_pages")).alias("p")).select("p.*")
    assert part.first().asDict() == {n: whole[n] for n in ("term_density", "total_pages")}
    assert "startswith" not in part._jdf.queryExecution().optimizedPlan().toString().lower()


def test_words_are_looked_for_before_patterns(spark):
    """Texts without a word that a pattern needs are spared it; odd letters that equal others without case count as these."""
    from lexloom.functions.text import count_of, quick, rx, shortest, starts
    from lexloom.operators import profile

    patterns = [p for ps in fixed.SECTION_PATTERNS.values() for p in ps]
    assert all(starts(p) for p in patterns) and shortest(["playas", "playa", "mar"]) == ["mar", "playa"]
    assert starts(r"\b(ab|words)\b") == () and starts(r"\b(colou?r|dimar)\b") == ("colo", "dimar")
    texts = ["la ley y el decreto", "sentencia t-12 y corte  constitucional", "nada", "", None, "consejo de\nestado", "leyes", "tribunal\nsala"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(*(count_of(F.col("t"), p).alias(f"a{k}") for k, p in enumerate(patterns)), *(F.regexp_count("t", F.lit(rx(quick(p)))).alias(f"b{k}") for k, p in enumerate(patterns))).collect()
    assert all(r[f"a{k}"] == r[f"b{k}"] for r in got for k in range(len(patterns)))
    found = spark.createDataFrame([("Dİmar, PLAYAſ, Dimar",), ("Rısco y ErosiÓn",), (None,)], "t string").select(profile.entities(F.col("t")).alias("e")).collect()
    assert sorted(found[0].e) == ["dimar", "playa"] and sorted(found[1].e) == ["acantilado", "erosion"] and found[2].e is None
