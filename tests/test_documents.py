"""Sections, chunks, profiles, quality, images."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lexloom.functions import fixed
from lexloom.operators import images, profile as P, sections as S


def test_sections(spark):
    text = "previo\n\n## I. ANTECEDENTES\nhecho\n\n## Otro título\nmás\n\n## IV.\n\nRESUELVE:\nniega\n## Consideraciones\nx"
    rows = S.split_documents(spark.createDataFrame([(1, text), (2, "sin títulos"), (3, "")], "doc_id int, text string")).orderBy("doc_id", "section_index").collect()
    assert [(r.section_index, r.section_name) for r in rows[:4]] == list(fixed.SECTION_NAMES.items())
    assert [r.section_heading for r in rows[:4]] == ["I. ANTECEDENTES", "", "Consideraciones", "RESUELVE:"]
    assert rows[0].page_content == "previo\n\n## I. ANTECEDENTES\nhecho\n\n## Otro título\nmás"
    assert [r.page_content for r in rows[1:4]] == ["", "## Consideraciones\nx", "## IV.\n\nRESUELVE:\nniega"]
    assert [r.page_content for r in rows[4:8]] == ["sin títulos", "", "", ""]
    assert [r.page_content for r in rows[8:]] == ["", "", "", ""]


def test_chunks(spark):
    text = " ".join(f"Parrafo {i}" for i in range(80))
    docs = spark.createDataFrame([("/x/sentencia_2024.pdf", 1, text), ("/x/sentencia_2024.pdf", 2, "  ")], "source string, section_index int, page_content string")
    rows = S.chunk(docs, 120, 10).collect()
    assert len(rows) > 1 and [r.chunk_index for r in rows] == list(range(len(rows)))
    assert all(r.chunk_id == f"sentencia_2024_s1_c{r.chunk_index}" and r.total_chunks_in_section == len(rows) for r in rows)
    assert all(len(r.page_content) <= 120 for r in rows)


def test_splitter_properties():
    draw = random.Random(3)
    for _ in range(200):
        text = "".join(draw.choice(["palabra", " ", ". ", "\n", "\n\n", "x" * 40, "é"]) for _ in range(draw.randint(0, 80)))
        chunks = S.Splitter(50, 10).split(text)
        assert all(0 < len(c) <= 50 and c == c.strip() for c in chunks)
        at = 0
        for c in chunks:  # in order, with overlap at most
            found = text.find(c, max(0, at - 60))
            assert found >= 0
            at = found + len(c)
        plain = S.Splitter(50, 0).split(text)
        assert "".join("".join(c.split()) for c in plain) == "".join(text.split())


def test_splitter_exact_size_recurses():
    """A piece of exactly the size is not below it, so it is split further."""
    assert S.Splitter(10, 0).split("aaaa aaaaa") == ["aaaa aaaaa"]
    assert S.Splitter(10, 2).split("x" * 25) == ["x" * 10, "x" * 10, "x" * 9]


def test_classes(spark):
    df = spark.createDataFrame([(1, "República de Colombia"), (2, "La ley y el decreto, según la norma"), (3, "nada"), (4, "prueba y demanda")], "i int, t string")
    rows = {r.i: (r.k.section_type, r.k.score) for r in df.select("i", P.classify_paragraph(F.col("t")).alias("k")).collect()}
    assert rows == {1: ("metadata", 0.6), 2: ("legal_basis", 0.6), 3: ("analysis", 0.0), 4: ("claims", 0.2)}


def test_quality_report(spark):
    df = spark.createDataFrame([(1, "La playa y el puerto de la bahía.\n\nEl juez decide.", "La playa y el puerto de la bahía.\n\nEl juez decide.")], "i int, a string, b string")
    r = P.quality_report(df, "a", "b").first()
    assert r.paragraph_score == 85.0 and r.footer_removal_score == 100.0 and r.entity_score == 100.0 and r.heading_score == 50.0
    assert r.entity_count == 3 and r.section_counts == {"analysis": 1, "decision": 1}
    parts = 85 * 0.2 + 100 * 0.15 + r.ocr_cleanup_score * 0.15 + 100 * 0.1 + r.section_segmentation_score * 0.2 + 100 * 0.2
    assert abs(r.final_quality - parts) < 1e-9


def test_images(spark):
    rows = [
        (1, 0, 100, 100, "a", 500.0, True), (1, 1, 400, 400, "b", 500.0, True), (1, 2, 400, 400, "b", 500.0, True), (1, 3, 400, 400, "c", 50.0, True),
        (1, 4, 400, 400, "d", 500.0, False), (2, 0, 500, 400, "e", 1.0, True), (2, 1, 900, 400, "f", 1.0, True), (2, 2, 600, 400, "g", 1.0, True),
    ]
    df = spark.createDataFrame(rows, "doc_id int, pos int, width int, height int, md5 string, variance double, has_context boolean")
    got = {(r.doc_id, r.pos): r.remove_reason for r in images.filter_images(df).collect()}
    assert [got[1, i] for i in range(5)] == ["too_small", None, "duplicate_hash", "low_variance", "no_semantic_context"]
    assert [got[2, i] for i in range(3)] == ["low_variance", None, None]
    refs = spark.createDataFrame([("Figura ![a](x y.png) y ![](z.png)",)], "t string").select(images.image_refs(F.col("t")).alias("r")).first().r
    assert [x.ref for x in refs] == ["x y.png", "z.png"] and "Figura" in refs[1].context
