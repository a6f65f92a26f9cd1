"""The driver tables in the shapes that document operators read, in Spark and in DuckDB SQL alike.

The invented prose has no blank-line paragraphs, headings or legal phrases, so lines are decorated in turn. This is a
fixture for both engines, not part of any operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import spread, table

#: What stands before and after line i of document d, chosen by (d + i) modulo the number of entries.
DECORATIONS = (
    ("## I. ANTECEDENTES\n", ""),
    ("", " jurisdicción14 y la ley 12 de 2022 3, según CPT-012-21 34."),
    ("ver folio 12 ", ""),
    ("## II. CONSIDERACIONES DE LA SALA. El Tribunal estudia la demanda presentada, ", ""),
    ("", " la playa y el Puerto de la bahía según decreto 1234 del consejo de estado"),
    ("pág. 3 ver el expediente ", ""),
    ("## IV.\nRESUELVE\n", ""),
    ("Radicación: 2021-00 ", ""),
    ("", " de la concesi6n, el pr0ceso y la apelaci6n que"),
    ("2. ", " y la"),
    ("3001234567 @@ ## %%", ""),
    ("![fig](/data/img/plano uno.png) ", " la prueba pericial"),
    ("Tribunal Administrativo página 7\n", " inter-\nrumpida"),
    ("Encabezado común 12", ""),
)


def prefixes() -> list[str]:
    return [a for a, _ in DECORATIONS]


def suffixes() -> list[str]:
    return [b for _, b in DECORATIONS]


def decorated(separator: str = "\n\n") -> Column:
    n = len(DECORATIONS)
    before, after = (F.array(*(F.lit(x) for x in xs)) for xs in (prefixes(), suffixes()))
    at = lambda i: F.pmod(F.col("doc_id") + i, F.lit(n)).cast("int")
    # The repeated header stands alone; other decorations keep their line.
    line = lambda x, i: F.when(at(i) == n - 1, F.get(before, at(i))).otherwise(F.concat(F.get(before, at(i)), x, F.get(after, at(i))))
    return F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line), separator)


def documents(spark: SparkSession, sf_dir: str, separator: str = "\n\n") -> DataFrame:
    """``doc_id, text``: decorated, computed once per row."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.explode(F.array(decorated(separator))).alias("text"))


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def documents_sql(separator: str = "\n\n") -> str:
    """A SELECT of ``doc_id, text`` equal to :func:`documents`."""
    n = len(DECORATIONS)
    before, after = ("[" + ", ".join(quote(x) for x in xs) + "]" for xs in (prefixes(), suffixes()))
    at = f"((doc_id + i - 1) % {n}) + 1"
    return (
        f"SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: "
        f"CASE WHEN {at} = {n} THEN ({before})[{at}] ELSE ({before})[{at}] || x || ({after})[{at}] END), {quote(separator)}) AS text FROM documents"
    )
