"""Rows of a Spark query and of its oracle in one form."""

from __future__ import annotations

import math


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple(sorted((str(k), norm(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return bytes(value) if isinstance(value, (bytes, bytearray)) else value


def spark_rows(df) -> tuple[list[str], list]:
    names = sorted(df.columns)
    return names, sorted((tuple(norm(r[n]) for n in names) for r in df.collect()), key=repr)


def duck_rows(con, sql: str) -> tuple[list[str], list]:
    result = con.execute(sql)
    found = [d[0] for d in result.description]
    names = sorted(found)
    return names, sorted((tuple(norm(r[found.index(n)]) for n in names) for r in result.fetchall()), key=repr)
