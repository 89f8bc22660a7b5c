"""Comparison of a Spark result with DuckDB SQL: columns by name, rows in any order."""

from __future__ import annotations

import math


def canonical(rows: list[dict]) -> list[tuple]:
    def one(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, float):
            return "None" if math.isnan(v) else f"{v:.9g}"
        if isinstance(v, int):
            return f"{float(v):.9g}"
        return str(v)

    return sorted(tuple(one(r[k]) for k in sorted(r)) for r in rows)


def same(df, con, sql: str) -> None:
    spark_rows = [r.asDict() for r in df.collect()]
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    sql_rows = [dict(zip(names, r)) for r in rel.fetchall()]
    assert sorted(df.columns) == sorted(names)
    a, b = canonical(spark_rows), canonical(sql_rows)
    assert len(a) == len(b), (len(a), len(b))
    differ = [(x, y) for x, y in zip(a, b) if x != y]
    assert not differ, differ[:3]
