"""Rows of a Spark query and of its SQL, in a form that compares."""

from __future__ import annotations

import math
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, Decimal):
        return float(v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr(tuple(plain(r[k]) for k in order)) for r in rows)


def compare(spark, query, sql: str, sf_dir: str) -> tuple[int, int, list]:
    """Numbers of rows, and up to three that differ. Names and integer widths must agree too."""
    import duckdb

    df = query(spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    kinds = {c[0]: str(c[1]) for c in found.description}
    theirs = found.fetchall()
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for name, kind in df.dtypes:
        if kind in same:
            assert kinds[name] == same[kind], (name, kind, kinds[name])
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, theirs)
    return len(a), len(b), [x for x in zip(a, b) if x[0] != x[1]][:3]
