"""Compare a query with its SQL, run by DuckDB over the same Parquet tables."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """A value that sorts and compares alike from either engine."""
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def ordered(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def by_sql(sf_dir, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if (path := Path(sf_dir, f"{t}.parquet")).exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    found = con.execute(sql)
    return {d[0]: str(d[1]) for d in found.description}, found.fetchall()


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN"}


def check(spark, query, sql, sf_dir, least=1):
    df = query(spark, sf_dir)
    names, rows = by_sql(sf_dir, sql)
    assert sorted(df.columns) == sorted(names)
    assert {c: KINDS.get(k, names[c]) for c, k in df.dtypes} == names
    got, want = ordered(df.columns, df.collect()), ordered(list(names), rows)
    assert len(got) == len(want) >= least
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not wrong, f"{len(wrong)} of {len(got)} rows differ, first {wrong[0]}"
