"""Compares a query with its SQL in DuckDB: columns by name, rows in any order."""

from pathlib import Path

import duckdb


def compare(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    rows = want.fetchall()
    got = query(spark, sf_dir)
    assert sorted(got.columns) == sorted(names), (got.columns, names)
    order = sorted(names)
    key = lambda r: [str(x) for x in r]
    norm = lambda v: round(float(v), 9) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    a = sorted(([norm(r[c]) for c in order] for r in got.collect()), key=key)
    b = sorted(([norm(r[names.index(c)]) for c in order] for r in rows), key=key)
    assert len(a) == len(b), (len(a), len(b))
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not bad, bad[:3]
