"""Compares a Spark result with DuckDB's for the same tables."""

import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            p = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def canon(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def assert_parity(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    rel = connect(sf_dir).sql(sql)
    assert cols == sorted(rel.columns)
    got = canon(df.select(*cols).collect())
    want = canon(rel.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert len(got) == len(want), (len(got), len(want))
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not bad, bad[:5]
