"""Holds a Spark result against DuckDB's."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(pdf):
    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        return x.item() if hasattr(x, "item") else x

    names = sorted(pdf.columns)
    return names, sorted((tuple(plain(x) for x in r) for r in pdf[names].itertuples(index=False)), key=repr)


def differences(spark_pdf, duck_pdf, limit=3):
    (a, x), (b, y) = rows_of(spark_pdf), rows_of(duck_pdf)
    if a != b:
        return [f"columns {sorted(set(a) ^ set(b))}"]
    if len(x) != len(y):
        return [f"{len(x)} rows, {len(y)} in SQL"]
    return [[(n, p, q) for n, p, q in zip(a, r, s, strict=True) if p != q] for r, s in zip(x, y, strict=True) if r != s][:limit]
