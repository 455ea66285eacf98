"""Rows of a query and of its SQL in one comparable form."""

import decimal
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize()) if v else "0"
    if hasattr(v, "asDict"):
        v = list(v)
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return v if v is None else str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())


def rows_of_sql(con, sql):
    r = con.sql(sql)
    cols = sorted(r.columns)
    at = [r.columns.index(c) for c in cols]
    return cols, sorted(repr([norm(x[i]) for i in at]) for x in r.fetchall())
