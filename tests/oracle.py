"""A query's rows against its SQL's, as the driver compares them."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    cols = sorted(df.columns)
    df = df.astype({c: "float64" for c in cols if str(df[c].dtype).startswith("Int")})  # integers with nulls, as Spark gives them
    return cols, sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))


def expected(sql, sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return rows(c.sql(sql).df())


def same(query, sql, spark, sf):
    got, want = rows(query(spark, sf).toPandas()), expected(sql, sf)
    assert got[0] == want[0]
    assert got[1] == want[1]
    return got[1]
