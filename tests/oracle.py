import os

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, values):
    at = [names.index(c) for c in sorted(names)]
    return sorted(repr(tuple(v[i] for i in at)) for v in values)


def agree(df, sql):
    """Do a DataFrame and SQL on the smallest tables give the same columns and rows?"""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, found.fetchall())


there = os.path.isdir(SF)
