"""Runs a registered query and its SQL, and compares the rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def same(df, sql, sf_dir):
    columns, rows = oracle(sql, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got, rows = sorted(got, key=key), sorted(rows, key=key)
    assert len(got) == len(rows)
    assert [tuple(r) for r in got] == [tuple(r) for r in rows]
