import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else int(v) if hasattr(v, "item") else v


def test_every_query_with_sql_agrees(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    bad = []
    for name, text in sql.items():
        df = queries[name](spark, SF)
        cols = sorted(df.columns)
        mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
        rel = con.sql(text)
        names = rel.columns
        theirs = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in rel.fetchall()), key=repr)
        if sorted(names) != cols or mine != theirs:
            bad.append(name)
    assert not bad


@pytest.mark.parametrize("name", ["stream_windows", "stream_crawl_delay"])
def test_queries_without_sql_run(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
