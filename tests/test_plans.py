import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillgraph.functions import text as T
from quillgraph.operators import dedup


def rows_of(spark, sf, name):
    """The query's rows and those of its SQL, with how often each occurs."""
    con = duckdb.connect()
    for path in sf.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    got = entry.queries()[name](spark, str(sf))
    names = ", ".join(f'"{c}"' for c in got.columns)
    want = con.execute(f"SELECT {names} FROM ({entry.oracle_sql()[name]})").fetchall()
    return Counter(map(tuple, got.collect())), Counter(want)


@pytest.fixture(scope="module")
def shared_urls(spark, tmp_path_factory):
    """Pages of which some have their URL in common, and one has two rows."""
    rng = random.Random(3)
    pool = [f"http://{host}/{lang}/{i}.html" for i in range(12) for host in ("a.org", "b.org", "c.dev") for lang in ("en", "fr")]
    rows = [(i, rng.choice(pool)) for i in range(80)]
    sf = tmp_path_factory.mktemp("urls")
    spark.createDataFrame([*rows, (0, "http://z.dev/0")], "page_id bigint, url string").coalesce(1).write.parquet(str(sf / "pages.parquet"))
    return sf


@pytest.mark.parametrize("name", ["crawl_loop"])
def test_pages_of_one_url_are_one_page_with_the_links_of_all(spark, shared_urls, name):
    got, want = rows_of(spark, shared_urls, name)
    assert got == want


@pytest.mark.parametrize("name", ["crawl_loop_stats", "crawl_loop_times"])
def test_counts_and_times_of_pages_of_one_url(spark, shared_urls, name):
    got, want = rows_of(spark, shared_urls, name)
    assert got == want


def test_texts_of_one_checksum_are_no_pair(spark, tmp_path):
    a, b = (f"banner\n\nthis line is longer than seven words {w} end" for w in ("aca", "bab"))
    assert zlib.adler32(a.encode()) == zlib.adler32(b.encode())
    rows = [(1, a), (2, b), (3, a), (4, b), (5, a), (5, b), (6, "banner\n\n"), (7, "banner\n\n"), (8, None), (9, "a\nb")]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got, want = rows_of(spark, tmp_path, "exact_dups_fingerprint")
    assert got == want == Counter([(1, 3), (1, 5), (2, 4), (2, 5), (3, 5), (4, 5), (6, 7)])


def test_pairs_of_an_id_with_two_texts_stay_within_a_text(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "b")], "id bigint, text string")
    assert sorted(tuple(r) for r in dedup.exact_pairs(df, T.adler32(F.col("text")), "id").collect()) == [(1, 2), (1, 3)]
