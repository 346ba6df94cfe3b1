import datetime

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import robots, web
from quillgraph.operators import crawl
from quillgraph.streaming import crawl_stream

ROBOTS = [
    ("User-agent: *\nDisallow: /p", "/p/1", False),
    ("User-agent: *\nAllow: /p/ok\nDisallow: /p", "/p/ok/1", True),
    ("User-agent: *\nDisallow: /p\nAllow: /p/ok", "/p/ok/1", False),
    ("User-agent: *\nDisallow:", "/x", True),
    ("User-agent: *\nAllow:", "/x", False),
    ("User-agent: *\nDisallow: /*.gif$", "/a/b.gif", False),
    ("User-agent: *\nDisallow: /*.gif$", "/a/b.gif?x", True),
    ("User-agent: *\nDisallow: /\n\nUser-agent: tts\nDisallow: /q", "/z", True),
    ("User-agent: *\nCrawl-delay: 2", "/x", True),
    ("User-agent: *\nDisallow: /a%2Fb", "/a/b", True),
    ("User-agent: *\nDisallow: /a%2Fb", "/a%2fb", False),
    ("user-agent: *\n# note\nDisallow: /c # why\r\nSitemap: http://h/s", "/c", False),
    ("Useragent: a\nUser-agent: tts\nDisallow: /d", "/d/e", False),
    ("Disallow: /d", "/d/e", True),
    ("User-agent: *\nDisallow: /a%20b", "/a%20b/c", False),
    ("User-agent: *\nDisallow: /%7Ejoe/", "/~joe/x", False),
    ("User-agent: *\nDisallow: /~joe/", "/%7ejoe/x", False),
    ("User-agent: *\nDisallow: /a%2fb", "/a%2Fb", False),
    ("User-agent: *\nDisallow: /a+b", "/a+b", False),
    ("User-agent: *\nDisallow: /a*b*c$", "/a1b2b3c", False),
    ("User-agent: *\nDisallow: /a*b*c$", "/a1b2c3", True),
    ("User-agent: *\nDisallow: /ab*ba$", "/aba", True),
    ("User-agent: *\nDisallow: /ab$", "/abc", True),
    ("User-agent: *\nDisallow: /ab$", "/ab", False),
    ("User-agent: *\nAllow: /a*c\nDisallow: /a", "/abd", False),
]


def test_robots_rules(spark):
    df = spark.createDataFrame([(b, "http://h" + u) for b, u, _ in ROBOTS], "body string, url string")
    got = df.select(robots.allowed(robots.parsed(F.col("body"))["records"], F.lit("TTS"), F.col("url")).alias("ok")).collect()
    assert [r.ok for r in got] == [w for _, _, w in ROBOTS]
    for body, url, want in ROBOTS:
        f = robots.RobotsFile()
        f.parse(body)
        assert f.can_fetch("TTS", "http://h" + url) == want


def test_robots_status_and_delay(spark):
    files = spark.createDataFrame([("a", 403, None), ("b", 404, None), ("c", 200, "User-agent: *\nDisallow: /x\nCrawl-delay: 1.5")], "domain string, status int, body string")
    urls = spark.createDataFrame([(f"http://{d}/x",) for d in "abcd"], "url string")
    assert {r.url[7]: r.allowed for r in robots.judge(urls, files, "TTS").collect()} == {"a": False, "b": True, "c": False, "d": True}
    f = robots.RobotsFile("http://c/robots.txt", lambda u: (200, "User-agent: *\nDisallow: /x\nCrawl-delay: 1.5"))
    f.read()
    assert f.crawl_delay("any") == 1.5 and f.mtime() > 0 and "Disallow: /x" in str(f)


def value(spark, column, *args):
    df = spark.createDataFrame([args], ", ".join(f"x{i} string" for i in range(len(args))))
    return df.select(column(*(F.col(f"x{i}") for i in range(len(args)))).alias("y")).first().y


def test_urls(spark):
    assert value(spark, web.identifier, "http://h/a/1234567.html") == 1234567
    assert value(spark, web.identifier, "http://h/a/b") is None
    assert value(spark, web.resolve, "2.html", "http://h/a/b/1.html") == "http://h/a/b/2.html"
    assert value(spark, web.resolve, "/x", "http://h/a/b/1.html") == "http://h/a/b//x"
    assert value(spark, web.resolve, "http://o/x", "http://h/a") == "http://o/x"
    assert value(spark, web.authority, "http://h:80/a") == "h:80"


PAGE = '<a href="o">o</a><!-- CONTENT --><a href="c">c</a><a href="s"/><!-- /CONTENT --><a href="p">p</a><script>"<a href=\'n\'>"</script>'


def test_links(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, "u", None)], "page_id int, url string, html string")
    content, other = web.links(F.col("html"))
    got = df.select(content.alias("c"), other.alias("o")).collect()
    assert (got[0].c, got[0].o) == (["c"], ["o", "p"])
    plain = df.select(web.plain_links(F.col("html"))[0].alias("c")).first().c
    assert plain == ["c"]
    assert value(spark, lambda c: web.links(c)[1], '<a href="x">x</a><a href="y" <b>') == ["x"]


def test_scanned_links_equal_parsed_ones(spark):
    pages = [PAGE, None, "", "<A HREF='x&amp;y' class=q>z</A><a name=n>n</a><a href>e</a><!-- other --><a\nhref=plain>p</a><style>a <a href='no'></style><abbr href='no'>"]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    for r in df.select(web.parsed_links(F.col("html")).alias("a"), web.scanned_links(F.col("html")).alias("b")).collect():
        assert r.a == r.b


def test_decoding(spark):
    df = spark.createDataFrame([(b"\xe9", None), ("é".encode(), "text/plain; charset=utf-8"), (b"\xff", "x; charset=utf-8"), (b"a", "x; charset=none"), (None, None)], "b binary, h string")
    assert [r.t for r in df.select(robots.decoded(F.col("b"), F.col("h")).alias("t")).collect()] == ["é", "é", None, None, None]


def test_headers(spark):
    assert tuple(value(spark, web.content_type, "Text/HTML; charset='UTF-8'")) == ("text/html", "utf-8")
    assert tuple(value(spark, web.content_type, None)) == ("", "")
    now = F.lit(datetime.datetime(2024, 1, 1)).cast("timestamp")
    week = value(spark, lambda c: web.expires(c, now), "garbage")
    assert week == datetime.datetime(2024, 1, 8)
    got = value(spark, lambda c: web.expires(c, now).cast("string"), "Thu, 01 Dec 1994 16:00:00 GMT")
    assert got == "1994-12-01 16:00:00"


def test_crawl_reaches_the_same_pages_in_fewest_rounds(spark):
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (0, 3), (3, 2), (7, 8), (2, None)], "src bigint, dst bigint")
    got = {r.page_id: r.round for r in crawl.expand(links, spark.createDataFrame([(0,)], "page_id bigint")).collect()}
    assert got == {0: 0, 1: 1, 3: 1, 2: 2}


def test_running_total_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(crawl, "BUCKET", 3)
    df = spark.createDataFrame([(i, i % 4) for i in range(10)], "page_id bigint, new bigint")
    got = {r.x: r.observed for r in crawl.heaps_curve(df).collect()}
    assert got == {i + 1: sum(j % 4 for j in range(i + 1)) for i in range(10)}


def test_recrawl(spark):
    assert value(spark, lambda c: web.recrawl(c.cast("timestamp")), None) is False
    assert value(spark, lambda c: web.recrawl(c.cast("timestamp")), "2001-01-01") is True


@pytest.fixture
def events(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [(1, base + datetime.timedelta(seconds=s)) for s in (0, 5, 12, 15, 30)] + [(2, base)]
    for i in range(2):
        spark.createDataFrame(rows[i::2], "user_id bigint, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    return str(tmp_path / "e")


def test_stream_admits_after_the_delay(spark, events, tmp_path):
    got = crawl_stream.append(crawl_stream.admit(crawl_stream.read(spark, events), "user_id", "ts", 10.0), str(tmp_path / "s"))
    assert sorted((r.user_id, r.ts.second) for r in got.where("admitted").collect()) == [(1, 0), (1, 12), (1, 30), (2, 0)]


def test_stream_goes_on_from_its_checkpoint(spark, events, tmp_path):
    at = str(tmp_path / "d")
    keys = lambda: crawl_stream.new_urls(crawl_stream.read(spark, events).select(F.col("user_id").cast("string").alias("url")))
    assert crawl_stream.append(keys(), at).count() == 2
    spark.createDataFrame([(3, datetime.datetime(2024, 1, 2)), (1, datetime.datetime(2024, 1, 2))], "user_id bigint, ts timestamp").write.mode("append").parquet(events)
    assert sorted(r.url for r in crawl_stream.append(keys(), at).collect()) == ["1", "2", "3"]
