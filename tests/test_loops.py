import random
import re

import pytest
from pyspark.sql import functions as F

from quillgraph import __main__ as cli
from quillgraph import storage
from quillgraph.functions import web
from quillgraph.operators import components as C
from quillgraph.operators import crawl, dedup, mail


def page(*hrefs):
    return "<html><!-- CONTENT -->" + "".join(f'<a href="{h}">x</a>' for h in hrefs) + '<!-- /CONTENT --><a href="http://a.org/9.html">other</a></html>'


WEB = {
    "http://a.org/1.html": page("2.html", "http://b.org/3.html", "http://off.net/4.html"),
    "http://a.org/2.html": page("1.html", "private/5.html", "6.html"),
    "http://b.org/3.html": page("7.html", "8.html"),
    "http://b.org/7.html": page("http://a.org/2.html"),
    "http://b.org/8.html": page() + "<p",
}
ROBOTS = [("a.org", 200, "User-agent: *\nDisallow: /private/\nCrawl-delay: 3\n"), ("b.org", 404, None)]


@pytest.fixture(scope="module")
def stored(spark):
    pages = spark.createDataFrame(list(WEB.items()), "url string, html string")
    return pages, spark.createDataFrame(ROBOTS, "domain string, status int, body string")


def crawled(spark, stored, **options):
    pages, files = stored
    seeds = spark.createDataFrame([("http://a.org/1.html",)], "url string")
    return crawl.loop(seeds, crawl.stored(pages), ["a.org", "b.org"], files, "tts", **options)


def test_loop_runs_until_the_frontier_is_empty(spark, stored):
    done = crawled(spark, stored)
    got = {r.url.rsplit("/", 1)[1][0]: (r.round, r.status, r.malformed) for r in done.pages.collect()}
    assert got == {"1": (0, 200, False), "2": (1, 200, False), "3": (1, 200, False), "6": (2, 404, False), "7": (2, 200, False), "8": (2, 200, True)}
    stats = {r.stat: r.value for r in crawl.report(done, ["a.org", "b.org"]).collect()}
    assert (stats["pages"], stats["content urls"], stats["other urls"]) == (6, 9, 5)
    assert (stats["off-domain urls"], stats["private urls"], stats["error 404"], stats["parse errors"]) == (1, 1, 1, 1)
    assert stats["distinct content urls"] == 8 and stats["distinct other urls"] == 1


def test_fetches_of_a_domain_keep_its_delay(spark, stored):
    at = {r.url.rsplit("/", 1)[1][0]: r.at for r in crawled(spark, stored, obey_delay=True).pages.collect()}
    assert at == {"1": 0.0, "2": 3.0, "6": 6.0, "3": 0.0, "7": 0.0, "8": 0.0}


def test_urls_that_are_due_are_fetched_again(spark, stored):
    done = crawled(spark, stored, due=lambda last: last < 2, most_rounds=4)
    rounds = {}
    for r in done.pages.collect():
        rounds.setdefault(r.url.rsplit("/", 1)[1][0], []).append(r.round)
    assert {k: sorted(v) for k, v in rounds.items()} == {"1": [0, 1, 2], "2": [1, 2], "3": [1, 2], "6": [2], "7": [2], "8": [2]}


def test_no_seeds(spark, stored):
    pages, files = stored
    done = crawl.loop(spark.createDataFrame([], "url string"), crawl.stored(pages), ["a.org"], files)
    assert done.pages.collect() == [] and {r.stat: r.value for r in crawl.report(done, ["a.org"]).collect()}["pages"] == 0


def test_crawl_command(spark, stored, tmp_path, capfd):
    pages, files = stored
    pages.write.parquet(f"{tmp_path}/pages")
    files.write.parquet(f"{tmp_path}/robots")
    cli.main(["crawl", f"{tmp_path}/pages", f"{tmp_path}/out", "--seed", "http://a.org/1.html", "--domain", "a.org", "--domain", "b.org", "--robots", f"{tmp_path}/robots", "--obey_crawl_delay"], spark)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6
    assert re.search(r"error 404\s*\|\s*1", capfd.readouterr().out)


def test_components_with_a_hot_node(spark, monkeypatch):
    monkeypatch.setattr(C, "FEW", 3)
    monkeypatch.setattr(C, "HOT", 10)
    rng = random.Random(2)
    edges = [(500, i) for i in range(40)] + [(i, i + 1) for i in range(600, 640)] + [(700 + rng.randrange(9), 800 + rng.randrange(9)) for _ in range(12)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}


def slow_classes(prints, near):
    ids = sorted(prints)
    links = {i: [j for j in ids if j != i and near(prints[i], prints[j])] for i in ids}
    out = {}
    for i in ids:
        if not links[i]:
            continue
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (min(seen), len(links[i]))
    return out


@pytest.mark.parametrize("bands", [True, False])
@pytest.mark.parametrize("with_empty", [True, False])
def test_near_classes_equal_brute_force(spark, bands, with_empty):
    rng = random.Random(7)
    bases = [rng.getrandbits(32) for _ in range(6)]
    prints = {}
    for i in range(90):
        x = rng.choice(bases)
        for _ in range(rng.randrange(4)):
            x ^= 1 << rng.randrange(32)
        prints[i] = f"{x:08x}"
    if with_empty:
        prints |= {90: "", 91: ""}

    def near(a, b):
        if not a or not b:
            return not bands
        if bands:
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 2
        return (int(a, 16) ^ int(b, 16)).bit_count() <= 2

    df = spark.createDataFrame([*prints.items(), (99, None)], "id bigint, print string")
    got = {r.id: (r.class_id, r.links) for r in dedup.near_classes(df, 8, 2, bands).collect()}
    assert got == slow_classes(prints, near)


def test_known_words(spark):
    subjects = spark.createDataFrame([(1, ["b", "a", "b", "x"]), (2, ["x"]), (3, None)], "msg_id int, terms array<string>")
    words = spark.createDataFrame([("a",), ("b",)], "word string")
    assert [(r.msg_id, r.terms) for r in mail.known_terms(subjects, words).collect()] == [(1, ["b", "a", "b"])]
    mails = spark.createDataFrame([(1, "b 7 a\nb"), (2, "x"), (3, None)], "msg_id int, body string")
    assert sorted((r.word, r.n) for r in mail.known_body_words(mails, words).collect()) == [("a", 1), ("b", 2)]


def test_running_total_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(crawl, "BUCKET", 4)
    rows = [(i * 3, i % 5) for i in range(300)]
    got = sorted((r.k, r.x, r.total) for r in crawl.running_total(spark.createDataFrame(rows, "k bigint, v bigint"), "k", "v").collect())
    total, want = 0, []
    for n, (k, v) in enumerate(rows):
        total += v
        want.append((k, n + 1, total))
    assert got == want


class _Session:
    """As much of a session as the folder's choice looks at."""

    def __init__(self, master, named=None):
        self.sparkContext = type("C", (), {"master": master})
        self.conf = {"spark.checkpoint.dir": named}


def test_shared_folder_is_the_named_one_or_local_on_one_machine_only():
    assert storage.shared(_Session("spark://x:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert storage.shared(_Session("local[4]")) == storage.shared(_Session("local"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared(_Session("local-cluster[2,1,1024]"))


def test_stored_pages_of_one_url_are_one(spark):
    pages = spark.createDataFrame([("u", "b"), ("u", "a")], "url string, html string")
    got = crawl.stored(pages)(spark.createDataFrame([("u",), ("v",)], "url string")).orderBy("url").collect()
    assert [(r.url, r.status, r.body) for r in got] == [("u", 200, "a"), ("v", 404, None)]
    assert web.links(F.col("html")) is not None
