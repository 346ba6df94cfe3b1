"""Crawling over stored pages: link tables, frontier expansion to a fixed point, statistics, growth curves and delays."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import robots, web
from quillgraph.storage import cut

BUCKET = 4096


def page_links(pages: DataFrame, found: tuple[Column, Column]) -> DataFrame:
    """(page_id, source, in_content, href) of every link; ``found`` is (content, other)."""
    content, other = found
    tagged = [_tag(c, v) for c, v in ((content, True), (other, False))]
    each = pages.select("page_id", F.col("url").alias("source"), F.explode(F.concat(*tagged)).alias("x"))
    return each.select("page_id", "source", "x.in_content", "x.href")


def _tag(hrefs: Column, content: bool) -> Column:
    return F.transform(hrefs, lambda h: F.struct(h.alias("href"), F.lit(content).alias("in_content")))


def expand(links: DataFrame, seeds: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(page_id, round): pages reached over links (src, dst) from seeds (page_id), seeds in round 0.

    A round joins its new pages with the links and drops those seen before; both are in the checkpoint folder, so a round's plan
    does not grow with the rounds before it.
    """
    seen = cut(seeds.select("page_id").distinct().withColumn("round", F.lit(0)))
    fresh, n = seen, 0
    while most_rounds is None or n < most_rounds:
        n += 1
        got = links.join(fresh.select(F.col("page_id").alias("src")), "src").select(F.col("dst").alias("page_id")).where("page_id is not null").distinct()
        fresh = cut(got.join(seen, "page_id", "left_anti").withColumn("round", F.lit(n)))
        if fresh.isEmpty():
            break
        seen = cut(seen.unionByName(fresh))
    return seen


@dataclass
class Crawl:
    """pages (url, round, status, malformed, at), one row a fetch; links (source, round, in_content, url, allowed), one row a link."""

    pages: DataFrame
    links: DataFrame


def stored(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A fetcher over stored pages (url, html): 200 and the page, or 404; of several pages of a URL the least counts."""
    kept = pages.groupBy("url").agg(F.min("html").alias("body"))
    return lambda urls: urls.join(kept, "url", "left").select("url", F.when(F.col("body").isNotNull(), 200).otherwise(404).alias("status"), "body")


def loop(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], domains: list[str], files: DataFrame | None = None, agent: str = "quillgraph", found: tuple[Column, Column] | None = None, obey_delay: bool = False, due: Callable[[Column], Column] | None = None, most_rounds: int | None = None) -> Crawl:
    """Fetches round by round until the frontier is empty.

    ``fetch`` turns (url) into (url, status, body). A link is followed if it stands in the content, on a kept domain, and the robots
    files (domain, status, body) allow it; each URL is fetched once. ``found`` gives content and other links of a page, by default
    those of the parser. ``at`` is when a fetch starts: with ``obey_delay`` the fetches of a domain follow each other by the delay
    that its file asks for, across rounds, largest number first. ``due`` says from a URL's last round whether it is to be fetched
    again (a round later); by default nothing is. Pages and links of each round are in the checkpoint folder.
    """
    found = web.links(F.col("html")) if found is None else found
    spark = seeds.sparkSession
    if files is None:
        files = spark.createDataFrame([], "domain string, status int, body string")
    files = cut(files.select("domain", "status", "body"))
    frontier = cut(seeds.select("url").distinct())
    pages = links = busy = None
    n = 0
    while (most_rounds is None or n < most_rounds) and not frontier.isEmpty():
        got = fetch(frontier).select("url", "status", F.when(F.col("status").between(200, 299), F.col("body")).alias("html"))
        got = cut(got.withColumn("round", F.lit(n)))
        timed, busy = _timed(got, files, agent, busy) if obey_delay else (got.withColumn("at", F.lit(0.0)), None)
        mine = cut(timed.select("url", "round", "status", F.coalesce(web.malformed(F.col("html")), F.lit(False)).alias("malformed"), "at"))
        pages = mine if pages is None else cut(pages.unionByName(mine))
        each = page_links(got.where("html is not null").withColumn("page_id", F.col("round")), found)
        each = each.select("source", F.col("page_id").alias("round"), "in_content", web.resolve(F.col("href"), F.col("source")).alias("url"))
        each = cut(robots.judge(each, files, agent).select("source", "round", "in_content", "url", "allowed"))
        links = each if links is None else cut(links.unionByName(each))
        follow = each.where(F.col("in_content") & F.col("allowed") & web.allowed_domain(F.col("url"), domains)).select("url").distinct()
        frontier = follow.join(pages.select("url"), "url", "left_anti")
        if due is not None:
            again = pages.groupBy("url").agg(F.max("round").alias("round")).where(due(F.col("round"))).select("url")
            frontier = frontier.unionByName(again)
        frontier = cut(frontier)
        n += 1
    if pages is None:
        pages = spark.createDataFrame([], "url string, round int, status int, malformed boolean, at double")
        links = spark.createDataFrame([], "source string, round int, in_content boolean, url string, allowed boolean")
    return Crawl(pages, links)


def _timed(got: DataFrame, files: DataFrame, agent: str, busy: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The round's fetches with ``at``, and until when each domain is busy afterwards."""
    delay = files.select("domain", F.coalesce(robots.crawl_delay(robots.parsed(robots.body_of(F.col("status"), F.col("body")))["records"], F.lit(agent)), F.lit(0.0)).alias("delay"))
    d = got.withColumn("domain", web.authority(F.col("url"))).join(delay, "domain", "left").withColumn("delay", F.coalesce("delay", F.lit(0.0)))
    if busy is not None:
        d = d.join(busy.withColumnRenamed("until", "start"), "domain", "left")
    else:
        d = d.withColumn("start", F.lit(None).cast("double"))
    d = d.withColumn("start", F.coalesce("start", F.lit(0.0)))
    rank = Window.partitionBy("domain").orderBy(F.desc(web.identifier(F.col("url"))), "url")
    d = d.withColumn("at", F.when(F.col("delay") > 0, F.col("start") + (F.row_number().over(rank) - 1) * F.col("delay")).otherwise(F.col("start")))
    now = d.groupBy("domain").agg(F.max(F.col("at") + F.col("delay")).alias("until"))
    until = now if busy is None else now.unionByName(busy).groupBy("domain").agg(F.max("until").alias("until"))
    return d.drop("domain", "delay", "start"), cut(until)


def report(done: Crawl, domains: list[str]) -> DataFrame:
    """(stat, value): the statistics of a crawl, with pages fetched and failed fetches by code."""
    errors = done.pages.where(~F.col("status").between(200, 299)).select(F.col("status").cast("string").alias("code"))
    rows = stats(done.links, domains, errors, done.pages.where("malformed"))
    return done.pages.agg(F.count("*").alias("value")).select(F.lit("pages").alias("stat"), "value").unionByName(rows)


def next_of_domain(frontier: DataFrame) -> DataFrame:
    """(domain, url_id, url): the URL of the largest number on each domain, the next to be fetched."""
    w = Window.partitionBy("domain").orderBy(F.desc("url_id"), "url")
    return frontier.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def stats(links: DataFrame, domains: list[str], errors: DataFrame, failed_parses: DataFrame) -> DataFrame:
    """(stat, value): totals and distinct counts over (in_content, url, allowed); errors (code) by code, and failed pages by number."""
    c, off = F.col("in_content"), ~web.allowed_domain(F.col("url"), domains)
    private = c & ~off & ~F.col("allowed")
    wanted = {
        "urls": F.lit(True), "content urls": c, "other urls": ~c, "off-domain urls": c & off, "private urls": private,
    }
    sums = links.agg(*(F.count(F.when(k, 1)).alias(n) for n, k in wanted.items()), *(F.count_distinct(F.when(k, F.col("url"))).alias(f"distinct {n}") for n, k in wanted.items() if n != "urls"))
    names = sums.columns
    rows = sums.select(F.explode(F.create_map(*(x for n in names for x in (F.lit(n), F.col(f"`{n}`"))))).alias("stat", "value"))
    codes = errors.groupBy(F.concat(F.lit("error "), F.col("code")).alias("stat")).agg(F.count("*").alias("value"))
    return rows.unionByName(codes).unionByName(failed_parses.select(F.lit("parse errors").alias("stat"), F.lit(1).alias("n")).agg(F.count("n").alias("value")).select(F.lit("parse errors").alias("stat"), "value"))


def running_total(df: DataFrame, order: str, value: str, levels: int = 3) -> DataFrame:
    """``df`` with x (rows up to and including this one) and total, in the order of a whole number.

    Sums go by buckets of the order first, and by buckets of buckets again, so that windows never span more than a bucket of
    ``BUCKET`` numbers and, at the last of so many levels, the list of the largest buckets.
    """
    d = df.select("*", F.col(order).alias("_o"), F.lit(1).cast("long").alias("_n"), F.col(value).alias("_s"))
    return _before(d, levels).withColumns({"x": F.col("_n0") + F.col("_n"), "total": F.col("_s0") + F.col("_s")}).drop("_o", "_n", "_s", "_n0", "_s0")


def _before(d: DataFrame, levels: int) -> DataFrame:
    """``d`` with _n0 and _s0, the sums of _n and _s over the rows of smaller _o."""
    if levels <= 1:
        w = Window.orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
        return d.withColumns({f"{c}0": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in ("_n", "_s")})
    d = d.withColumn("_b", F.floor(F.col("_o") / BUCKET))
    sums = d.groupBy(F.col("_b").alias("_o")).agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    outer = _before(sums, levels - 1).select(F.col("_o").alias("_b"), F.col("_n0").alias("_n1"), F.col("_s0").alias("_s1"))
    w = Window.partitionBy("_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({f"{c}0": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in ("_n", "_s")}).join(outer, "_b")
    return d.withColumns({"_n0": F.col("_n0") + F.col("_n1"), "_s0": F.col("_s0") + F.col("_s1")}).drop("_b", "_n1", "_s1")


def heaps_curve(pages: DataFrame, k: float = 100.0, beta: float = 0.4) -> DataFrame:
    """(x, observed, expected): new URLs after x pages (page_id, new), and k x**beta."""
    t = running_total(pages, "page_id", "new")
    return t.select(F.col("x").cast("long").alias("x"), F.col("total").alias("observed"), (k * F.pow("x", F.lit(beta))).alias("expected"))


def delay_gaps(fetches: DataFrame, delay: float, key: str, ts: str, order: str) -> DataFrame:
    """``fetches`` with the seconds since the key's last one, and whether they reach the delay; null and true for the first."""
    w = Window.partitionBy(key).orderBy(ts, order)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = (at - F.lag(at).over(w)) / 1e6
    return fetches.withColumn("gap", gap).withColumn("kept", F.coalesce(F.col("gap") >= delay, F.lit(True)))
