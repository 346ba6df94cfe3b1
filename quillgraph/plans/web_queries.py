"""Queries over pages, URLs, robots rules, crawls and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import robots, web
from quillgraph.operators import crawl
from quillgraph.plans import tables
from quillgraph.storage import folder
from quillgraph.streaming import crawl_stream

#: The pages have no content comments; their navigation stands for the content.
OPEN, CLOSE = "<nav>", "</nav>"
#: The domains that the crawl keeps to are those of most pages.
KEPT_DOMAINS = 5
#: The loop keeps to more of them, and starts from every so many pages.
LOOP_DOMAINS, SEEDS = 40, 10
AGENT = "quillbot"
#: Robots files by the top of the domain: (top, status, body); one path is escaped.
FILES = (
    ("com", 200, "User-agent: *\nDisallow: /d%65/\nDisallow: /*.html$\n"),
    ("org", 200, "User-agent: other\nDisallow: /\n\nUser-agent: QUILL # us\nAllow: /en/1\nDisallow: /en/\nCrawl-delay: 2\n"),
    ("net", 403, None),
)

LINK = web.LINK.replace("'", "''")
PLAIN = f"""
parts AS (SELECT page_id, url, flatten(list_transform(string_split(html, '{OPEN}'), lambda p: string_split(p, '{CLOSE}'))) AS parts FROM pages),
found AS (SELECT page_id, url, true AS in_content, regexp_extract_all(array_to_string(list_filter(parts, lambda p, i: i % 2 = 0), ' '), '{LINK}', 1) AS hrefs FROM parts
  UNION ALL SELECT page_id, url, false, regexp_extract_all(array_to_string(list_filter(parts, lambda p, i: i % 2 = 1), ' '), '{LINK}', 1) FROM parts),
links AS (SELECT page_id, url AS source, in_content, unnest(hrefs) AS href FROM found),
resolved AS (SELECT *, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href ELSE regexp_extract(source, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') || regexp_replace(regexp_extract(source, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '[^/]*$', '') || href END AS link FROM links)"""
PATH = "regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
HOST = "regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
LOCAL = "regexp_replace({}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '')"


def _allowed_sql(url: str) -> str:
    local, host = LOCAL.format(url), HOST.format(url)
    return f"""CASE WHEN {host} LIKE '%.com' THEN NOT (starts_with({local}, '/de/') OR regexp_matches({local}, '^/.*\\.html$'))
WHEN {host} LIKE '%.org' THEN starts_with({local}, '/en/1') OR NOT starts_with({local}, '/en/') WHEN {host} LIKE '%.net' THEN false ELSE true END"""


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "pages")


def _links(spark: SparkSession, sf: str) -> DataFrame:
    links = crawl.page_links(_pages(spark, sf), web.plain_links(F.col("html"), OPEN, CLOSE))
    return links.withColumn("link", web.resolve(F.col("href"), F.col("source")))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """A robots file for every domain of the pages."""
    kinds = spark.createDataFrame(FILES, "top string, status int, body string")
    domains = _pages(spark, sf).select(web.authority(F.col("url")).alias("domain")).distinct()
    return domains.withColumn("top", F.element_at(F.split("domain", r"\."), -1)).join(F.broadcast(kinds), "top").select("domain", "status", "body")  # three rows


def _domains(spark: SparkSession, sf: str, n: int = KEPT_DOMAINS) -> list[str]:
    rows = _pages(spark, sf).groupBy(web.authority(F.col("url")).alias("domain")).count().orderBy(F.desc("count"), "domain").limit(n)
    return [r["domain"] for r in rows.collect()]


def _marked() -> F.Column:
    """Pages with content comments around their navigation."""
    return F.replace(F.replace("html", F.lit(OPEN), F.lit(web.OPEN + OPEN)), F.lit(CLOSE), F.lit(CLOSE + web.CLOSE))


def content_links_parser(spark: SparkSession, sf: str) -> DataFrame:
    found = _pages(spark, sf).select("page_id", F.explode(web.parsed_links(_marked())).alias("x"))
    return found.select("page_id", "x.pos", "x.href", "x.in_content")


def content_links_scanned(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("page_id", F.inline(web.scanned_links(_marked())))


def content_links_regex(spark: SparkSession, sf: str) -> DataFrame:
    return _links(spark, sf).select("page_id", "in_content", "href")


def url_identifier(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("page_id", web.identifier(F.col("url")).alias("identifier"))


def resolve_relative(spark: SparkSession, sf: str) -> DataFrame:
    return _links(spark, sf).select("page_id", "link")


def domain_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).where(web.allowed_domain(F.col("url"), _domains(spark, sf))).select("page_id", "url")


def robots_rules(spark: SparkSession, sf: str) -> DataFrame:
    d = _files(spark, sf).select("domain", robots.parsed(robots.body_of(F.col("status"), F.col("body"))).alias("r"))
    record = robots.record_for(F.col("r.records"), F.lit(AGENT))
    rule = F.explode(F.transform(record["rules"], lambda x, i: F.struct(i.cast("int").alias("pos"), x["allow"].alias("allow"), x["path"].alias("path"))))
    return d.select("domain", record["crawl_delay"].alias("crawl_delay"), rule.alias("x")).select("domain", "crawl_delay", "x.*")


def robots_allowed(spark: SparkSession, sf: str) -> DataFrame:
    return robots.judge(_pages(spark, sf).select("page_id", "url"), _files(spark, sf), AGENT).select("page_id", "allowed")


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    """A made-up link table over the pages' numbers, as the pages' own links lead outside."""
    ids = _pages(spark, sf).select("page_id")
    n = ids.count()
    return ids.select(F.col("page_id").alias("src"), F.explode(F.array((F.col("page_id") * 7 + 1) % n, (F.col("page_id") * 3 + 2) % n)).alias("dst"))


def crawl_rounds(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.expand(_numbered(spark, sf), spark.createDataFrame([(0,)], "page_id bigint"))


def crawl_fixpoint(spark: SparkSession, sf: str) -> DataFrame:
    return crawl_rounds(spark, sf).select("page_id")


def next_fetches(spark: SparkSession, sf: str) -> DataFrame:
    d = _pages(spark, sf).select(web.authority(F.col("url")).alias("domain"), web.identifier(F.col("url")).alias("url_id"), "url").where("url_id is not null")
    return crawl.next_of_domain(d)


def crawl_stats(spark: SparkSession, sf: str) -> DataFrame:
    links = _links(spark, sf).withColumn("url", F.col("link"))
    judged = robots.judge(links, _files(spark, sf), AGENT)
    errors = tables.table(spark, sf, "events").where("event_type = 'error'").select((400 + F.col("user_id") % 5).cast("string").alias("code"))
    return crawl.stats(judged, _domains(spark, sf), errors, _pages(spark, sf).where(web.malformed(F.col("html"))))


def heaps_curve(spark: SparkSession, sf: str) -> DataFrame:
    """New links after each page, a link being new on the first page that has it."""
    first = _links(spark, sf).where("in_content").groupBy("href").agg(F.min("page_id").alias("page_id")).groupBy("page_id").agg(F.count("*").alias("new"))
    per_page = _pages(spark, sf).select("page_id").join(first, "page_id", "left").withColumn("new", F.coalesce("new", F.lit(0)))
    return crawl.heaps_curve(per_page).withColumn("expected", F.round("expected", 6))


def crawl_delay_gaps(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.table(spark, sf, "events").select("event_id", "user_id", "ts")
    return crawl.delay_gaps(e, 600.0, "user_id", "ts", "event_id").select("event_id", F.round("gap", 6).alias("gap"), "kept")


def stream_dedup_urls(spark: SparkSession, sf: str) -> DataFrame:
    pages = crawl_stream.read(spark, f"{sf}/pages.parquet")
    urls = crawl.page_links(pages, web.plain_links(F.col("html"), OPEN, CLOSE)).select(F.col("href").alias("url"))
    return crawl_stream.append(crawl_stream.new_urls(urls), folder(spark, "stream"))


def stream_crawl_counters(spark: SparkSession, sf: str) -> DataFrame:
    events = crawl_stream.read(spark, f"{sf}/events.parquet")
    return crawl_stream.latest(crawl_stream.counters(events, F.col("event_type"), F.col("value").cast("decimal(18,2)")), folder(spark, "stream")).withColumn("total", F.col("total").cast("double"))


def stream_crawl_delay(spark: SparkSession, sf: str) -> DataFrame:
    events = crawl_stream.read(spark, f"{sf}/events.parquet")
    got = crawl_stream.append(crawl_stream.admit(events, "user_id", "ts", 600.0), folder(spark, "stream"))
    return got.select("user_id", F.unix_micros("ts").alias("ts_us"), "admitted")


def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that have closed by the end of the input."""
    events = crawl_stream.read(spark, f"{sf}/events.parquet")
    got = crawl_stream.append(crawl_stream.windowed(events, "ts", "event_type"), folder(spark, "stream"))
    return got.select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "event_type", "n")


def _own(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, url): the least URL of each page number."""
    return _pages(spark, sf).groupBy("page_id").agg(F.min("url").alias("url"))


#: The pages as a web of their own: each links to two others by their URLs, and to one that does not exist. Pages of one URL are one
#: page with the links of all of them, malformed if all are.
def _web(spark: SparkSession, sf: str) -> DataFrame:
    own = _own(spark, sf)
    links = _numbered(spark, sf).join(own.select(F.col("page_id").alias("dst"), F.col("url").alias("to")), "dst").select("src", "to")
    gone = own.where("page_id % 5 = 0").select(F.col("page_id").alias("src"), F.concat("url", F.lit("/gone")).alias("to"))
    each = own.join(links.unionByName(gone), F.col("page_id") == F.col("src"), "left")
    anchors = F.array_sort(F.collect_list(F.concat(F.lit('<a href="'), "to", F.lit('">x</a>'))))
    whole = each.groupBy("url").agg(F.array_join(anchors, "").alias("a"), F.min(F.col("page_id") % 11 == 0).alias("bad"))
    html = F.concat(F.lit("<html><nav>"), "a", F.lit("</nav>"), F.when(F.col("bad"), "<p").otherwise("<p>"))
    return whole.select("url", html.alias("html"))


def _crawled(spark: SparkSession, sf: str, **options: bool) -> crawl.Crawl:
    seeds = _own(spark, sf).where(F.col("page_id") % SEEDS == 0).select("url")
    return crawl.loop(seeds, crawl.stored(_web(spark, sf)), _domains(spark, sf, LOOP_DOMAINS), _files(spark, sf), AGENT, web.plain_links(F.col("html"), OPEN, CLOSE), **options)


def crawl_loop(spark: SparkSession, sf: str) -> DataFrame:
    return _crawled(spark, sf).pages.select("url", "round", "status", "malformed")


def crawl_loop_stats(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.report(_crawled(spark, sf), _domains(spark, sf, LOOP_DOMAINS))


def crawl_loop_times(spark: SparkSession, sf: str) -> DataFrame:
    """When each page is fetched if the delays are kept to."""
    return _crawled(spark, sf, obey_delay=True).pages.select("url", "at")


_DOMAINS = f"SELECT domain FROM (SELECT {HOST.format('url')} AS domain, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, domain LIMIT {KEPT_DOMAINS})"
_STATS = [("content urls", "in_content"), ("other urls", "NOT in_content"), ("off-domain urls", "in_content AND off"), ("private urls", "in_content AND NOT off AND NOT allowed")]

NUMBER = "try_cast(list_last(string_split(split_part({}, '.', 1), '/')) AS BIGINT)"
WEB = f"""n AS (SELECT count(*) AS n FROM pages), own AS (SELECT page_id, min(url) AS url FROM pages GROUP BY 1), kept AS ({_DOMAINS.replace(f"LIMIT {KEPT_DOMAINS}", f"LIMIT {LOOP_DOMAINS}")}),
web AS (SELECT url, min(page_id % 11 = 0) AS malformed FROM own GROUP BY url),
made AS (SELECT page_id AS src, unnest([(page_id * 7 + 1) % n, (page_id * 3 + 2) % n]) AS dst FROM pages CROSS JOIN n),
pairs AS (SELECT a.url AS src, b.url AS dst FROM made JOIN own a ON a.page_id = made.src JOIN own b ON b.page_id = made.dst UNION ALL SELECT url, url || '/gone' FROM own WHERE page_id % 5 = 0),
links AS MATERIALIZED (SELECT src, dst, {HOST.format('dst')} NOT IN (SELECT domain FROM kept) AS off, {_allowed_sql('dst')} AS allowed FROM pairs)"""
WALK = f"""walk(url, round) AS (SELECT url, 0 FROM own WHERE page_id % {SEEDS} = 0 UNION SELECT dst, round + 1 FROM walk JOIN links ON src = walk.url AND NOT off AND allowed WHERE round < 60),
reached AS (SELECT walk.url, min(round)::INT AS round, CASE WHEN any_value(web.url) IS NULL THEN 404 ELSE 200 END AS status, coalesce(bool_or(malformed), false) AS malformed FROM walk LEFT JOIN web ON web.url = walk.url GROUP BY walk.url)"""

LINKS = f"""WITH tags AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<(script|style)>.*?</(script|style)>', '', 'g'), '<nav>|</nav>|<a href="[^"]*">')) AS tag, generate_subscripts(regexp_extract_all(regexp_replace(html, '<(script|style)>.*?</(script|style)>', '', 'g'), '<nav>|</nav>|<a href="[^"]*">'), 1) AS n FROM pages),
said AS (SELECT page_id, n, tag, last_value(CASE WHEN tag = '<nav>' THEN true WHEN tag = '</nav>' THEN false END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY n) AS inside FROM tags)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY n) - 1)::INT AS pos, tag[10:-3] AS href, coalesce(inside, false) AS in_content FROM said WHERE starts_with(tag, '<a ')"""

QUERIES = {
    # Every link of the tables' pages is well-formed, so cutting at the tags finds what a parser finds.
    "content_links_parser": (content_links_parser, LINKS),
    "content_links_scanned": (content_links_scanned, LINKS),
    "content_links_regex": (content_links_regex, f"WITH {PLAIN} SELECT page_id, in_content, href FROM links"),
    "url_identifier": (url_identifier, f"SELECT page_id, try_cast(list_last(string_split(split_part({PATH.format('url')}, '.', 1), '/')) AS BIGINT) AS identifier FROM pages"),
    "resolve_relative": (resolve_relative, f"WITH {PLAIN} SELECT page_id, link FROM resolved"),
    "domain_filter": (domain_filter, f"SELECT page_id, url FROM pages WHERE {HOST.format('url')} IN ({_DOMAINS})"),
    "robots_rules": (
        robots_rules,
        f"""WITH rules(top, crawl_delay, pos, allow, path) AS (VALUES ('com', NULL::DOUBLE, 0, false, '/de/'), ('com', NULL, 1, false, '/*.html$'), ('org', 2, 0, true, '/en/1'), ('org', 2, 1, false, '/en/'), ('net', NULL, 0, false, '/'))
SELECT domain, crawl_delay, pos, allow, path FROM (SELECT DISTINCT {HOST.format('url')} AS domain FROM pages) JOIN rules ON top = list_last(string_split(domain, '.'))""",
    ),
    "robots_allowed": (robots_allowed, f"SELECT page_id, {_allowed_sql('url')} AS allowed FROM pages"),
    "crawl_rounds": (
        crawl_rounds,
        "WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), walk(page_id, round) AS (SELECT 0::BIGINT, 0 UNION SELECT unnest([(page_id * 7 + 1) % n, (page_id * 3 + 2) % n]), round + 1 FROM walk CROSS JOIN n WHERE round < 40) SELECT page_id, min(round)::INT AS round FROM walk GROUP BY 1",
    ),
    "crawl_fixpoint": (crawl_fixpoint, "WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), walk(page_id) AS (SELECT 0::BIGINT UNION SELECT unnest([(page_id * 7 + 1) % n, (page_id * 3 + 2) % n]) FROM walk CROSS JOIN n) SELECT page_id FROM walk"),
    "next_fetches": (next_fetches, f"SELECT domain, url_id, url FROM (SELECT {HOST.format('url')} AS domain, try_cast(list_last(string_split(split_part({PATH.format('url')}, '.', 1), '/')) AS BIGINT) AS url_id, url FROM pages) WHERE url_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY domain ORDER BY url_id DESC, url) = 1"),
    "crawl_stats": (
        crawl_stats,
        f"WITH {PLAIN}, kept AS ({_DOMAINS}), judged AS (SELECT in_content, link, {HOST.format('link')} NOT IN (SELECT domain FROM kept) AS off, {_allowed_sql('link')} AS allowed FROM resolved) "
        + "SELECT 'urls' AS stat, count(*) AS value FROM judged"
        + "".join(f" UNION ALL SELECT '{n}', count(*) FROM judged WHERE {w} UNION ALL SELECT 'distinct {n}', count(DISTINCT link) FROM judged WHERE {w}" for n, w in _STATS)
        + " UNION ALL SELECT 'error ' || (400 + user_id % 5), count(*) FROM events WHERE event_type = 'error' GROUP BY 1 UNION ALL SELECT 'parse errors', count(*) FROM pages WHERE regexp_matches(html, '<[A-Za-z/!][^<>]*(<|$)')",
    ),
    "heaps_curve": (
        heaps_curve,
        f"""WITH {PLAIN}, first AS (SELECT page_id, count(*) AS new FROM (SELECT href, min(page_id) AS page_id FROM links WHERE in_content GROUP BY href) GROUP BY page_id)
SELECT x, observed, round(100 * pow(x, 0.4), 6) AS expected FROM (SELECT row_number() OVER w AS x, sum(coalesce(new, 0)) OVER w::BIGINT AS observed FROM pages LEFT JOIN first USING (page_id) WINDOW w AS (ORDER BY page_id))""",
    ),
    "crawl_delay_gaps": (crawl_delay_gaps, "SELECT event_id, round(gap, 6) AS gap, coalesce(gap >= 600, true) AS kept FROM (SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events)"),
    "stream_dedup_urls": (stream_dedup_urls, f"WITH {PLAIN} SELECT DISTINCT href AS url FROM links"),
    "stream_crawl_counters": (stream_crawl_counters, "SELECT event_type AS counter, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY 1"),
    "stream_crawl_delay": (
        stream_crawl_delay,
        """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us FROM events), admitted(user_id, us) AS (SELECT user_id, min(us) FROM e GROUP BY user_id
UNION ALL SELECT a.user_id, min(e.us) FROM admitted a JOIN e ON e.user_id = a.user_id AND e.us >= a.us + 600000000 GROUP BY a.user_id)
SELECT user_id, us AS ts_us, n = 1 AND EXISTS (SELECT 1 FROM admitted a WHERE a.user_id = x.user_id AND a.us = x.us) AS admitted FROM (SELECT user_id, us, row_number() OVER (PARTITION BY user_id, us) AS n FROM e) x""",
    ),
    # All events come in one batch, after which windows that end by ten minutes before the last event are closed.
    "stream_windows": (
        stream_windows,
        """WITH e AS (SELECT epoch_us(ts) AS us, event_type FROM events), w AS (SELECT us - us % 3600000000 AS start_us, event_type, count(*) AS n FROM e GROUP BY ALL)
SELECT start_us, start_us + 3600000000 AS end_us, event_type, n FROM w WHERE start_us + 3600000000 <= (SELECT max(us) - 600000000 FROM e)""",
    ),
    "crawl_loop": (crawl_loop, f"WITH RECURSIVE {WEB}, {WALK} SELECT url, round, status, malformed FROM reached"),
    "crawl_loop_stats": (
        crawl_loop_stats,
        f"""WITH RECURSIVE {WEB}, {WALK}, followed AS (SELECT true AS in_content, dst AS url, off, allowed FROM links WHERE src IN (SELECT url FROM reached WHERE status = 200))
SELECT 'pages' AS stat, count(*) AS value FROM reached UNION ALL SELECT 'urls', count(*) FROM followed"""
        + "".join(f" UNION ALL SELECT '{n}', count(*) FROM followed WHERE {w} UNION ALL SELECT 'distinct {n}', count(DISTINCT url) FROM followed WHERE {w}" for n, w in _STATS)
        + " UNION ALL SELECT 'error ' || status, count(*) FROM reached WHERE status <> 200 GROUP BY 1 UNION ALL SELECT 'parse errors', count(*) FROM reached WHERE malformed",
    ),
    "crawl_loop_times": (crawl_loop_times, f"WITH RECURSIVE {WEB}, {WALK}, ranked AS (SELECT url, round, {HOST.format('url')} AS host, row_number() OVER (PARTITION BY {HOST.format('url')} ORDER BY round, {NUMBER.format(PATH.format('url'))} DESC NULLS LAST, url) - 1 AS before FROM reached) SELECT url, CASE WHEN host LIKE '%.org' THEN 2.0 * before ELSE 0 END::DOUBLE AS at FROM ranked"),
}
