"""Command line: ranked runs, duplicate pairs, link scores, network summaries and crawls over files.

    python -m quillgraph overlap QUERIES DOCS OUT
    python -m quillgraph tfidf QUERIES DOCS OUT [-k 2]
    python -m quillgraph feedback QUERIES DOCS OUT [-k 0.75] [-d 19] [-w 38]
    python -m quillgraph search QUERIES DOCS RELEVANT OUT
    python -m quillgraph duplicates FOLDER OUT [-e] [--no-zlib] [-s 4] [-b 128] [--no-groups]
    python -m quillgraph links EDGES OUT [--iterations 10] [--known hub:NODE:0.9:1]
    python -m quillgraph network EDGES ALIASES ROLES MAIL VOCABULARY OUT [-n 8] [--more-than 4]
    python -m quillgraph crawl PAGES OUT --seed URL --domain NAME [--robots FILES] [--obey_crawl_delay]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import crawl, dedup, fingerprint, linkgraph, mail, plateau, retrieval
from quillgraph.sources import readers, sinks
from quillgraph.storage import cut


def _asked(spark: SparkSession, path: str) -> DataFrame:
    return retrieval.term_counts(readers.terms(spark, path)).withColumnRenamed("doc_id", "query_id")


def overlap(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.run_file(retrieval.overlap(_asked(spark, a.queries), retrieval.corpus(readers.terms(spark, a.docs))), a.out)


def tfidf(spark: SparkSession, a: argparse.Namespace) -> None:
    asked = _asked(spark, a.queries).withColumnRenamed("tf", "weight")
    sinks.run_file(retrieval.tfidf(asked, retrieval.corpus(readers.terms(spark, a.docs)), a.k), a.out)


def feedback(spark: SparkSession, a: argparse.Namespace) -> None:
    got = retrieval.feedback(_asked(spark, a.queries), retrieval.corpus(readers.terms(spark, a.docs)), retrieval.single(spark, a.k, a.d, a.w))
    sinks.run_file(got.drop("run"), a.out)


def search(spark: SparkSession, a: argparse.Namespace) -> None:
    """Mean average precision at every point of the parameter grid; RELEVANT has lines of query, ignored, document, relevance."""
    w = T.tokens(F.col("value"))
    judged = spark.read.text(a.relevant).where(F.size(w) >= 4).select(*(F.get(w, F.lit(i)).try_cast("bigint").alias(n) for i, n in ((0, "query_id"), (2, "doc_id"), (3, "rel"))))
    grid = retrieval.grid(spark)
    scores = retrieval.feedback(_asked(spark, a.queries), retrieval.corpus(readers.terms(spark, a.docs)), grid)
    ap = retrieval.average_precision(scores, judged.where("rel > 0").select("query_id", "doc_id"), by=("run",))
    sinks.grid_blocks(ap.groupBy("run").agg(F.avg("ap").alias("map")).join(grid, "run").select("k", "n_d", "n_w", "map"), a.out)


def duplicates(spark: SparkSession, a: argparse.Namespace) -> None:
    """Exact, near and plateau pairs in three folders of OUT."""
    d = readers.speeches(spark, a.folder).select(F.col("id").try_cast("bigint").alias("id"), T.clean_speech(F.col("text")).alias("text")).where("id is not null and text is not null")
    d = cut(d.withColumn("words", T.tokens(F.col("text"))))
    key = dedup.same_words(F.col("words")) if a.exact else T.adler32(F.col("text")) if a.zlib else T.manual_checksum(F.col("text"))
    sinks.pair_file(dedup.exact_pairs(d, key, "id"), f"{a.out}/exact")
    for name, words in (("near", d.select("id", "words")), ("plateau", plateau.spans(d.select("id", "words")).select("id", F.col("plateau").alias("words")))):
        prints = words.select("id", fingerprint.simhash(F.col("words"), a.bits).alias("print"))
        sinks.pair_file(dedup.near_pairs(prints, a.bits // 4, a.distance, a.groups), f"{a.out}/{name}")


def links(spark: SparkSession, a: argparse.Namespace) -> None:
    messages = readers.edge_list(spark, a.edges)
    edges = cut(linkgraph.edges(messages))
    linkgraph.stats(edges).show(truncate=False)
    linkgraph.message_runs(messages, "file", "at").show()
    known = {k: (node, float(low), float(high)) for k, node, low, high in (x.split(":") for x in a.known)}
    sinks.score_file(linkgraph.pagerank(edges, iterations=a.iterations), f"{a.out}/pagerank", known=known.get("pagerank"))
    both = cut(linkgraph.hits(edges, a.iterations))
    for column in ("hub", "authority"):
        sinks.score_file(both, f"{a.out}/{column}", column, known.get(column))


def network(spark: SparkSession, a: argparse.Namespace) -> None:
    known = readers.aliases(spark, a.aliases)
    messages = cut(linkgraph.rename(readers.edge_list(spark, a.edges), known))
    edges = cut(linkgraph.edges(messages))
    chosen = linkgraph.interesting(edges, linkgraph.pagerank(edges), a.n)
    kept = linkgraph.two_core(linkgraph.relations(edges, chosen, a.more_than))
    subjects = readers.mail_archive(spark, a.mail).select("msg_id", T.subject_terms(F.col("subject")).alias("terms"))
    subjects = mail.known_terms(subjects, readers.vocabulary(spark, a.vocabulary))
    labelled = mail.labels(kept, linkgraph.message_ids(messages), subjects)
    people = readers.roles(spark, a.roles, known=known).select(F.col("alias").alias("email"), mail.person(F.col("alias"), F.col("extra")).alias("person"))
    for end in ("src", "dst"):
        names = mail.with_people(kept.select(F.col(end).alias("node")).distinct(), people).select(F.col("node").alias(end), mail.description(F.struct("name", "job", "extra")).alias(f"{end}_name"))
        labelled = labelled.join(names, end)
    sinks.dot_file(labelled.select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "label"), a.out)


def crawl_pages(spark: SparkSession, a: argparse.Namespace) -> None:
    """Fetches stored pages from the seeds on, over content links that the domains and robots files allow, and prints statistics."""
    files = spark.read.parquet(a.robots) if a.robots else None
    seeds = spark.createDataFrame([(s,) for s in a.seed], "url string")
    done = crawl.loop(seeds, crawl.stored(spark.read.parquet(a.pages)), a.domain, files, a.agent, obey_delay=a.obey_crawl_delay)
    crawl.report(done, a.domain).show(1000, truncate=False)
    done.pages.withColumnRenamed("url", "page_id").write.mode("overwrite").parquet(a.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillgraph")
    sub = top.add_subparsers(required=True)

    def add(name, run, *places):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for x in places:
            p.add_argument(x)
        return p

    add("overlap", overlap, "queries", "docs", "out")
    add("tfidf", tfidf, "queries", "docs", "out").add_argument("-k", type=float, default=2.0)
    p = add("feedback", feedback, "queries", "docs", "out")
    for flag, kind in (("-k", float), ("-d", int), ("-w", int)):
        p.add_argument(flag, type=kind, default=0)
    add("search", search, "queries", "docs", "relevant", "out")
    p = add("duplicates", duplicates, "folder", "out")
    p.add_argument("-e", "--exact", action="store_true")
    p.add_argument("--no-zlib", dest="zlib", action="store_false")
    p.add_argument("-s", "--distance", type=int, default=4)
    p.add_argument("-b", "--bits", type=int, default=128)
    p.add_argument("--no-groups", dest="groups", action="store_false")
    p = add("links", links, "edges", "out")
    p.add_argument("--iterations", type=int, default=10)
    p.add_argument("--known", action="append", default=[], metavar="SCORES:NODE:LOW:HIGH", help="write no such scores unless the node's lies between")
    p = add("network", network, "edges", "aliases", "roles", "mail", "vocabulary", "out")
    p.add_argument("-n", type=int, default=8)
    p.add_argument("--more-than", type=int, default=4)
    p = add("crawl", crawl_pages, "pages", "out")
    p.add_argument("--seed", action="append", required=True)
    p.add_argument("--domain", action="append", required=True)
    p.add_argument("--robots")
    p.add_argument("--agent", default="quillgraph")
    p.add_argument("--obey_crawl_delay", "--obey-crawl-delay", action="store_true")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    a.run(spark or SparkSession.builder.appName("quillgraph").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate(), a)


if __name__ == "__main__":
    main()
