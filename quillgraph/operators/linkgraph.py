"""Directed multigraphs of messages: statistics, PageRank, HITS, interesting nodes and the 2-core of relations.

Edges are aggregated to (src, dst, mult) once. Iterations join them with one row a node and are written to the checkpoint folder each
time, so that plans stay short and a lost executor costs one iteration. Scalars (sink mass, norms) come back as single numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.storage import cut

DAMPING, ITERATIONS = 0.8, 10


def rename(messages: DataFrame, aliases: DataFrame) -> DataFrame:
    """Messages with both ends replaced by their alias, if (email, alias) has one."""
    for end in ("src", "dst"):
        names = aliases.select(F.col("email").alias(end), F.col("alias").alias("_alias"))
        messages = messages.join(names, end, "left").withColumn(end, F.coalesce("_alias", end)).drop("_alias")
    return messages


def edges(messages: DataFrame) -> DataFrame:
    """(src, dst, mult) without edges from a node to itself."""
    return messages.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("mult"))


def nodes(edges_: DataFrame) -> DataFrame:
    return edges_.select(F.col("src").alias("node")).unionByName(edges_.select(F.col("dst").alias("node"))).distinct()


def sinks(edges_: DataFrame) -> DataFrame:
    """Nodes that receive and never send."""
    return edges_.select(F.col("dst").alias("node")).distinct().join(edges_.select(F.col("src").alias("node")), "node", "left_anti")


def message_ids(messages: DataFrame) -> DataFrame:
    """(src, msg_id): distinct messages of each sender over kept edges."""
    return messages.where("src <> dst").select("src", "msg_id").distinct()


def message_runs(messages: DataFrame, bucket: str, line: str) -> DataFrame:
    """Runs of equal msg_id in the order of (bucket, line), as one row.

    Changes are counted within each bucket and then between the last row of a bucket and the first of the next, so no task ever
    holds more than a bucket and the list of buckets.
    """
    w = Window.partitionBy(bucket).orderBy(line)
    within = messages.withColumn("new", (F.lag("msg_id").over(w) != F.col("msg_id")).cast("long"))
    at = F.struct(line, "msg_id")
    each = within.groupBy(bucket).agg(F.coalesce(F.sum("new"), F.lit(0)).alias("changes"), F.min(at).alias("first"), F.max(at).alias("last"))
    over = Window.orderBy(bucket)
    joined = each.withColumn("step", F.coalesce((F.lag("last.msg_id").over(over) != F.col("first.msg_id")).cast("long"), F.lit(1)))
    return joined.agg(F.coalesce(F.sum(F.col("changes") + F.col("step")), F.lit(0)).cast("long").alias("runs"))


def stats(edges_: DataFrame) -> DataFrame:
    """One row: senders, recipients, both, either, and whether the counts agree."""
    each = edges_.select(F.col("src").alias("node"), F.lit(1).alias("s"), F.lit(0).alias("r")).unionByName(edges_.select(F.col("dst").alias("node"), F.lit(0).alias("s"), F.lit(1).alias("r")))
    each = each.groupBy("node").agg(F.max("s").alias("s"), F.max("r").alias("r"))
    out = each.agg(F.sum("s").alias("senders"), F.sum("r").alias("recipients"), F.sum(F.col("s") * F.col("r")).alias("both"), F.count("*").alias("either"))
    return out.withColumn("consistent", F.col("senders") + F.col("recipients") - F.col("both") == F.col("either"))


def pagerank(edges_: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS, start: DataFrame | None = None) -> DataFrame:
    """(node, score); sinks give their mass to all nodes alike. ``start`` continues from earlier scores."""
    out = edges_.groupBy("src").agg(F.sum("mult").alias("total"))
    shares = cut(edges_.join(out, "src").select("src", "dst", (F.col("mult") / F.col("total")).alias("share")))
    all_nodes = cut(nodes(edges_).join(out.select(F.col("src").alias("node"), F.lit(False).alias("sink")), "node", "left").select("node", F.coalesce("sink", F.lit(True)).alias("sink")))
    n = all_nodes.count()
    if not n:
        return all_nodes.select("node", F.lit(0.0).alias("score"))
    ranks = all_nodes.withColumn("score", F.lit(1.0 / n)) if start is None else all_nodes.join(start, "node")
    for _ in range(iterations):
        mass = ranks.where("sink").agg(F.sum("score")).first()[0] or 0.0
        gained = shares.join(ranks.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("score")).alias("gain"))
        base = (1 - damping + damping * mass) / n
        ranks = cut(all_nodes.join(gained, "node", "left").select("node", "sink", (F.lit(base) + damping * F.coalesce("gain", F.lit(0.0))).alias("score")))
    check_total(ranks.agg(F.sum("score")).first()[0])
    return ranks.select("node", "score")


def hits(edges_: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """(node, hub, authority); hubs first, then authorities from the new hubs, each scaled to length one."""
    all_nodes = cut(nodes(edges_))
    links = cut(edges_)
    n = all_nodes.count()
    if not n:
        return all_nodes.select("node", F.lit(0.0).alias("hub"), F.lit(0.0).alias("authority"))
    auth = all_nodes.withColumn("score", F.lit(1 / math.sqrt(n)))
    hub = auth

    def step(score: DataFrame, of: str, to: str) -> DataFrame:
        got = links.join(score.select(F.col("node").alias(of), "score"), of).groupBy(F.col(to).alias("node")).agg(F.sum(F.col("mult") * F.col("score")).alias("raw"))
        raw = cut(all_nodes.join(got, "node", "left").select("node", F.coalesce("raw", F.lit(0.0)).alias("raw")))
        norm = math.sqrt(raw.agg(F.sum(F.col("raw") * F.col("raw"))).first()[0]) or 1.0
        return raw.select("node", (F.col("raw") / norm).alias("score"))

    for _ in range(iterations):
        hub = step(auth, "dst", "src")
        auth = step(hub, "src", "dst")
    check_total(hub.agg(F.sum(F.col("score") ** 2)).first()[0])
    check_total(auth.agg(F.sum(F.col("score") ** 2)).first()[0])
    return hub.withColumnRenamed("score", "hub").join(auth.withColumnRenamed("score", "authority"), "node")


def check_total(total: float, low: float = 0.99, high: float = 1.01) -> None:
    """Fails if scores that must add up to one do not."""
    if not low < total < high:
        raise ValueError(f"scores add up to {total}")


def check_node(scores: DataFrame, node: object, low: float, high: float, column: str = "score") -> bool:
    """Whether a known node's score lies between two values; results are kept from a sink otherwise."""
    row = scores.where(F.col("node") == F.lit(node)).select(column).first()
    return row is not None and low < row[0] < high


def top(scores: DataFrame, n: int = 10, column: str = "score", places: int = 8) -> DataFrame:
    return scores.select("node", F.round(column, places).alias(column)).orderBy(F.desc(column), "node").limit(n)


def nth_contact(edges_: DataFrame, n: int = 2) -> DataFrame:
    """(src, dst): each sender's n-th most mailed contact; none for senders with fewer."""
    w = Window.partitionBy("src").orderBy(F.desc("mult"), "dst")
    return edges_.withColumn("r", F.row_number().over(w)).where(F.col("r") == n).select("src", "dst")


def interesting(edges_: DataFrame, scores: DataFrame, n: int = 8) -> DataFrame:
    """(node): the n best nodes and the second most mailed contact of each."""
    best = top(scores, n).select("node")
    contacts = nth_contact(edges_).join(best.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"))
    return best.unionByName(contacts).distinct()


def relations(edges_: DataFrame, chosen: DataFrame | None = None, more_than: int = 4) -> DataFrame:
    """(src, dst, mult) of more than so many messages, both ends among the chosen nodes."""
    kept = edges_.where(F.col("mult") > more_than)
    if chosen is not None:
        for end in ("src", "dst"):
            kept = kept.join(chosen.select(F.col("node").alias(end)), end, "left_semi")
    return kept.select("src", "dst", "mult")


def two_core(relations_: DataFrame, least: int = 2) -> DataFrame:
    """Relations left after dropping those at nodes with fewer than two neighbours in either direction, again and again."""
    kept = cut(relations_)
    size = kept.count()
    while size:
        both = kept.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(kept.select(F.col("dst").alias("node"), F.col("src").alias("other")))
        weak = both.distinct().groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") < least).select("node")
        for end in ("src", "dst"):
            kept = kept.join(weak.select(F.col("node").alias(end)), end, "left_anti")
        kept = cut(kept.select("src", "dst", "mult"))
        now = kept.count()
        if now == size:
            break
        size = now
    return kept


def score_lines(scores: DataFrame, column: str = "score") -> DataFrame:
    """Lines of a score file, best first."""
    return scores.orderBy(F.desc(column), "node").select(F.format_string("%.8f %s", F.col(column), F.col("node").cast("string")).alias("line"))
