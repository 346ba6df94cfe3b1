"""Connected components of undirected links, by alternating large and small stars, each round in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.storage import cut

#: A key of more than one in so many rows, and of more than a few, is joined apart.
HOT, FEW = 1000, 100


def join_hot(rows: DataFrame, table: DataFrame, key: list[str], total: int) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row a key and in ``n`` how many of ``rows`` have it.

    Keys of more than one in HOT of ``total`` rows, of which there are fewer than HOT, come by broadcast, all others by the key.
    """
    often = F.col("n") > max(FEW, total // HOT)
    hot, cold = F.broadcast(table.where(often).drop("n")), table.where(~often).drop("n")
    rest = rows.join(hot.select(*key), key, "left_anti").join(cold, key)
    return rows.join(hot, key).unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root being the smallest node reachable."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    n, seen = e.count(), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = cut(join_hot(both.where("v > u"), low, ["u"], n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, low, ["u"], n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        n, seen = state[0], state
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
