"""Plateaus: the span of a text that holds many numbers, with as many other words as possible outside of it.

Runs of numbers and of other words alternate. For number runs a <= b, neither of them the text's last run, the score is the words
before a, plus a slope for every number after run a through run b, plus the words after b. The best a for each b is a running
maximum, so the search is linear in the number of runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import is_number
from quillgraph.storage import cut

SLOPE = 100


def runs(words: DataFrame) -> DataFrame:
    """(id, run, numbers, words_through, tags_before, numbers_through, tags_after, runs) from (id, words)."""
    each = words.select("id", F.posexplode("words").alias("at", "word")).withColumn("num", is_number(F.col("word")))
    order = Window.partitionBy("id").orderBy("at")
    change = F.when(F.col("num") != F.lag("num").over(order), 1).otherwise(0)
    numbered = each.withColumn("run", F.sum(change).over(order).cast("int"))
    sized = numbered.groupBy("id", "run").agg(F.first("num").alias("numbers"), F.count("*").alias("size"))
    o = Window.partitionBy("id").orderBy("run")
    every = Window.partitionBy("id")
    tags = F.when(F.col("numbers"), 0).otherwise(F.col("size"))
    return sized.select(
        "id", "run", "numbers",
        F.sum("size").over(o).alias("words_through"),
        (F.sum(tags).over(o) - tags).alias("tags_before"),
        F.sum(F.col("size") - tags).over(o).alias("numbers_through"),
        (F.sum(tags).over(every) - F.sum(tags).over(o) + tags).alias("tags_after"),
        F.count("*").over(every).alias("runs"),
    )


def spans(words: DataFrame, slope: int = SLOPE) -> DataFrame:
    """(id, score, a, b, plateau) for texts whose plateau holds at least three numbers. ``words`` has id and an array of words."""
    words = cut(words)
    table = cut(runs(words))
    o = Window.partitionBy("id").orderBy("run")
    open_ = table.where(F.col("numbers") & (F.col("run") <= F.col("runs") - 2))
    left = F.struct((F.col("tags_before") - slope * F.col("numbers_through")).alias("gain"), (-F.col("run")).alias("a"))
    best = open_.withColumn("best", F.max(left).over(o))
    best = best.select("id", F.struct((-(F.col("best.gain") + slope * F.col("numbers_through") + F.col("tags_after"))).alias("score"), (-F.col("best.a")).alias("a"), F.col("run").alias("b")).alias("x"))
    best = best.groupBy("id").agg(F.min("x").alias("x")).where("x.score < 0")
    some = table.groupBy("id").agg(F.max("runs").alias("runs"), F.max("numbers").alias("any")).where("any")
    chosen = some.join(best, "id", "left").select("id", F.coalesce(-F.col("x.score"), F.lit(0)).alias("score"), F.coalesce("x.a", F.lit(0)).alias("a"), F.coalesce("x.b", F.col("runs").cast("int") - 1).alias("b"))
    ends = table.select("id", "run", "words_through")
    ends = chosen.join(ends, "id").where("run in (a, b)").groupBy("id", "score", "a", "b").agg(F.min("words_through").alias("lo"), F.max("words_through").alias("hi"))
    got = words.join(ends, "id").withColumn("plateau", F.expr("slice(words, cast(lo as int), cast(hi - lo + 1 as int))"))
    return got.where(F.size(F.filter("plateau", is_number)) >= 3).select("id", F.col("score").cast("long").alias("score"), "a", "b", "plateau")
