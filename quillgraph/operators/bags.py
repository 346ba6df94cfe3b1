"""Multisets as (elem, n) rows, with counts of either sign.

Every operator is one aggregation keyed by element: both sides are stacked and summed, so sides that are already partitioned by
``elem`` meet without another shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count(df: DataFrame, elem: Column) -> DataFrame:
    return df.groupBy(elem.alias("elem")).agg(F.count("*").alias("n"))


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    """(elem, x, y) with 0 for what one side lacks."""
    stacked = a.select("elem", F.col("n").alias("x"), F.lit(0).cast("long").alias("y")).unionByName(b.select("elem", F.lit(0).cast("long").alias("x"), F.col("n").alias("y")))
    return stacked.groupBy("elem").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


def _keep(df: DataFrame, n: Column) -> DataFrame:
    return df.select("elem", n.alias("n")).where("n > 0")


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return _keep(_both(a, b), F.col("x") + F.col("y"))


def subtract_positive(a: DataFrame, b: DataFrame) -> DataFrame:
    """a - b; a negative count on the right alone becomes positive."""
    return _keep(_both(a, b), F.col("x") - F.col("y"))


def union_max(a: DataFrame, b: DataFrame) -> DataFrame:
    return _keep(_both(a, b), F.greatest("x", "y"))


def intersect_min(a: DataFrame, b: DataFrame) -> DataFrame:
    return _keep(_both(a, b), F.least("x", "y"))


def update(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sums that keep counts of zero and below."""
    return _both(a, b).select("elem", (F.col("x") + F.col("y")).alias("n"))


def subtract_signed(a: DataFrame, b: DataFrame) -> DataFrame:
    return _both(a, b).select("elem", (F.col("x") - F.col("y")).alias("n"))


def without(a: DataFrame, elem: object) -> DataFrame:
    return a.where(F.col("elem") != F.lit(elem))


def elements(a: DataFrame) -> DataFrame:
    """Each element as often as it counts; none for counts below one."""
    return a.where("n > 0").select(F.explode(F.array_repeat("elem", F.col("n").cast("int"))).alias("elem"))


def most_common(a: DataFrame, n: int | None = None) -> DataFrame:
    """By count, then element; the n first only, by a heap in each task, if n is given."""
    ordered = a.select("elem", "n").orderBy(F.desc("n"), "elem")
    return ordered if n is None else ordered.limit(n)


def map_merge(a: Column, b: Column, how: str) -> Column:
    """The same on map columns: how is add, subtract, max or min; only positive counts stay."""
    zero = F.lit(0).cast("long")
    f = {"add": lambda x, y: x + y, "subtract": lambda x, y: x - y, "max": F.greatest, "min": F.least}[how]
    merged = F.map_zip_with(a, b, lambda _, x, y: f(F.coalesce(x, zero), F.coalesce(y, zero)))
    return F.map_filter(merged, lambda _, n: n > 0)
