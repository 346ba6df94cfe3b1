"""The driver's tables in the roles that the operators give them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import retrieval


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, once: bool = False) -> retrieval.Corpus:
    return retrieval.corpus(table(spark, sf_dir, "documents"), once=once)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, term, tf) of the benchmark's items."""
    return retrieval.term_counts(table(spark, sf_dir, "benchmark"), "item_id").withColumnRenamed("doc_id", "query_id")


def relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(msg_id, src, dst, day, line): every line of an order is a message from its customer to a part's number."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("src"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("dst"), F.col("l_shipdate").alias("day"), "l_linenumber", "l_suppkey")
    return li.join(o, "l_orderkey").select(F.col("l_orderkey").alias("msg_id"), "src", "dst", "day", F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("line"))
