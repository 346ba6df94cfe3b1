"""Readers for the text formats that the operators start from. Lines that do not parse are dropped or null, never an error."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T


def terms(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) from lines of a number and terms; lines without a number are dropped."""
    words = T.tokens(F.col("value"))
    d = spark.read.text(path).select(F.get(words, F.lit(0)).try_cast("bigint").alias("doc_id"), F.array_join(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), " ").alias("text"))
    return d.where("doc_id is not null")


def speeches(spark: SparkSession, folder: str) -> DataFrame:
    """(id, text) of every ``.txt`` file, the name without its last extension as id."""
    d = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return d.select(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", "").alias("id"), F.col("value").alias("text"))


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, msg_id, src, dst) from lines of three columns. (file, at) keeps the order of lines: at is the partition-wise position."""
    words = T.tokens(F.col("value"))
    d = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), words.alias("w"))
    return d.where(F.size("w") >= 3).select("file", "at", F.get("w", F.lit(0)).alias("msg_id"), F.get("w", F.lit(1)).alias("src"), F.get("w", F.lit(2)).alias("dst"))


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """(email, alias) from lines ``alias : e1,e2,``; of several aliases of an address the last line's counts."""
    d = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    parts = F.split("value", ":", 2)
    each = d.select("at", F.trim(F.get(parts, F.lit(0))).alias("alias"), F.explode(F.split(F.get(parts, F.lit(1)), ",")).alias("email"))
    each = each.withColumn("email", T.strip(F.col("email"))).where("email <> ''")
    return each.groupBy("email").agg(F.max_by("alias", "at").alias("alias"))


def roles(spark: SparkSession, path: str, domain: str = "example.com", special: dict[str, str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """(email, alias, extra) from lines of user, tab and role text; ``special`` names addresses that differ from user@domain."""
    d = spark.read.csv(path, sep="\t", schema="user string, extra string", quote="")
    email = F.concat("user", F.lit("@" + domain))
    for user, address in sorted((special or {}).items()):
        email = F.when(F.col("user") == user, address).otherwise(email)
    d = d.select(email.alias("email"), "extra")
    if known is None:
        return d.select("email", F.col("email").alias("alias"), "extra")
    return d.join(known, "email", "left").select("email", F.coalesce("alias", "email").alias("alias"), "extra")


def mail_archive(spark: SparkSession, path: str) -> DataFrame:
    """(msg_id, subject, body) of records ``<DOC> path``, headers, an empty line, text, ``</DOC>``; the path's third part is the id, or its last."""
    d = spark.read.option("lineSep", "</DOC>").text(path).where(F.contains("value", F.lit("<DOC>")))
    record = F.regexp_replace(F.regexp_replace("value", "\r\n", "\n"), r"(?s)^.*?<DOC>\s*", "")
    d = d.select(record.alias("r"))
    head, body = F.regexp_extract("r", r"(?s)^(.*?)(?:\n[ \t]*\n|$)", 1), F.regexp_extract("r", r"(?s)\n[ \t]*\n(.*)$", 1)
    subject = F.regexp_extract(head, r"(?m)^Subject:[ \t]*(.*)$", 1)
    first = F.split_part(F.split_part("r", F.lit("\n"), F.lit(1)), F.lit(" "), F.lit(1))
    parts = F.split(T.strip(first), "/")
    return d.select(F.coalesce(F.get(parts, F.lit(2)), F.element_at(parts, -1)).alias("msg_id"), F.nullif(subject, F.lit("")).alias("subject"), body.alias("body"))


def vocabulary(spark: SparkSession, path: str, stop: tuple[str, ...] = T.STOPWORDS) -> DataFrame:
    """(word): distinct lower-cased words without punctuation and stop words."""
    words = F.explode(T.tokens(F.lower(T.strip_punctuation(F.col("value")))))
    return spark.read.text(path).select(words.alias("word")).where(~F.col("word").isin(*stop)).distinct()


def fetch(urls: DataFrame, get: Callable[[str], tuple[int, str | None]]) -> DataFrame:
    """(url, status, body) by a function that each task calls for its own URLs; a failure has status 0 and no body."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = []
            for u in part["url"]:
                try:
                    got.append((u, *get(u)))
                except Exception:  # noqa: BLE001  whatever a site does, the others go on
                    got.append((u, 0, None))
            yield pd.DataFrame(got, columns=["url", "status", "body"])

    return urls.select("url").mapInPandas(run, "url string, status int, body string")
