"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.storage import cut as cut  # the library's, for all operators here

#: Words of the contracts: runs of anything but space and the ASCII controls 09-0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % modulus


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that further columns of the input cannot clash with the operator's own."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def packed(df: DataFrame, *skip: str) -> DataFrame:
    """``df`` as one column ``_row``, so that no name of its own can clash; columns named in ``skip`` are left out."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in skip)).alias("_row"))
