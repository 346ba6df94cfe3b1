"""Writers of text files. Large results stay in as many files as they have partitions; ``whole`` puts a small one into one file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import dedup, linkgraph, mail, retrieval


def lines(df: DataFrame, path: str, whole: bool = False) -> None:
    (df.coalesce(1) if whole else df).select("line").write.mode("overwrite").text(path)


def run_file(scores: DataFrame, path: str) -> None:
    """A run: queries in order, their documents from the best score on."""
    ordered = scores.orderBy("query_id", F.desc("score"), "doc_id")
    lines(retrieval.run_lines(ordered), path)


def pair_file(pairs: DataFrame, path: str) -> None:
    lines(dedup.pair_lines(pairs), path)


def score_file(scores: DataFrame, path: str, column: str = "score", known: tuple | None = None) -> bool:
    """The best scores; nothing is written if a known node (node, low, high) is out of its range."""
    if known and not linkgraph.check_node(scores, *known, column):
        return False
    lines(linkgraph.score_lines(linkgraph.top(scores, column=column), column), path, whole=True)
    return True


def dot_file(labelled: DataFrame, path: str) -> None:
    lines(mail.dot_lines(labelled), path, whole=True)


def grid_file(grid: DataFrame, path: str) -> None:
    """Results of a parameter grid as comma-separated values with a header, in order of the parameters."""
    grid.orderBy("k", "n_d", "n_w").write.mode("overwrite").option("header", True).csv(path)


def grid_blocks(grid: DataFrame, path: str) -> None:
    """The same as lines k,n_d,n_w,map without a header, an empty line in front of each k, as plotting tools take them."""
    values = [F.col(c).cast("string") for c in ("k", "n_d", "n_w", "map")]
    rows = grid.select("k", "n_d", "n_w", F.concat_ws(",", *values).alias("line"))
    heads = grid.select("k", F.lit(-1).alias("n_d"), F.lit(-1).alias("n_w"), F.lit("").alias("line")).distinct()
    lines(rows.unionByName(heads).orderBy("k", "n_d", "n_w"), path)
