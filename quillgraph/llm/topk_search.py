"""Exact top-k search by inner product with multi-resolution segment statistics.

Components become floor(1024 x). With the means and deviations of equal segments, an inner product is at most the sum over segments
of length * (mean * mean + deviation * deviation), which is the lower-bound distance between segment statistics put as a score.
Bounds of 1, 2, 4, ... segments are taken coarse to fine; pairs whose bound falls below the query's k-th best score so far are left,
and only survivors get their exact score. Queries meet all vectors in cells of ``VECTORS`` x ``QUERIES`` rows, dealt by a hash of
the row, so neither side ever has to fit one task. Before that, every query meets ``FLOOR`` rows of the smallest hashes, of at most
``FLOOR_BYTES``, broadcast: its k-th best score among them is a floor that all cells share, so that they prune from their first
block on and return only rows that reach it. The floor bounds results from below, so it changes none of them.

Defined cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part; vectors of
different lengths are compared over their common components, missing ones counting 0; rows that share an id are rows of their own,
each found and, as a query, answered apart, and only a query's own row is left out; equal scores go by the smaller id; very long
vectors are like any other; an empty vector scores 0; scores beyond 63 bits are held at the limit before they are ranked; an empty table gives an empty result; further
columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import cut, only

K, VECTORS, QUERIES, BLOCK, SCALE = 10, 8192, 4096, 2048, 1024
FLOOR, FLOOR_BYTES = 2048, 32 << 20
LEVELS = (1, 2, 4, 8, 16)
MOST, LEAST = (1 << 63) - 1, -(1 << 63)


def _stats(x: np.ndarray, segments: int) -> np.ndarray:
    """Vectors whose inner products are the bounds: sqrt(length) * means and deviations of the segments."""
    n, d = x.shape
    edge = np.linspace(0, d, min(segments, d) + 1).round().astype(int)
    size = np.diff(edge)
    mean = np.add.reduceat(x, edge[:-1], axis=1) / size
    square = np.add.reduceat(x * x, edge[:-1], axis=1) / size
    spread = np.sqrt(np.maximum(square - mean * mean, 0) + 1e-9 * np.maximum(square, 1))
    return np.concatenate((mean, spread), axis=1) * np.sqrt(np.concatenate((size, size)))


def _matrix(vectors: list[np.ndarray], d: int) -> np.ndarray:
    out = np.zeros((len(vectors), d))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def search(q_ids: np.ndarray, q: list, x_ids: np.ndarray, x: list, k: int = K, q_rows: np.ndarray | None = None, x_rows: np.ndarray | None = None, floor: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(place of the query, vector id, score) of the k best vectors of each query within one cell, of those that reach its floor.

    Rows tell a query's own row from others; without them, ids do.
    """
    q_rows, x_rows = (q_ids, x_ids) if q_rows is None else (q_rows, x_rows)
    d = max(1, max((len(v) for v in q), default=0), max((len(v) for v in x), default=0))
    order = np.argsort(x_ids, kind="stable")
    x_ids, x_rows, a, b = x_ids[order], x_rows[order], _matrix([x[i] for i in order], d), _matrix(q, d)
    # Below 2**53 sums of products are exact as doubles; else Python's integers are used.
    exact = max(1.0, np.abs(a).max(initial=0)) * max(1.0, np.abs(b).max(initial=0)) * d < 2**52
    best_s = np.full((len(q_ids), k), -np.inf) if exact else np.full((len(q_ids), k), None, object)
    best_i = np.full((len(q_ids), k), -1, np.int64)
    own = [_stats(b, m) for m in LEVELS if m <= d]
    floor = np.full(len(q_ids), -np.inf) if floor is None or not exact else floor.copy()  # the k-th best score
    for at in range(0, len(x_ids), BLOCK):
        rows, ids, own_row = a[at : at + BLOCK], x_ids[at : at + BLOCK], x_rows[at : at + BLOCK]
        live_q, live_x = None, None
        for mine, m in zip(own, LEVELS, strict=False):
            theirs = _stats(rows, m)
            if live_q is None:
                bound = mine @ theirs.T
                slack = 1e-6 * np.abs(bound) + 2
                keep = (bound + slack >= floor[:, None]) & (q_rows[:, None] != own_row[None, :])
                live_q, live_x = np.nonzero(keep)
            elif exact and len(live_q) < 0.2 * len(q_ids) * len(ids):
                bound = np.einsum("ij,ij->i", mine[live_q], theirs[live_x])
                keep = bound + 1e-6 * np.abs(bound) + 2 >= floor[live_q]
                live_q, live_x = live_q[keep], live_x[keep]
            elif exact:
                bound = mine @ theirs.T
                keep = (bound + 1e-6 * np.abs(bound) + 2 >= floor[:, None])[live_q, live_x]
                live_q, live_x = live_q[keep], live_x[keep]
        if not len(live_q):
            continue
        if exact and len(live_q) > 0.1 * len(q_ids) * len(ids):
            score = (b @ rows.T)[live_q, live_x]
        elif exact:
            score = np.einsum("ij,ij->i", b[live_q], rows[live_x])
        else:
            score = np.array([min(MOST, max(LEAST, sum(int(u) * int(v) for u, v in zip(b[i], rows[j], strict=True)))) for i, j in zip(live_q, live_x, strict=True)], object)
        for i, lo, hi in _runs(live_q):
            s, v = score[lo:hi], ids[live_x[lo:hi]]
            if exact:
                s, v = s[s >= floor[i]], v[s >= floor[i]]
            if not len(s):
                continue
            if exact and len(s) > 4 * k:
                top = s >= np.partition(s, len(s) - k)[len(s) - k]
                s, v = s[top], v[top]
            have = [(-s0, v0) for s0, v0 in zip(best_s[i], best_i[i], strict=True) if v0 >= 0 or s0 is not None and s0 != -np.inf]
            top = sorted(have + [(-s0, int(v0)) for s0, v0 in zip(s.tolist(), v.tolist(), strict=True)])[:k]
            best_s[i, : len(top)] = [-t[0] for t in top]
            best_i[i, : len(top)] = [t[1] for t in top]
            if len(top) == k:
                floor[i] = max(floor[i], float(-top[-1][0]))
    out = []
    for i in range(len(q_ids)):
        out += [(i, int(v), int(s)) for s, v in zip(best_s[i], best_i[i], strict=True) if s is not None and s != -np.inf]
    return out


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    first = np.flatnonzero(np.concatenate(([True], np.diff(sorted_values) != 0)))
    for lo, hi in zip(first, np.append(first[1:], len(sorted_values)), strict=True):
        yield int(sorted_values[lo]), int(lo), int(hi)


def whole(vector: Column) -> Column:
    """floor(1024 x) of each component; null if the vector takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(fine, F.transform(x, lambda v: F.when(F.abs(v) < 2**42, F.floor(v * SCALE).cast("double")).otherwise(v * SCALE)))


def topk(vectors: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = 1) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each query.

    Without ``queries``, those rows ask whose id is divisible by ``every``, and each leaves out itself; queries from another table
    leave out the rows of their own id.
    """
    def ready(df: DataFrame) -> DataFrame:
        df = only(df, id_col, vector_col).toDF("vec_id", "v").where("vec_id is not null and v is not null")
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("v")).alias("v")).where("v is not null")

    # The numbers of rows only tell them apart; no result depends on them.
    both = ready(vectors).select("vec_id", "v", F.lit(True).alias("found"), F.lit(False).alias("asked"))
    if queries is not None:
        both = both.unionByName(ready(queries).select("vec_id", "v", F.lit(False).alias("found"), F.lit(True).alias("asked")))
    else:
        both = both.withColumn("asked", F.pmod("vec_id", F.lit(every)) == 0)
    both = cut(both.withColumn("row", F.monotonically_increasing_id()))
    x, q = both.where("found").select("row", "vec_id", "v"), both.where("asked").select("row", "vec_id", "v")
    if queries is not None:  # a query's own row is then the row of its id
        x, q = x.withColumn("row", F.col("vec_id")), q.withColumn("own", F.col("vec_id"))
    else:
        q = q.withColumn("own", F.col("row"))
    nx, nq = max(1, -(-x.count() // VECTORS)), max(1, -(-q.count() // QUERIES))
    widest = x.agg(F.max(F.size("v"))).first()[0] or 1
    few = x.orderBy(F.xxhash64("row"), "row").limit(max(2 * k, min(FLOOR, FLOOR_BYTES // (8 * widest)))).collect()
    held = q.sparkSession.sparkContext.broadcast((np.array([r["row"] for r in few], np.int64), np.array([r["vec_id"] for r in few], np.int64), [np.array(r["v"]) for r in few]))

    @F.pandas_udf("double")
    def least(own: pd.Series, v: pd.Series) -> pd.Series:
        rows, ids, vectors = held.value
        out = np.full(len(own), -np.inf)
        for at in range(0, len(own), QUERIES):
            mine = own.to_numpy(np.int64)[at : at + QUERIES]
            scores: dict[int, list[int]] = {}
            for i, _, s in search(mine, list(v[at : at + QUERIES]), ids, vectors, k, mine, rows):
                scores.setdefault(i, []).append(s)
            for i, s in scores.items():
                if len(s) == k and abs(min(s)) < 2**52:
                    out[at + i] = min(s)
        return pd.Series(out)

    q = q.withColumn("floor", least("own", "v"))

    def dealt(df: DataFrame, n: int, m: int, mine: str, other: str) -> DataFrame:
        return df.select("*", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        got = []
        if len(a) and len(b):
            ids, rows = a["vec_id"].to_numpy(np.int64), a["row"].to_numpy(np.int64)
            found = search(ids, list(a["v"]), b["vec_id"].to_numpy(np.int64), list(b["v"]), k, a["own"].to_numpy(np.int64), b["row"].to_numpy(np.int64), a["floor"].to_numpy(np.float64))
            got = [(rows[i], ids[i], v, s) for i, v, s in found]
        return pd.DataFrame(got, columns=["row", "query_id", "vec_id", "score"]).astype("int64")

    left = dealt(q, nq, nx, "i", "j").groupBy("i", "j")
    right = dealt(x, nx, nq, "j", "i").groupBy("i", "j")
    found = left.cogroup(right).applyInPandas(cell, "row bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_hundredth(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The query set of the contract against all rows."""
    return topk(vectors, None, id_col, vector_col, every=100)
