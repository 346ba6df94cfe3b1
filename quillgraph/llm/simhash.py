"""SimHash near-duplicate detection with a Gray-order hierarchical index.

Fingerprint: words are runs of anything but space and the controls 09-0D, A-Z lower-cased; shingles of ``shingle`` words with
repeats, joined by a space (a shorter text is one shingle); h is XXH64 with seed 42; a bit is set if it is set in over half the h.
Further lanes of 64 bits count the bits of mixes of the same h.

Index: fingerprints that share a key are sorted by Gray rank and indexed as a tree: a node holds the bits its members agree on that
its parent does not hold yet, so that differences add up on the way down, and a whole group is left once they exceed the limit or
all of it is linked with the query already. Keys of up to ``FAN`` fingerprints, which would be one node, are compared pair by pair,
many keys at once. Only a spanning forest of a key's links is passed on, never all pairs.

Keys, exact: to find fingerprints of 64 bits that differ in at most ``radius`` bits, they are cut into m blocks; two within the
radius agree on some m-radius of them, so each choice of blocks gives a table whose key is the chosen bits, and no link is lost.
m grows with the number of fingerprints, which keeps keys selective and changes no result.

Keys, by votes: texts that share 0.8 of their shingles differ in 0.15 of the bits, too many to share blocks, but hardly in the bits
that nearly all shingles agree on. A key is made of the most decided bit, its place and its value, in each of three groups of 64;
``KEYS`` such keys of 21 bits come from ``VOTES`` lanes. Their number and what they find do not depend on the table's size. Equal
fingerprints are collapsed over all lanes first; those of a key are linked if they differ in at most ``most`` bits of all lanes.

Hot keys: keys of more than ``CELL`` fingerprints, as estimated from a sample (which steers the splitting only), are dealt out as
pairs of shards. Hot nodes and hot groups meet their rows by a broadcast of fewer than 1000 rows.

Components: alternating large and small stars over the links, each round in the shared checkpoint folder.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; a component without any id has the id
null; rows that share an id and differ in text are fingerprinted each; repeated rows give repeated results; an empty table gives
an empty result; texts of any length are read in chunks of ``CHUNK`` shingles; of equally decided bits the first counts; further
columns are dropped by ``group`` and kept by ``dedup``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import cut, only, packed
from quillgraph.operators.components import components, join_hot

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints of one key that one task indexes at once; fan-out of the tree; queries that descend together, and pairs that they may hold.
CELL, FAN, QUERIES, HELD = 1 << 18, 8, 512, 1 << 22
#: Rows to gather before keys are compared, all at once.
BUFFER = 1 << 16
#: Neighbours in Gray order that are compared before the tree is descended, so that large groups of near copies are one group early.
AHEAD = 8
CHUNK = 1 << 15
#: One in so many fingerprints is looked at to find hot keys.
SAMPLE = 16
#: Lanes that vote for keys, keys of a fingerprint, groups of bits in a key, bits in a group; keys in one 64-bit number.
VOTES, KEYS, GROUPS, SIZE, PACK = 16, 20, 3, 64, 3
KEY_BITS = GROUPS * 7


def _mixed(h: np.ndarray, lane: np.ndarray) -> np.ndarray:
    """Each h for each lane, well mixed."""
    x = h[:, None] + lane[None, :] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _dealt() -> np.ndarray:
    """(key, group, place): the bits that decide each key, dealt out anew for every round of keys, so that those of one key are apart."""
    bits, each = VOTES * 64, VOTES * 64 // SIZE // GROUPS
    rounds = []
    for r in range(-(-KEYS // each)):
        order = np.argsort(_mixed(np.arange(bits, dtype=np.uint64), np.array([r + 1], np.uint64))[:, 0], kind="stable")
        rounds.append(order[: each * GROUPS * SIZE].reshape(each, GROUPS, SIZE))
    return np.concatenate(rounds)[:KEYS]


BITS = _dealt()


def votes(text: str | None, shingle: int = SHINGLE, lanes: int = 1) -> np.ndarray:
    """For each bit of each lane, how many more shingles have it set than not."""
    total = np.zeros(64 * lanes, np.int64)
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return total
    line = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w))
    stop = np.cumsum(size + 1) - 1
    n = max(1, len(w) - shingle + 1)
    start, stop = (stop - size)[:n], stop[-n:] if len(w) >= shingle else stop[-1:]
    digest, lane = xxhash.xxh64_intdigest, np.arange(lanes, dtype=np.uint64)
    for i in range(0, n, CHUNK):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(start[i : i + CHUNK].tolist(), stop[i : i + CHUNK].tolist(), strict=True)], np.uint64)
        for j in range(0, len(h), 255):  # sums of 255 bits fit one byte
            part = h[j : j + 255]
            x = part[:, None]
            if lanes > 1:
                x = _mixed(part, lane)
                x[:, 0] = part
            total += np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return 2 * total - n


def lanes_of(v: np.ndarray) -> np.ndarray:
    """The fingerprint of each lane of votes, as unsigned numbers."""
    return np.packbits(v > 0, bitorder="little").view(np.uint64)


def keys_of(v: np.ndarray) -> np.ndarray:
    """Keys from the votes of ``VOTES`` lanes, ``PACK`` of them in a number."""
    at = np.take_along_axis(BITS, np.abs(v)[BITS].argmax(2)[..., None], 2)[..., 0]
    code = np.abs(v)[BITS].argmax(2) * 2 + (v[at] > 0)
    key = code[:, 0] << 14 | code[:, 1] << 7 | code[:, 2]
    key = np.append(key, np.zeros(-len(key) % PACK, np.int64)).reshape(-1, PACK)
    return (key << (KEY_BITS * np.arange(PACK))).sum(1)


def fingerprint(text: str | None, shingle: int = SHINGLE, lanes: int = 1) -> list[int]:
    """``lanes`` unsigned 64-bit fingerprints; the first is the contract's."""
    return lanes_of(votes(text, shingle, lanes)).tolist()


def fingerprints(text: Column, shingle: int = SHINGLE, lanes: int = 1) -> Column:
    """The fingerprints as an array of ``lanes`` numbers; with several lanes, the packed keys follow."""

    @F.pandas_udf("array<bigint>")
    def of(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = votes(t, shingle, lanes if lanes == 1 else VOTES)
            x = lanes_of(v)[:lanes].view(np.int64)
            out.append(x if lanes == 1 else np.concatenate((x, keys_of(v))))
        return pd.Series(out, dtype=object)

    return of(text)


def columns(lanes: int) -> list[str]:
    """Names for what ``fingerprints`` returns."""
    return [f"x{i}" for i in range(lanes)] + ([f"k{i}" for i in range(-(-KEYS // PACK))] if lanes > 1 else [])


def gray_rank(bits: Column) -> Column:
    """Position of the bits in the Gray code's order, shifted so that signed numbers sort like unsigned ones."""
    for s in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, s))
    return bits.bitwiseXOR(F.lit(-(1 << 63)))


def key_masks(radius: int, n: int, bits: int = 64) -> list[int]:
    """Masks such that two fingerprints within the radius agree under one of them; about 64 fingerprints a key if they were even."""
    for m in range(radius + 1, bits + 1):
        if n <= 64 * 2 ** (bits * (m - radius) / m) or math.comb(m, radius) > 2000:
            break
    edge = [round(i * bits / m) for i in range(m + 1)]
    block = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(m)]
    return [sum(x) for x in combinations(block, m - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest index reachable from each of n nodes."""
    label = np.arange(n) if label is None else label
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        low, label = np.minimum(la, lb), label.copy()
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while not np.array_equal(step := label[label], label):
            label = step
    return label


class Links:
    """Fingerprints (lane, place) are linked if they differ in at most ``limit`` bits of all lanes."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def small(self, x: np.ndarray, run: np.ndarray, lags: int | None = None) -> np.ndarray:
        """Roots where runs of equal ``run`` are short: every pair of a run is compared, at one distance (of ``lags``) after the other."""
        n = len(run)
        label, live = np.arange(n), np.arange(n)
        for lag in range(1, n if lags is None else min(n, lags + 1)):
            live = live[live + lag < n]
            live = live[run[live] == run[live + lag]]
            if not len(live):
                break
            a = live[np.bitwise_count(x[:, live] ^ x[:, live + lag]).sum(0, dtype=np.int32) <= self.limit]
            label = roots(n, a, a + lag, label)
        return label

    def tree(self, x: np.ndarray) -> np.ndarray:
        """Roots within one key, by descending the tree over fingerprints in Gray order."""
        n = x.shape[1]
        all_of, any_of = [x], [x]
        while all_of[-1].shape[1] > FAN:
            at = np.arange(0, all_of[-1].shape[1], FAN)
            all_of.append(np.bitwise_and.reduceat(all_of[-1], at, axis=1))
            any_of.append(np.bitwise_or.reduceat(any_of[-1], at, axis=1))
        agreed = [~(o ^ a) for a, o in zip(all_of, any_of, strict=True)]
        own = [agreed[i] & ~np.repeat(agreed[i + 1], FAN, axis=1)[:, : agreed[i].shape[1]] for i in range(len(agreed) - 1)] + [agreed[-1]]
        label = self.small(x, np.zeros(n, np.int8), AHEAD)
        top, step = len(agreed) - 1, max(1, min(QUERIES, HELD // n))
        for q0 in range(0, n, step):
            q = np.arange(q0, min(n, q0 + step))
            low, high = [label], [label]
            for _ in agreed[1:]:
                at = np.arange(0, len(low[-1]), FAN)
                low.append(np.minimum.reduceat(low[-1], at))
                high.append(np.maximum.reduceat(high[-1], at))
            if low[top].min() == high[top].max():
                break
            wide = all_of[top].shape[1]
            who, node = np.repeat(q, wide), np.tile(np.arange(wide), len(q))
            acc = np.zeros(len(who), np.int32)
            for level in range(top, -1, -1):
                mine = label[who]
                keep = ((low[level][node] != mine) | (high[level][node] != mine)) & ((node + 1) * FAN**level > who)
                who, node, acc = who[keep], node[keep], acc[keep]
                acc = acc + np.bitwise_count((x[:, who] ^ all_of[level][:, node]) & own[level][:, node]).sum(0, dtype=np.int32)
                keep = acc <= self.limit
                who, node, acc = who[keep], node[keep], acc[keep]
                if level:
                    who, acc = np.repeat(who, FAN), np.repeat(acc, FAN)
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    there = node < agreed[level - 1].shape[1]
                    who, node, acc = who[there], node[there], acc[there]
            label = roots(n, who, node, label)
        return label


def _forest(links: Links, lanes: int, masks: list[int] | None, node: str):
    """Spanning forests of the keys' links. With masks, a row's key is its fingerprint under the mask of its table ``t``; else it is ``key``."""
    mask_of = np.array([_signed(m) for m in masks], np.int64) if masks else None
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(run: np.ndarray, x: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        size = np.diff(np.append(first, len(run)))
        label = np.arange(len(run))
        short = np.repeat((size <= FAN) & (size > 1), size)
        if short.any():
            at = np.flatnonzero(short)
            label[at] = at[links.small(x[:, at], run[at])]
        for f, s in zip(first[size > FAN].tolist(), size[size > FAN].tolist(), strict=True):
            label[f : f + s] = f + links.tree(x[:, f : f + s])
        far = np.flatnonzero(label != np.arange(len(run)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[label[far]])], schema=out)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by key; whole keys are taken from the buffer once it is full."""
        held: list[pa.RecordBatch] = []
        rows = 0

        def arrays() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            t = pa.Table.from_batches(held)
            x = np.stack([t[f"x{i}"].to_numpy() for i in range(lanes)])
            key = [t["key"].to_numpy()] if masks is None else [t["t"].to_numpy(), x[0] & mask_of[t["t"].to_numpy()]]
            key = np.stack([*key, *((t["cell"].to_numpy(),) if "cell" in t.schema.names else ())])
            run = np.concatenate(([0], np.cumsum((key[:, 1:] != key[:, :-1]).any(0))))
            return run, x.view(np.uint64), t[node].to_numpy()

        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows < BUFFER:
                continue
            run, x, nodes = arrays()
            done = int(np.searchsorted(run, run[-1]))
            if not done:
                continue
            yield solve(run[:done], x[:, :done], nodes[:done])
            rest = pa.Table.from_batches(held).slice(done).combine_chunks()
            held, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield solve(*arrays())

    return search


def forest(distinct: DataFrame, radius: int, lanes: int = 1, most: int = 64, cell: int = CELL) -> DataFrame:
    """Edges (a, b) that connect what is linked among the distinct fingerprints x0, x1, ...; a and b are of ``node``, or x0 without it.

    Fingerprints of one lane are linked if they differ in at most ``radius`` bits, and every such link counts. Those of several, which
    bring their packed keys, are linked if they share a key and differ in at most ``most`` bits of all lanes.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    x = [f"x{i}" for i in range(lanes)]
    node = "node" if "node" in distinct.columns else "x0"
    kept = x if node == "x0" else [*x, node]
    if lanes == 1:
        # The key follows from table and fingerprint, so it is not shuffled.
        masks = key_masks(radius, n)
        key = F.col("x0").bitwiseAND(F.get(F.array(*(F.lit(_signed(m)) for m in masks)), F.col("t")))
        rows, by = distinct.select(*kept, F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("t")), ["t", key.alias("key")]
    else:
        masks = None
        each = (F.shiftrightunsigned(f"k{t // PACK}", t % PACK * KEY_BITS).bitwiseAND((1 << KEY_BITS) - 1).bitwiseOR(t << KEY_BITS) for t in range(KEYS))
        key = F.col("key")
        rows, by = distinct.select(*kept, F.explode(F.array(*each)).alias("key")), ["key"]
    hot = []
    if n > cell:
        few = rows.where(F.pmod(F.xxhash64("x0"), F.lit(SAMPLE)) == 0)
        hot = few.groupBy(*by).count().where(F.col("count") * SAMPLE > cell).collect()
    names = [c for c in ("t", "key") if c == "key" or masks]
    if hot:
        # A hot key's fingerprints are dealt into shards; every pair of shards is a cell. There are at most (tables * n / cell) such keys.
        kind = "t int, key bigint, shards int" if masks else "key bigint, shards int"
        shards = spark.createDataFrame([(*(r[c] for c in names), -(-r["count"] * SAMPLE * 2 // cell)) for r in hot], kind)
        mine = F.pmod(F.xxhash64(F.lit(7), "x0"), F.col("shards")).cast("int")
        cells = F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda o: F.least(o, F.col("mine")) * F.col("shards") + F.greatest(o, F.col("mine")))
        rows = rows.withColumn("key", key).join(shards, names, "left").withColumn("mine", mine)
        rows = rows.withColumn("cell", F.explode(F.coalesce(cells, F.array(F.lit(0)))))
        rows = rows.select(*(c for c in names if c != "key" or not masks), *kept, "cell")
        by.append("cell")
    dealt = rows.repartition(*by).sortWithinPartitions(*by, gray_rank(F.col("x0")))
    return dealt.mapInArrow(_forest(Links(radius if lanes == 1 else most), lanes, masks, node), "a bigint, b bigint").distinct()


def _placed(d: DataFrame, marks: tuple[str, ...], radius: int, lanes: int, most: int, cell: int) -> DataFrame:
    """The rows of ``d``, which has the ``columns`` of fingerprints, with the least value of each mark in the row's component as least_<mark>."""
    x = [f"x{i}" for i in range(lanes)]
    # Texts of one fingerprint can differ in keys; each of the least ones is a key of such a text.
    distinct = d.groupBy(*x).agg(*(F.min(m).alias(f"own_{m}") for m in marks), *(F.min(k).alias(k) for k in columns(lanes)[lanes:]), F.count("*").alias("n"))
    # Numbers are only names of fingerprints of several lanes; no result depends on them.
    distinct = cut(distinct.withColumn("node", F.monotonically_increasing_id() if lanes > 1 else F.col("x0")))
    root = components(forest(distinct, radius, lanes, most, cell))
    linked = cut(distinct.join(root, "node").select("node", "root", *(f"own_{m}" for m in marks)))
    least = linked.groupBy("root").agg(*(F.min(f"own_{m}").alias(f"least_{m}") for m in marks), F.count("*").alias("n"))
    linked = join_hot(linked.select("node", "root"), least, ["root"], linked.count()).drop("root")
    named = distinct.join(linked, "node", "left").select(*x, "n", *(F.coalesce(f"least_{m}", f"own_{m}").alias(f"least_{m}") for m in marks))
    return join_hot(d.drop(*columns(lanes)[lanes:]), cut(named), x, d.count())


def _marked(docs: DataFrame, text: Column, shingle: int, lanes: int, *kept: Column) -> DataFrame:
    """The kept columns and those of the fingerprints, written once."""
    d = docs.select(*kept, fingerprints(text, shingle, lanes).alias("x"))
    return cut(d.select(*d.columns[:-1], *(F.get("x", F.lit(i)).alias(c) for i, c in enumerate(columns(lanes)))))


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, lanes: int = 1, most: int = 64, cell: int = CELL) -> DataFrame:
    """doc_id, fingerprint in hexadecimal digits, and component_id, the smallest id reachable over links."""
    d = only(docs, id_col, text_col).toDF("doc_id", "text")
    both = _placed(_marked(d, F.col("text"), shingle, lanes, F.col("doc_id")), ("doc_id",), radius, lanes, most, cell)
    return both.select("doc_id", F.lower(F.lpad(F.hex("x0"), 16, "0")).alias("fingerprint"), F.col("least_doc_id").alias("component_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, lanes: int = 8, most: int = 84) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id and, of rows of that id, of the smallest text hash.

    Rows count each for itself: rows that share an id and are no near copies all stay. Rows without id stand apart from those with
    one; of theirs, one a component stays. Of rows with equal id and text the one first in JSON stays.

    Defaults: five words; a pair is linked if it shares a key of votes and its fingerprints differ in at most 84 of 512 bits (of two
    sets of shingles that share 0.8 of their union, 0.15 of the bits differ on average).
    """
    d = only(docs, id_col, text_col).toDF("id", "text")
    d = _marked(d, F.col("text"), shingle, lanes, F.col("id"), F.xxhash64("text").alias("h"))
    none = F.col("id").isNull()
    d = d.select("*", F.when(~none, F.struct("id", "h")).alias("key"), F.when(none, F.col("h")).alias("lone"))
    found = _placed(d, ("key", "lone"), RADIUS, lanes, most, CELL)
    stays = F.when(none, F.col("lone") == F.col("least_lone")).otherwise(F.col("key") == F.col("least_key"))
    found = cut(found.select("id", "h", stays.alias("stays")))
    repeated = found.where("stays").groupBy("id", "h").count().where("count > 1").limit(1).count()
    drop = found.where("not stays").select(F.col("id").alias("_id"), F.col("h").alias("_h"))
    mine, text = F.col(f"_row.`{id_col}`"), F.xxhash64(F.col(f"_row.`{text_col}`"))
    out = packed(docs).join(drop, mine.eqNullSafe(F.col("_id")) & (text == F.col("_h")), "left_anti")
    if repeated:
        out = out.groupBy(mine.alias("_id"), text.alias("_h")).agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return out.select("_row.*")
