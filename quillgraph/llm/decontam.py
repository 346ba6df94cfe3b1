"""Benchmark decontamination by greedy string tiling.

Tokens are runs of word characters, lower-cased. A document's tokens become ids of the benchmark's vocabulary; Karp-Rabin hashes
of ``MIN_TILE`` ids are joined with those of the items, each distinct hash of a document once. Seeds bound the tiles from above, so
items whose seeds cover too little are not tiled. The longest match of unmarked tokens is marked again and again, on both sides,
until none of ``MIN_TILE`` tokens is left: its length is found by running Karp-Rabin hashes over all unmarked windows of a length,
which is halved or raised until it fits, and what is marked is compared token by token. Memory is in proportion to document and
item, however often tokens repeat. An item is found if the tiles cover ``COVERAGE`` of its tokens, in whatever order they stand.

The benchmark is a query set: it is read in blocks of at most ``BLOCK_BYTES`` of text, each broadcast and held against all
documents in one pass without a shuffle.

Defined cases: null and empty texts match nothing; an item of fewer than ``MIN_TILE`` tokens is found where it is the whole document,
token by token; an item without tokens is never found; of equally long matches the first in the document, then in the item, is
marked; texts of any length are tiled whole; repeated rows give repeated results; items with equal text are all reported; an empty
table on either side gives no match; null ids are kept; further columns are dropped by ``matches`` and kept by ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import only

MIN_TILE, COVERAGE, BLOCK_BYTES = 5, 0.5, 16 << 20
#: An odd number and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
TOKEN = re.compile(r"\w+")
FOUND = "array<struct<item_id:bigint,coverage:double,tiles:int,longest:int>>"


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def _coded(ids: np.ndarray) -> np.ndarray:
    """Ids as well mixed numbers; id 0 is kept for tokens that no item has."""
    x = ids.astype(np.uint64) * np.uint64(BASE)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Karp-Rabin hashes of all runs of any length of a sequence of ids."""

    def __init__(self, ids: np.ndarray) -> None:
        power = np.full(len(ids) + 1, BASE, np.uint64)
        power[0] = 1
        back = np.full(len(ids) + 1, BACK, np.uint64)
        back[0] = 1
        self.back = np.cumprod(back)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_coded(ids) * np.cumprod(power)[:-1], dtype=np.uint64)))

    def of(self, length: int) -> np.ndarray:
        n = max(0, len(self.sums) - length)
        return (self.sums[length:] - self.sums[:n]) * self.back[:n]


class Items:
    """The items of a block, ready to be matched."""

    def __init__(self, rows: list[tuple], k: int, coverage: float) -> None:
        self.k, self.coverage, self.vocabulary, self.items, self.short = k, coverage, {}, [], {}
        for item_id, text in rows:
            w = tokens(text)
            if len(w) >= k:
                self.items.append((item_id, np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int64)))
            elif w:
                self.short.setdefault(tuple(w), []).append(item_id)
        hashes = [Rolling(ids).of(k) for _, ids in self.items]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]) if hashes else np.zeros(0, int)
        at = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, int)
        order = np.argsort(flat, kind="stable")
        self.hash, self.item, self.at = flat[order], item[order], at[order]

    def match(self, text: str | None) -> list[tuple]:
        w = tokens(text)
        if len(w) < self.k:
            return [(item_id, 1.0, 1, len(w)) for item_id in self.short.get(tuple(w), ())]
        if not len(self.hash):
            return []
        ids = np.fromiter(map(self.vocabulary.get, w, repeat(0)), np.int64, len(w))
        # A window is worth hashing if all of its tokens are known.
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        full = np.flatnonzero(known[self.k :] - known[: -self.k] == self.k)
        if not len(full):
            return []
        seeds = Rolling(ids).of(self.k)
        h = np.unique(seeds[full])
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        n = (hi - lo)[hi > lo]
        lo = lo[hi > lo]
        if not len(lo):
            return []
        entry = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        item, at = self.item[entry], self.at[entry]
        found = []
        for i in np.unique(item):
            item_id, own = self.items[i]
            mine = at[item == i]
            covered = np.zeros(len(own) + 1, np.int64)
            covered[mine] += 1
            covered[mine + self.k] -= 1
            if np.count_nonzero(np.cumsum(covered[:-1])) < self.coverage * len(own):
                continue
            tiles = tile(self._near(seeds, self.hash[entry[item == i]], ids), own, self.k)
            share = sum(tiles) / len(own)
            if share >= self.coverage:
                found.append((item_id, share, len(tiles), max(tiles)))
        return found

    def _near(self, seeds: np.ndarray, wanted: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The document's ids with what no seed of the item covers left out, but for one token between what is kept."""
        hit = np.flatnonzero(np.isin(seeds, wanted))
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + self.k, -1)
        kept = np.cumsum(edge[:-1]) > 0
        out = np.where(kept, ids, 0)
        return out[kept | np.concatenate(([False], kept[:-1]))]


def _free(marked: np.ndarray, length: int) -> np.ndarray:
    """Where runs of so many unmarked tokens start."""
    sums = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(sums[length:] == sums[: len(sums) - length]) if length < len(sums) else np.zeros(0, np.int64)


def tile(ids: np.ndarray, own: np.ndarray, k: int) -> list[int]:
    """Lengths of the tiles, of k tokens or more, between a document and an item; id 0 fits nothing."""
    here, there = Rolling(ids), Rolling(own)
    mine, theirs, tiles = ids == 0, np.zeros(len(own), bool), []

    def shared(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of free windows whose hash the other side has, and those hashes."""
        a, b = _free(mine, length), _free(theirs, length)
        ha, hb = here.of(length)[a], there.of(length)[b]
        fits = np.isin(ha, hb)
        return a[fits], ha[fits], b, hb

    most = min(len(ids), len(own))
    while most >= k:
        low, high = k - 1, most  # the longest length that both sides share
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if len(shared(mid)[0]) else (low, mid - 1)
        if low < k:
            break
        most, marked = low, True
        while marked:
            marked = False
            a, ha, b, hb = shared(most)
            for x, h in zip(a.tolist(), ha, strict=True):
                y = next((y for y in b[hb == h].tolist() if np.array_equal(ids[x : x + most], own[y : y + most])), None)
                if y is not None:
                    mine[x : x + most] = theirs[y : y + most] = True
                    tiles.append(most)
                    marked = True
                    break
        most -= 1
    return tiles


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    items = only(benchmark, id_col, text_col).toDF("item_id", "text").where("text is not null").withColumn("item_id", F.col("item_id").cast("long"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-int(total) * 2 // BLOCK_BYTES) or 1
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield sorted(((r[0], r[1]) for r in part.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _matcher(docs: DataFrame, rows: list[tuple], min_tile: int, coverage: float):
    held = docs.sparkSession.sparkContext.broadcast(Items(rows, min_tile, coverage))

    @F.pandas_udf(FOUND)
    def match(texts: pd.Series) -> pd.Series:
        items = held.value
        return pd.Series([[dict(zip(("item_id", "coverage", "tiles", "longest"), x, strict=True)) for x in items.match(t)] for t in texts], dtype=object)

    return match


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_tile: int = MIN_TILE, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage, tiles and longest tile of each item that a document holds."""
    d = only(docs, id_col, text_col).toDF("doc_id", "text")
    out = None
    for rows in _blocks(benchmark, item_col, item_text_col):
        part = d.select("doc_id", F.inline(_matcher(d, rows, min_tile, coverage)("text")))
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_tile: int = MIN_TILE, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the rows that hold an item."""
    out = docs
    for rows in _blocks(benchmark, item_col, item_text_col):
        found: Column = _matcher(docs, rows, min_tile, coverage)(F.col(f"`{text_col}`"))
        out = out.where(F.size(found) == 0)
    return out
