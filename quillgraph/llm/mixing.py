"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). The driver sees one row per pattern, never
one per document. Each pattern offers its words ``repeats`` times: the first pass costs nothing, the k-th costs k-1, so costs are
convex and whole corpora are used before anything is repeated. A min-cost flow routes patterns to source quotas. What a pattern
must give is then taken in seeded hash order: full passes over all of its documents, and one partial pass up to a hash bound that
is found digit by digit from grouped sums, so no document list is ever sorted or collected. The documents that share the bound's
hash are taken in part (like a loader that stops inside a document), which keeps the total within a word per such document.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; equal rows are treated alike; an empty
table gives an empty result; without words all targets are 0; texts of any length count by their words; null ids share a hash;
further columns are dropped. The number of distinct patterns must be
at most ``MOST_PATTERNS`` (an error otherwise, nothing is dropped): it depends on how sources are named, not on the corpus' size.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import WORD, cut, only
from quillgraph.operators.components import join_hot

MOST_PATTERNS = 100_000
#: Tables of one short row per pattern are broadcast up to this many rows, under 2 MB.
MOST_BROADCAST = 10_000
DIGIT_BITS, DIGITS = 10, 4


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def fill(sizes: dict, weights: dict, share: Fraction, most: Fraction) -> dict:
    """Targets by weight that add up to ``share`` of all sizes; none above ``most`` times its source, the excess shared again."""
    left, target, open_ = Fraction(sum(sizes.values())) * share, {}, list(sizes)
    while open_:
        per = left / sum(weights[s] for s in open_)
        over = [s for s in open_ if per * weights[s] > most * sizes[s]]
        if not over:
            target |= {s: per * weights[s] for s in open_}
            break
        target |= {s: most * sizes[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in target]
    return target


def cheapest_flow(supply: dict, demand: dict, repeats: int) -> dict:
    """Words each pattern gives each source. Patterns are tuples of sources; pass k of a pattern costs k-1 a word.

    Successive cheapest paths, by component of the bipartite graph; a component of one pattern and one source needs no search.
    """
    flow: dict = defaultdict(int)
    holders = defaultdict(list)
    for p in supply:
        for s in p:
            holders[s].append(p)
    for p in supply:
        if len(p) == 1 and holders[p[0]] == [p]:
            flow[p, p[0]] = min(repeats * supply[p], demand[p[0]])
    used = {p: flow[p, p[0]] if len(p) == 1 else 0 for p in supply}
    joint = [p for p in supply if not (len(p) == 1 and holders[p[0]] == [p])]
    need = {s: demand[s] for p in joint for s in p}

    def price(p) -> int | None:
        return None if used[p] >= repeats * supply[p] else used[p] // supply[p]

    def refund(p) -> int:
        return -((used[p] - 1) // supply[p])

    for s in need:
        while need[s] > 0:
            # Cheapest alternating path from s to a pattern with words left: over s -> pattern, or back over a pattern's flow.
            cost, back, queue = {("s", s): 0}, {}, deque([("s", s)])
            while queue:
                kind, x = queue.popleft()
                steps = (("p", p) for p in holders[x]) if kind == "s" else (("s", t) for t in x if flow[x, t] > 0)
                for nxt in steps:
                    if cost[kind, x] < cost.get(nxt, 1 << 60):
                        cost[nxt], back[nxt] = cost[kind, x], (kind, x)
                        queue.append(nxt)
            ends = [(price(p), i, p) for i, p in enumerate(joint) if ("p", p) in cost and price(p) is not None]
            if not ends:
                break
            c, _, p = min(ends)
            path, node = [("p", p)], ("p", p)
            while node in back:
                node = back[node]
                path.append(node)
            room = min(need[s], (c + 1) * supply[p] - used[p], *(flow[a[1], b[1]] for a, b in zip(path[2::2], path[1::2], strict=False)), 1 << 62)
            for (_, a), (_, b) in zip(path[0::2], path[1::2], strict=True):
                flow[a, b] += room
            for (_, a), (_, b) in zip(path[2::2], path[1::2], strict=False):
                flow[a, b] -= room
            used[p] += room
            need[s] -= room
    return {k: v for k, v in flow.items() if v}


def _hash(seed: int, doc_id: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 64 - DIGIT_BITS * DIGITS)


def _keys(sources: Column, doc_id: Column, size: Column, seed: int) -> list[Column]:
    """_pattern, _size and _hash of a document."""
    pattern = F.to_json(F.array_sort(F.array_distinct(F.coalesce(sources, F.array()))))
    return [pattern.alias("_pattern"), size.alias("_size"), _hash(seed, doc_id).alias("_hash")]


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if it is known to be small."""
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def bounds(slim: DataFrame, sources: dict, size: dict, quotas: Callable[[dict], dict], repeats: int) -> DataFrame:
    """What each pattern gives: _pattern, full passes, words of the partial pass at its bound, the bound's hash and its words.

    ``slim`` has _pattern, _size and _hash; ``sources`` and ``size`` are those of each pattern.
    """
    spark = slim.sparkSession

    def key(p: str) -> tuple:
        return tuple(sorted(sources[p], key=lambda s: (s is None, s or "")))

    totals: dict = defaultdict(int)
    for p in size:
        for s in sources[p]:
            totals[s] += size[p]
    wanted = {s: round(t) for s, t in quotas(dict(totals)).items() if s in totals}
    supply = {key(p): size[p] for p in size if sources[p] and size[p]}
    given: dict = defaultdict(int)
    for (p, _), n in cheapest_flow(supply, {s: wanted.get(s, 0) for s in totals}, repeats).items():
        given[p] += n
    bound = {}
    for p in size:
        full, rest = divmod(given[key(p)], size[p]) if size[p] else (0, 0)
        bound[p] = (full, rest, 0, size[p])
    kind = "_pattern string, full bigint, rest bigint, prefix bigint, at bigint"
    for level in range(1, DIGITS + 1):
        open_ = [(p, *b) for p, b in bound.items() if b[1] > 0]
        if not open_:
            break
        at = _small(spark.createDataFrame(open_, kind), len(open_))
        shift = DIGIT_BITS * (DIGITS - level)
        near = slim.join(at, "_pattern").where(F.shiftright("_hash", shift + DIGIT_BITS) == F.col("prefix"))
        sums = near.groupBy("_pattern", "rest", F.shiftright("_hash", shift).alias("digit")).agg(F.sum("_size").alias("n"))
        before = F.sum("n").over(Window.partitionBy("_pattern").orderBy("digit")) - F.col("n")
        hit = sums.withColumn("before", before).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest")))
        for r in hit.collect():
            bound[r["_pattern"]] = (bound[r["_pattern"]][0], r["rest"] - r["before"], r["digit"], r["n"])
    return _small(spark.createDataFrame([(p, *b) for p, b in bound.items()], kind), len(bound))


def taken() -> Column:
    """The words a document gives, from its own _size and _hash and its pattern's bounds."""
    part = F.expr("cast(floor(cast(_size as decimal(20,0)) * rest / at) as bigint)")
    here = F.col("_hash")
    extra = F.when(F.col("rest") == 0, 0).when(here < F.col("prefix"), F.col("_size")).when(here == F.col("prefix"), part).otherwise(0)
    return (F.col("full") * F.col("_size") + extra).cast("long")


def mix(docs: DataFrame, quotas: Callable[[dict], dict], sources: Column, id_col: str = "doc_id", text_col: str = "text", repeats: int = 2, seed: int = 17, keep: bool = False, size: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, _pattern, size, taken, and columns to carry. ``sources`` is an array of the sources that hold the document.

    ``quotas`` maps the words of each source to the words wanted from it. A document without sources gives nothing. With ``keep``
    the columns of ``docs`` come back (but for a ``taken`` of their own), and ``taken``, for the documents that give any word.
    """
    keys = _keys(sources, F.col(f"`{id_col}`"), words(F.col(f"`{text_col}`")) if size is None else size, seed)
    slim = cut(docs.select(F.col(f"`{id_col}`").alias("doc_id"), sources.alias("sources"), *keys, *(F.col(f"`{c}`").alias(f"_own_{c}") for c in carry)))
    rows = slim.groupBy("_pattern").agg(F.any_value("sources").alias("sources"), F.sum("_size").alias("size")).limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} distinct sets of sources")
    ends = bounds(slim, {r[0]: tuple(dict.fromkeys(r["sources"] or ())) for r in rows}, {r[0]: r["size"] for r in rows}, quotas, repeats)
    if keep:
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "taken")).alias("_row")
        return docs.select(row, *keys).join(ends, "_pattern").withColumn("taken", taken()).where("taken > 0").select("_row.*", "taken")
    return slim.join(ends, "_pattern").select("doc_id", "_pattern", F.col("_size").alias("size"), taken().alias("taken"), *(F.col(f"_own_{c}").alias(c) for c in carry))


def weighted(sizes: dict, weights: tuple = (5, 2, 1), share: Fraction = Fraction(3, 2), most: int = 2) -> dict:
    """Quotas of the contract: sources by code point, null last, weigh 5, 2, 1, repeating."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    return fill({s: sizes[s] for s in order}, {s: weights[i % len(weights)] for i, s in enumerate(order)}, share, Fraction(most))


def mix_by_source(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, size, source_size, target and taken, where each document has the one source of ``source_col``.

    ``shared_taken`` is what the mix takes if a text belongs to every source that has a copy of it: sources overlap then, and words of
    shared texts go to whichever source lacks them, at the least repetition in all.
    """
    told: dict = {}

    def quotas(sizes: dict) -> dict:
        targets = weighted(sizes)
        told.update({s: (sizes[s], float(t)) for s, t in targets.items()})
        return targets

    d = only(docs, id_col, source_col, text_col).toDF("doc_id", "source", "text")
    d = cut(d.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("h")))
    held = d.groupBy("h").agg(F.collect_set(F.struct("source")).alias("x"), F.count("*").alias("n"))
    held = cut(held.select("h", F.array_sort(F.col("x.source")).alias("sources"), "n"))
    both = join_hot(d, held, ["h"], d.count())
    mixed = mix(both, quotas, F.array("source"), size=F.col("size"), carry=("sources", "source"))
    shared = mix(mixed.withColumnRenamed("taken", "_own_taken"), weighted, F.col("sources"), size=F.col("size"), carry=("_own_taken", "source"))
    named = docs.sparkSession.createDataFrame([(s, *x) for s, x in told.items()], "source string, source_size bigint, target double")
    named = _small(named.withColumn("_source", F.to_json(F.array("source"))).drop("source"), len(told))
    return shared.select("doc_id", "size", "_own_taken", F.col("taken").alias("shared_taken"), F.to_json(F.array("source")).alias("_source")).join(named, "_source").select("doc_id", "size", "source_size", "target", F.col("_own_taken").alias("taken"), "shared_taken")


def select_by_source(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents that the mix of ``mix_by_source`` takes words from, with all their columns and ``taken``."""
    return mix(docs, weighted, F.array(F.col(f"`{source_col}`")), id_col, text_col, keep=True)
