import itertools
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import mixing

SCHEMA = "doc_id bigint, source string, text string"


def docs_of(rng, n):
    names = ["a", "b", "B", "é", "", None, "hot", "hot", "hot"]
    return [(i, rng.choice(names), " ".join("w" * rng.randrange(1, 3) for _ in range(rng.choice((0, 1, 5, 60, 900))))) for i in range(n)]


def slow_targets(rows):
    size = defaultdict(int)
    for _, s, t in rows:
        size[s] += len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target = 1.5 * sum(size.values()), {}
    while True:
        open_ = [s for s in order if s not in target]
        per = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if per * weight[s] > 2 * size[s]]
        if not over:
            return size, target | {s: per * weight[s] for s in open_}
        for s in over:
            target[s] = 2 * size[s]
            left -= target[s]


def test_sources_meet_their_targets(spark):
    rows = docs_of(random.Random(3), 900) + [(5000, "a", None), (5000, "a", "x y z"), (5000, "a", "x y z"), (None, "b", "q q"), (None, "b", "q q")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("taken", F.lit("clash")).withColumn("_hash", F.lit("clash"))
    got = mixing.mix_by_source(df).collect()
    assert len(got) == len(rows)
    size, target = slow_targets(rows)
    source = {i: s for i, s, _ in rows}
    total = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert 0 <= r.taken <= 2 * r.size and r.source_size == size[s] and r.target == pytest.approx(target[s])
        total[s] += r.taken
    for s in size:
        assert abs(total[s] - target[s]) <= 4
    again = mixing.mix_by_source(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    kept = mixing.select_by_source(df)
    assert kept.columns == ["doc_id", "source", "text", "_hash", "taken"]
    assert sorted((r.doc_id or 0, r.taken) for r in kept.collect()) == sorted((r.doc_id or 0, r.taken) for r in got if r.taken)


def test_shared_texts_go_where_they_are_needed(spark):
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(20, 200))) for _ in range(60)]
    rows, n = [], 0
    for k, t in enumerate(texts):
        for s in ((["big"], ["big", "tiny"], ["mid", None], ["mid"])[k % 4]) * (1 + (k % 8 == 1)):
            rows.append((n, s, t))
            n += 1
    rows += [(n + i, "big", texts[1]) for i in range(150)]
    got = {r.doc_id: r for r in mixing.mix_by_source(spark.createDataFrame(rows, SCHEMA)).collect()}
    size = {t: len(t.split()) for t in texts}
    holders = {t: tuple(sorted({s for _, s, x in rows if x == t}, key=lambda s: (s is None, s or ""))) for t in texts}
    supply, totals = defaultdict(int), defaultdict(int)
    for _, _, t in rows:
        supply[holders[t]] += size[t]
        for s in holders[t]:
            totals[s] += size[t]
    wanted = {s: round(x) for s, x in mixing.weighted(dict(totals)).items()}
    given = defaultdict(int)
    for (p, _), words in mixing.cheapest_flow(dict(supply), wanted, 2).items():
        given[p] += words
    mine = defaultdict(int)
    for i, _, t in rows:
        assert 0 <= got[i].shared_taken <= 2 * got[i].size == 2 * size[t]
        mine[holders[t]] += got[i].shared_taken
    assert len(supply) == 4 and any(len(p) > 1 and given[p] for p in given)
    for p in supply:
        assert abs(mine[p] - given[p]) <= 4


def test_white_space_that_is_no_separator(spark):
    df = spark.createDataFrame([("a\u00a0b c\x0bd\x1fe\u2003f",), (None,), (" \t",)], "text string")
    assert [r.n for r in df.select(mixing.words(F.col("text")).alias("n")).collect()] == [3, 0, 0]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_by_source(empty).collect() == [] and mixing.select_by_source(empty).collect() == []
    blank = spark.createDataFrame([(1, "a", None), (2, "b", "")], SCHEMA)
    assert [(r.target, r.taken) for r in mixing.mix_by_source(blank).collect()] == [(0.0, 0), (0.0, 0)]


def brute_flow(supply, demand, repeats):
    """Most words, then least cost, over all ways to give whole words."""
    edges = [(p, s) for p in supply for s in p]
    best = None
    for give in itertools.product(*(range(demand[s] + 1) for _, s in edges)):
        out, into = defaultdict(int), defaultdict(int)
        for (p, s), n in zip(edges, give, strict=True):
            out[p] += n
            into[s] += n
        if all(into[s] <= demand[s] for s in demand) and all(out[p] <= repeats * supply[p] for p in supply):
            cost = sum(sum(k // supply[p] for k in range(out[p])) for p in supply)
            key = (-sum(give), cost)
            best = key if best is None or key < best else best
    return best


def test_flow_is_cheapest():
    rng = random.Random(5)
    for _ in range(25):
        patterns = rng.sample([("a",), ("b",), ("a", "b"), ("b", "c"), ("a", "c")], 3)
        supply = {p: rng.randrange(1, 3) for p in patterns}
        demand = {s: rng.randrange(0, 4) for s in sorted({s for p in patterns for s in p})}
        flow = mixing.cheapest_flow(supply, demand, 2)
        out, into = defaultdict(int), defaultdict(int)
        for (p, s), n in flow.items():
            out[p] += n
            into[s] += n
        assert all(out[p] <= 2 * supply[p] for p in supply) and all(into[s] <= demand[s] for s in demand)
        cost = sum(sum(k // supply[p] for k in range(out[p])) for p in supply)
        assert (-sum(flow.values()), cost) == brute_flow(supply, demand, 2)


def test_overlapping_sources(spark):
    rows = [(i, s, "w " * 10) for i, s in enumerate([["a"], ["a", "b"], ["b"], ["a", "b"], None, []])]
    df = spark.createDataFrame(rows, "doc_id bigint, sources array<string>, text string")
    got = {r.doc_id: r.taken for r in mixing.mix(df, lambda sizes: {"a": 15, "b": 25}, F.col("sources")).collect()}
    assert sum(got.values()) == 40 and got[4] == got[5] == 0 and all(n <= 10 for n in got.values())


def test_fill_shares_the_excess():
    got = mixing.fill({"a": 10, "b": 100, "c": 100}, {"a": 5, "b": 2, "c": 1}, Fraction(3, 2), Fraction(2))
    assert got == {"a": 20, "b": Fraction(590, 3), "c": Fraction(295, 3)}
