import math

import numpy as np
import pytest

from quillgraph.llm import topk_search as S

SCHEMA = "vec_id bigint, embedding array<double>, score int"


def slow(rows, k=10):
    live = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        live.append((i, [math.floor(1024 * x) for x in v]))
    out = []
    for n, (q, a) in enumerate(live):
        if q % 100 == 0:
            best = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False)))), i) for m, (i, b) in enumerate(live) if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in S.every_hundredth(df).collect())


def test_equals_brute_force_with_ties_nulls_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(S, "VECTORS", 150)
    monkeypatch.setattr(S, "QUERIES", 2)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=24).round(3).tolist()) for i in range(500)]
    rows += [(500 + i, rows[7][1]) for i in range(40)] + [(600, rows[7][1]), (600, rows[7][1]), (-100, rows[8][1])]
    rows += [(None, rows[0][1]), (700, None), (701, [1.0, None]), (702, [float("nan")] * 24), (703, [float("inf")] * 24), (704, []), (705, [1.0, -2.0]), (800, [0.5] * 30)]
    assert run(spark, rows) == slow(rows)


def test_floors_are_shared_and_change_no_result(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=12).round(2).tolist()) for i in range(900)] + [(300, [0.0] * 12), (300, [9.0] * 12)]
    want = slow(rows)
    for few in (20, 64, 2048):
        monkeypatch.setattr(S, "FLOOR", few)
        monkeypatch.setattr(S, "VECTORS", 200)
        assert run(spark, rows) == want
    x = [np.floor(1024 * np.array(v)) for _, v in rows]
    ids = np.array([i for i, _ in rows])
    every = S.search(ids[:3], x[:3], ids, x)
    least = np.array([min(s for q, _, s in every if q == i) for i in range(3)], float)
    assert sorted(S.search(ids[:3], x[:3], ids, x, floor=least)) == sorted(every)
    assert S.search(ids[:3], x[:3], ids, x, floor=least + 1e9) == []


def test_queries_of_another_table(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    asked = [(3, rows[3][1]), (77, rows[4][1])]
    schema = "vec_id bigint, embedding array<double>"
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in S.topk(spark.createDataFrame(rows, schema), spark.createDataFrame(asked, schema), k=2).collect())
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    want = []
    for q, v in asked:
        w = [math.floor(1024 * x) for x in v]
        best = sorted((-sum(a * b for a, b in zip(w, u, strict=True)), i) for i, u in whole.items() if i != q)[:2]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_components_are_floored_up_to_the_largest_doubles(spark):
    values = [2.0**40 + 1 / 4096, -(2.0**41) - 1 / 2048, 2.0**42 + 1 / 1024, -0.0001, 1e300]
    df = spark.createDataFrame([(values,)], "v array<double>")
    assert df.select(S.whole(df.v).alias("w")).first().w == [float(math.floor(1024 * x)) for x in values]


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(100, [2.0**30 + 1, 3.0, -1.0]), (1, [2.0**29, 5.0, 7.0]), (2, [2.0**29, 5.0, 6.0]), (3, [1e30, 0.0, 0.0])]
    assert run(spark, rows) == slow(rows)


@pytest.mark.parametrize("rows", [[], [(100, [1.0])], [(1, [1.0]), (2, [2.0])]])
def test_few_rows(spark, rows):
    assert run(spark, rows) == slow(rows)


def test_bounds_are_never_below_the_score():
    rng = np.random.default_rng(1)
    a, b = np.floor(1024 * rng.normal(size=(40, 37))), np.floor(1024 * rng.normal(size=(60, 37)))
    last = None
    for m in S.LEVELS:
        bound = S._stats(a, m) @ S._stats(b, m).T
        assert (bound * (1 + 1e-6) + 2 >= a @ b.T).all()
        last = bound if last is None else last
    assert bound.mean() < last.mean()
