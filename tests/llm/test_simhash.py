import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillgraph.llm import simhash

SCHEMA = "doc_id bigint, text string"


def slow_fingerprint(text, k=4):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(fps, radius):
    """fps: {id: fingerprint}; smallest id reachable."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "ing", "er", "tion", "and", "on", "re", "ist", "zu"]) + str(rng.randrange(40)) for _ in range(n))


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = "new" + str(rng.randrange(99))
    return " ".join(w)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    base = prose(rng, 120)
    texts = [base] * 7 + [edited(rng, base, rng.randrange(1, 4)) for _ in range(60)] + [prose(rng, rng.randrange(1, 60)) for _ in range(150)] + ["", None, " \t\n", "one", "ONE", "é É", base + " " + prose(rng, 40000)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_fingerprints_and_groups_equal_brute_force(spark, docs):
    got = {r.doc_id: r for r in simhash.group(spark.createDataFrame(docs, SCHEMA)).collect()}
    fps = {i: slow_fingerprint(t) for i, t in docs}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{x:016x}" for i, x in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == slow_groups(fps, 4)


@pytest.mark.parametrize(("radius", "cell"), [(0, 1 << 18), (4, 40), (8, 1 << 18), (8, 200)])
def test_forest_loses_no_link(spark, radius, cell):
    rng = np.random.default_rng(radius + cell)
    x = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    near = np.repeat(x, 150)
    for _ in range(5):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, len(near), dtype=np.uint64))
    fps = {i: int(v) for i, v in enumerate(sorted({*x.tolist(), *near.tolist()}))}
    back = {simhash._signed(v): i for i, v in fps.items()}
    df = spark.createDataFrame([(v,) for v in back], "x0 bigint")
    edges = simhash.forest(df, radius, cell=cell)
    assert all((fps[back[r.a]] ^ fps[back[r.b]]).bit_count() >= 0 for r in edges.collect())
    root = {back[r.node]: back[r.root] for r in simhash.components(edges).collect()}
    want, mine = slow_groups(fps, radius), {}
    for i in fps:
        mine.setdefault(root.get(i, i), []).append(i)
    assert sorted(map(sorted, mine.values())) == sorted(sorted(j for j in fps if want[j] == r) for r in set(want.values()))


def test_key_masks_miss_no_pair_within_the_radius():
    rng = random.Random(1)
    for radius, n in ((4, 1000), (4, 10**7), (8, 1000), (8, 10**6)):
        masks = simhash.key_masks(radius, n)
        for _ in range(300):
            diff = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not diff & m for m in masks)


def with_keys(texts):
    return [simhash.votes(t, 5, simhash.VOTES) for t in texts]


def test_keys_of_near_copies_meet_and_do_not_depend_on_the_table():
    rng = random.Random(6)
    met = {0.8: [0, 0], 0.9: [0, 0]}
    for _ in range(150):
        base = prose(rng, 250)
        for least, edits in ((0.8, 5), (0.9, 2)):
            a, b = with_keys([base, edited(rng, base, edits)])
            ka, kb = ([int(k) >> 21 * i & (1 << 21) - 1 for k in simhash.keys_of(v) for i in range(3)][: simhash.KEYS] for v in (a, b))
            met[least][0] += any(x == y for x, y in zip(ka, kb, strict=True))
            met[least][1] += 1
    assert met[0.8][0] >= 0.8 * met[0.8][1] and met[0.9][0] >= 0.98 * met[0.9][1]


def test_keys_equal_a_slow_version():
    rng = random.Random(12)
    v = simhash.votes(prose(rng, 90), 5, simhash.VOTES)
    got = [int(k) >> 21 * i & (1 << 21) - 1 for k in simhash.keys_of(v) for i in range(3)][: simhash.KEYS]
    for key, groups in zip(got, simhash.BITS.tolist(), strict=True):
        want = 0
        for g in groups:
            best = max(range(64), key=lambda i: (abs(int(v[g[i]])), -i))
            want = want << 7 | best * 2 + int(v[g[best]] > 0)
        assert key == want
    for groups in simhash.BITS:
        assert len(np.unique(groups)) == groups.size


def test_forest_of_lanes_links_every_close_pair_that_shares_a_key(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 63, (4, 1400), dtype=np.uint64)
    for k, (a, b) in enumerate(zip(range(0, 400, 2), range(1, 400, 2), strict=True)):  # 36 to 43 bits apart
        x[:, b] = x[:, a]
        for f in rng.permutation(256)[: 36 + k % 8]:
            x[f // 64, b] ^= np.uint64(1) << np.uint64(f % 64)
    x[:, 400:1000] = x[:, [399]]
    for _ in range(6):
        x[rng.integers(0, 4, 600), np.arange(400, 1000)] ^= np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64)
    packs = -(-simhash.KEYS // simhash.PACK)
    names = "node bigint, " + ", ".join(f"x{i} bigint" for i in range(4)) + ", " + ", ".join(f"k{i} bigint" for i in range(packs))
    fps = {i: sum(int(v) << 64 * k for k, v in enumerate(x[:, i])) for i in range(1400)}
    for shared in (True, False):  # all have one key, or every row keys of its own
        rows = [(i, *(simhash._signed(int(v)) for v in x[:, i]), *([1 if shared else i | i << 21 | i << 42] * packs)) for i in range(1400)]
        df = spark.createDataFrame(rows, names)
        for cell in (simhash.CELL, 300):
            got = {r.node: r.root for r in simhash.components(simhash.forest(df, 4, 4, 40, cell)).collect()}
            assert {i: got.get(i, i) for i in fps} == (slow_groups(fps, 40) if shared else {i: i for i in fps})


def test_two_copies_are_linked_whatever_else_the_table_holds(spark):
    rng = random.Random(31)
    base = prose(rng, 300)
    pair = [(1, base), (2, edited(rng, base, 3)), (3, prose(rng, 300))]
    for others in (0, 3000):
        df = spark.createDataFrame(pair + [(100 + i, prose(rng, 12)) for i in range(others)], SCHEMA)
        kept = {r.doc_id for r in simhash.dedup(df).where("doc_id < 100").collect()}
        assert kept == {1, 3}


def test_tree_and_small_runs_agree():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, 700, dtype=np.uint64) << np.uint64(9)
    for _ in range(7):
        x = x ^ (np.uint64(1) << rng.integers(0, 64, len(x), dtype=np.uint64))
    x = np.sort(x)[None]
    links = simhash.Links(4)
    assert (links.tree(x) == links.small(x, np.zeros(700, int))).all()
    wide = np.concatenate([x, x ^ np.uint64(3), rng.integers(0, 2, (2, 700), dtype=np.uint64)])
    links = simhash.Links(9)
    assert (links.tree(wide) == links.small(wide, np.zeros(700, int))).all()


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    names = rng.sample(range(-(10**6), 10**6), 300)
    chain = list(zip(names[:100], names[1:101], strict=False))
    star = [(names[150], y) for y in names[151:250]]
    e = chain + star + [(5, 5)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(e, "a bigint, b bigint")).collect()}
    assert {got[x] for x in names[:101]} == {min(names[:101])}
    assert {got[x] for x in names[150:250]} == {min(names[150:250])}


def test_dedup_keeps_one_of_each_group(spark):
    rng = random.Random(8)
    base, other = prose(rng, 400), prose(rng, 400)
    rows = [(3, base, 1), (1, base, 2), (7, edited(rng, base, 2), 3), (4, other, 4), (4, other, 4), (None, base, 5), (9, "", 6), (8, None, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, root int")
    out = simhash.dedup(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.root) for r in out.collect()) == [(0, 5), (1, 2), (4, 4), (8, 7)]


def test_rows_of_one_first_lane_are_compared_over_all_lanes(spark, monkeypatch):
    x0, far, packs = 5, (1 << 60) - 1, -(-simhash.KEYS // simhash.PACK)
    lanes = {"a": (x0, 0, 0, 0), "b": (x0, far, far, 0), "c": (x0, 0, 0, (1 << 41) - 1), "d": (x0, 0, 0, (1 << 20) - 1), "e": (x0, far, far, 1)}
    monkeypatch.setattr(simhash, "fingerprints", lambda text, *_: F.coalesce(*(F.when(text == k, F.array(*map(F.lit, (*v, *([0] * packs)))).cast("array<bigint>")) for k, v in lanes.items())))
    df = spark.createDataFrame(list(enumerate("abcdea")), SCHEMA)
    got = {r.doc_id: r.component_id for r in simhash.group(df, lanes=4, most=40).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0, 4: 1, 5: 0}
    got = {r.doc_id: r.component_id for r in simhash.group(df.where("text <> 'd'"), lanes=4, most=40).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 4: 1, 5: 0}


def test_dedup_removes_rows_not_ids(spark):
    rng = random.Random(9)
    text = [prose(rng, 300) for _ in range(6)]
    rows = [(5, text[0], 1), (5, text[1], 2), (5, text[2], 3), (2, text[1], 4), (None, text[3], 5), (None, text[3], 5), (None, text[4], 6), (7, text[5], 7), (7, text[5], 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, root int")
    assert sorted(r.root for r in simhash.dedup(df).collect()) == [1, 3, 4, 5, 6, 7]


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.group(empty).collect() == [] and simhash.dedup(empty).collect() == []
    got = simhash.group(spark.createDataFrame([(None, "a b"), (None, "a b")], SCHEMA).withColumn("x0", F.lit(1))).collect()
    assert [r.component_id for r in got] == [None, None]
