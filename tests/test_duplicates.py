import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import dedup, fingerprint, plateau


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_checksums(spark):
    assert one(spark, T.adler32, "the cat sat on 42 mats") == 1443235674 == zlib.adler32(b"the cat sat on 42 mats")
    assert one(spark, T.manual_checksum, "the cat sat on 42 mats") == 1033045689
    assert one(spark, T.adler32, None) is None
    assert one(spark, lambda c: T.signed32(T.adler32(c)), "é" * 500) == (zlib.adler32(("é" * 500).encode()) + 2**31) % 2**32 - 2**31


def test_clean_speech(spark):
    text = "banner\n\nA title line\n\nBody: one, two.\n---\n  last line  "
    assert one(spark, T.clean_speech, text) == "Body one two  last line"
    assert one(spark, T.clean_speech, "a\nb") is None
    assert one(spark, T.clean_speech, "a\nb\nthis line is longer than seven words is it\nx") == "this line is longer than seven words is it x"


def test_numbers(spark):
    yes, no = ["1", "-1.5", "1e5", ".5", "nan", "INF", "+infinity"], ["12d", "12f", "1e", "", "abc", "1,000"]
    df = spark.createDataFrame([(w,) for w in yes + no], "w string")
    assert [r.w for r in df.where(T.is_number(F.col("w"))).collect()] == yes


@pytest.mark.parametrize(("textbook", "want"), [(False, "d060"), (True, "5060")])
def test_simhash_of_two_words(spark, textbook, want):
    assert one(spark, lambda c: fingerprint.simhash(c, 16, textbook=textbook), ["cat", "sat"], "array<string>") == want


def test_simhash_edges(spark):
    assert one(spark, fingerprint.simhash, [], "array<string>") == ""
    assert one(spark, fingerprint.simhash, ["the"], "array<string>") == ""
    with pytest.raises(ValueError, match="power of two"):
        fingerprint.simhash(F.col("x"), 12)


def prints(spark, rows):
    return spark.createDataFrame(rows, "id bigint, print string")


def changed(base, n):
    return "".join(format(int(c, 16) ^ (i < n), "x") for i, c in enumerate(base))


def test_bands_match_up_to_the_distance(spark):
    base = "0123456789abcdef" * 2
    df = prints(spark, [(1, base), (2, changed(base, 4)), (3, changed(base, 5)), (4, base), (5, "")])
    got = {tuple(r) for r in dedup.near_pairs(df).collect()}
    assert got == {(1, 4), (1, 2), (2, 4), (2, 3)}
    bits = {tuple(r) for r in dedup.near_pairs(df, bands=False).collect()}
    assert bits == got | {(i, 5) for i in range(1, 5)}


def test_no_shared_band_means_no_match(spark):
    df = prints(spark, [(1, "1234"), (2, "2345")])
    assert dedup.near_pairs(df, digits=4, distance=4).collect() == []
    assert dedup.near_pairs(prints(spark, [(1, "1234"), (2, "1345")]), digits=4, distance=4).count() == 1


def test_blocking_equals_all_pairs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        x = rng.getrandbits(128) if i % 6 == 0 else x ^ sum(1 << rng.randrange(128) for _ in range(rng.randrange(1, 4)))  # noqa: F821
        rows.append((i, f"{x:032x}"))
    df = prints(spark, rows)
    want = {(a, b) for a, x in rows for b, y in rows if a < b and sum(p != q for p, q in zip(x, y, strict=True)) <= 4}
    assert {tuple(r) for r in dedup.near_pairs(df).collect()} == want
    want = {(a, b) for a, x in rows for b, y in rows if a < b and (int(x, 16) ^ int(y, 16)).bit_count() <= 4}
    assert {tuple(r) for r in dedup.near_pairs(df, bands=False).collect()} == want


def test_exact_modes_differ_by_spacing(spark):
    df = spark.createDataFrame([(1, "a  b"), (2, "a b"), (3, "a b")], "id bigint, text string")
    assert [tuple(r) for r in dedup.exact_pairs(df, T.adler32(F.col("text")), "id").collect()] == [(2, 3)]
    assert len(dedup.exact_pairs(df, dedup.same_words(T.tokens(F.col("text"))), "id").collect()) == 3
    assert [r.line for r in dedup.pair_lines(dedup.exact_pairs(df, dedup.same_words(T.tokens(F.col("text"))), "id")).collect()] == ["1-2", "1-3", "2-3"]


PLATEAUS = [
    ("we spent 5 6 and 7 8 units today", (204, 1, 3, "6 and 7 8")),
    ("9 x 1 2 3 y", (301, 0, 2, "9 x 1 2 3")),
    ("a 1 2 3", (0, 0, 1, "a 1 2 3")),
    ("1 2 3", None),
    ("a 1 2 3 b", None),
    ("a b c", None),
    ("", None),
]


def test_plateaus(spark):
    df = spark.createDataFrame(list(enumerate(t for t, _ in PLATEAUS)), "id int, text string").select("id", T.tokens(F.col("text")).alias("words"))
    got = {r.id: (r.score, r.a, r.b, " ".join(r.plateau)) for r in plateau.spans(df).collect()}
    assert got == {i: w for i, (_, w) in enumerate(PLATEAUS) if w}


def slow_plateau(words):
    num = [w.isdigit() for w in words]
    if not any(num):
        return None
    run, table = [], []
    for i, w in enumerate(num):
        if i == 0 or w != num[i - 1]:
            run.append([w, 0])
        run[-1][1] += 1
    through = tags = nums = 0
    total = num.count(False)
    for w, n in run:
        before = tags
        through, tags, nums = through + n, tags + (0 if w else n), nums + (n if w else 0)
        table.append((w, through, before, nums, total - before))
    best = (0, 0, len(run) - 1)
    for a in range(len(run) - 1):
        for b in range(a, len(run) - 1):
            if table[a][0] and table[b][0]:
                s = table[a][2] + 100 * (table[b][3] - table[a][3]) + table[b][4]
                best = (s, a, b) if s > best[0] else best
    s, a, b = best
    cut = words[table[a][1] - 1 : table[b][1]]
    return (s, a, b, " ".join(cut)) if sum(w.isdigit() for w in cut) >= 3 else None


def test_plateaus_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice(["1", "2", "x", "y"]) for _ in range(rng.randrange(0, 25))]) for i in range(300)]
    got = {r.id: (r.score, r.a, r.b, " ".join(r.plateau)) for r in plateau.spans(spark.createDataFrame(rows, "id int, words array<string>")).collect()}
    assert got == {i: w for i, words in rows if (w := slow_plateau(words))}
