from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.operators import bags

A, B = {"x": 3, "y": 1, "z": -2}, {"x": 1, "y": 2, "w": -1}


def bag(spark, d):
    return spark.createDataFrame(list(d.items()), "elem string, n bigint")


def back(df):
    return {r.elem: r.n for r in df.collect()}


CASES = [
    (bags.add, {"x": 4, "y": 3}),
    (bags.subtract_positive, {"x": 2, "w": 1}),
    (bags.union_max, {"x": 3, "y": 2}),
    (bags.intersect_min, {"x": 1, "y": 1}),
    (bags.update, {"x": 4, "y": 3, "z": -2, "w": -1}),
    (bags.subtract_signed, {"x": 2, "y": -1, "z": -2, "w": 1}),
]


@pytest.mark.parametrize(("op", "want"), CASES)
def test_algebra(spark, op, want):
    assert back(op(bag(spark, A), bag(spark, B))) == want


def test_elements_most_common_and_without(spark):
    a = bag(spark, A)
    assert sorted(r.elem for r in bags.elements(a).collect()) == ["x", "x", "x", "y"]
    assert [tuple(r) for r in bags.most_common(a, 2).collect()] == [("x", 3), ("y", 1)]
    assert back(bags.without(a, "x")) == {"y": 1, "z": -2}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(-3, 5)), st.dictionaries(st.sampled_from("abcdef"), st.integers(-3, 5)))
def test_algebra_equals_counters(spark, a, b):
    ca, cb = Counter(a), Counter(b)
    x, y = bag(spark, a), bag(spark, b)
    assert back(bags.add(x, y)) == dict(ca + cb)
    assert back(bags.subtract_positive(x, y)) == dict(ca - cb)
    assert back(bags.union_max(x, y)) == dict(ca | cb)
    assert back(bags.intersect_min(x, y)) == dict(ca & cb)


def test_maps(spark):
    df = spark.range(1).select(F.create_map(F.lit("x"), F.lit(3), F.lit("z"), F.lit(-2)).cast("map<string,bigint>").alias("a"), F.create_map(F.lit("x"), F.lit(1), F.lit("w"), F.lit(-1)).cast("map<string,bigint>").alias("b"))
    got = df.select(*(bags.map_merge(F.col("a"), F.col("b"), how).alias(how) for how in ("add", "subtract", "max", "min"))).first()
    assert got == ({"x": 4}, {"x": 2, "w": 1}, {"x": 3}, {"x": 1})
