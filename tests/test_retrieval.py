import pytest

from quillgraph.operators import retrieval as R


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "fox den"), (3, "blue sky blue sky")], "doc_id bigint, text string")
    q = R.term_counts(spark.createDataFrame([(10, "red fox fox")], "doc_id bigint, text string")).withColumnRenamed("doc_id", "query_id")
    return R.corpus(docs), q


@pytest.mark.parametrize(("k", "want"), [(2.0, {1: 0.819616, 2: 0.347542}), (0.75, {1: 1.262379, 2: 0.540620})])
def test_tfidf(small, k, want):
    c, q = small
    got = {r.doc_id: round(r.score, 6) for r in R.tfidf(q.withColumnRenamed("tf", "weight"), c, k).collect()}
    assert got == want


def test_overlap_and_lines(small):
    c, q = small
    got = R.overlap(q, c)
    assert {r.doc_id: r.score for r in got.collect()} == {1: 2, 2: 1}
    assert sorted(r.line for r in R.run_lines(got).collect()) == ["10 0 1 0 2 0", "10 0 2 0 1 0"]


def test_words_that_the_corpus_lacks_are_dropped_from_feedback(spark, small):
    c, _ = small
    q = spark.createDataFrame([(1, "red", 1), (1, "unseen", 4)], "query_id bigint, term string, tf bigint")
    terms = {r.term for r in R.expansion_terms(q, c, R.single(spark)).collect()}
    assert "unseen" not in terms and "red" in terms


def test_grid_has_9600_points_and_zero_means_default(spark):
    assert R.grid(spark).count() == 9600
    assert tuple(R.single(spark, 0, 0, 0).first())[1:] == (0.75, 19, 38)


def test_average_precision(spark):
    scores = spark.createDataFrame([(1, d, s) for d, s in ((1, 0.9), (2, 0.8), (3, 0.7))], "query_id bigint, doc_id bigint, score double")
    rel = spark.createDataFrame([(1,), (3,), (9,)], "doc_id bigint")
    assert R.average_precision(scores, rel).first().ap == pytest.approx((1 + 2 / 3) / 3)


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "a", 1)], "query_id bigint, term string, weight bigint")
    assert R.tfidf(q, R.corpus(docs)).collect() == []
