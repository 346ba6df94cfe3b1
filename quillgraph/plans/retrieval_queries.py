"""Queries over bags and ranked retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import bags, retrieval
from quillgraph.plans import tables

WORDS = r"list_filter(string_split_regex({}, '[ \t\n\r\f\x0B]+'), lambda w: w <> '')"

CORPUS = f"""
sized AS (SELECT doc_id, {WORDS.format("text")} AS words FROM documents),
postings AS (SELECT doc_id, term, length, count(*) AS tf FROM (SELECT doc_id, len(words) AS length, unnest(words) AS term FROM sized) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
stats AS (SELECT count(*) AS n_docs, sum(len(words)) AS total_length, sum(len(words)) / count(*) AS avg_length FROM sized),
asked AS (SELECT query_id, term, count(*) AS tf FROM (SELECT item_id AS query_id, unnest({WORDS.format("text")}) AS term FROM benchmark) GROUP BY ALL)"""

WEIGHT = "(tf / (tf + k * length / avg_length)) * ln(n_docs / df)"


def _tfidf_sql(k: str) -> str:
    return f"""scores AS (SELECT query_id, doc_id, sum(q.tf * (p.tf / (p.tf + {k} * p.length / avg_length)) * ln(n_docs / df)) AS score
FROM asked q JOIN postings p USING (term) JOIN dfs USING (term) CROSS JOIN stats GROUP BY query_id, doc_id)"""


def _feedback_sql(grid: str) -> str:
    return f"""
grid AS ({grid}),
first AS (SELECT k, query_id, doc_id, sum(q.tf * (p.tf / (p.tf + k * p.length / avg_length)) * ln(n_docs / df)) AS score
  FROM (SELECT DISTINCT k FROM grid) CROSS JOIN asked q JOIN postings p USING (term) JOIN dfs USING (term) CROSS JOIN stats GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k, query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM first),
picked AS (SELECT run, k, n_w, query_id, doc_id FROM ranked JOIN grid USING (k) WHERE r <= n_d),
mega AS (SELECT run, k, n_w, query_id, term, sum(tf) AS tf FROM (
    SELECT run, k, n_w, query_id, term, tf FROM picked JOIN postings USING (doc_id)
    UNION ALL SELECT run, k, n_w, query_id, term, tf FROM (SELECT DISTINCT run, k, n_w, query_id FROM picked) JOIN asked USING (query_id)) GROUP BY ALL),
sized_mega AS (SELECT *, sum(tf) OVER (PARTITION BY run, query_id) AS length FROM mega),
worded AS (SELECT run, k, n_w, query_id, term, {WEIGHT} AS weight FROM sized_mega JOIN dfs USING (term) CROSS JOIN stats),
expansion AS (SELECT run, k, query_id, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY run, query_id ORDER BY round(weight, 9) DESC, term) AS r FROM worded) WHERE r <= n_w),
scores AS (SELECT run, query_id, doc_id, sum(e.weight * (p.tf / (p.tf + k * p.length / avg_length)) * ln(n_docs / df)) AS score
  FROM expansion e JOIN postings p USING (term) JOIN dfs USING (term) CROSS JOIN stats GROUP BY ALL)"""


SINGLE = "SELECT 0 AS run, 0.75::DOUBLE AS k, 19 AS n_d, 38 AS n_w"
KS, N_DS = (0.5, 0.75, 1.5), (15, 16)
POINTS = [(k, n_d, n_w) for k in KS for n_d in N_DS for n_w in (2 * n_d - 10, 2 * n_d)]
GRID = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {k}::DOUBLE, {n_d}, {n_w})" for i, (k, n_d, n_w) in enumerate(POINTS)) + ") AS g(run, k, n_d, n_w)"


def _rounded(df: DataFrame, name: str, places: int = 6) -> DataFrame:
    return df.withColumn(name, F.round(name, places))


def overlap_scores(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.overlap(tables.queries(spark, sf), tables.corpus(spark, sf)).select("query_id", "doc_id", "score")


def _tfidf(spark: SparkSession, sf: str, k: float) -> DataFrame:
    return retrieval.tfidf(tables.queries(spark, sf).withColumnRenamed("tf", "weight"), tables.corpus(spark, sf), k)


def tfidf_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_tfidf(spark, sf, 2.0), "score")


def tfidf_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(retrieval.top(_tfidf(spark, sf, 2.0), 10), "score").select("query_id", "rank", "doc_id", "score")


def prf_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(retrieval.feedback(tables.queries(spark, sf), tables.corpus(spark, sf), retrieval.single(spark)), "score").select("query_id", "doc_id", "score")


def prf_expansion_terms(spark: SparkSession, sf: str) -> DataFrame:
    terms = retrieval.expansion_terms(tables.queries(spark, sf), tables.corpus(spark, sf), retrieval.single(spark))
    return _rounded(terms, "weight").select("query_id", "term", "weight")


def prf_grid_map(spark: SparkSession, sf: str) -> DataFrame:
    grid = retrieval.grid(spark, KS, N_DS, lambda n_d: (2 * n_d - 10, 2 * n_d))
    scores = retrieval.feedback(tables.queries(spark, sf), tables.corpus(spark, sf), grid)
    ap = retrieval.average_precision(scores, tables.relevant(spark, sf), by=("run",))
    return ap.groupBy("run").agg(F.round(F.avg("ap"), 6).alias("map")).join(grid, "run").select("run", "k", "n_d", "n_w", "map")


def tfidf_grid_map(spark: SparkSession, sf: str) -> DataFrame:
    runs = list(enumerate(KS))
    ks = spark.createDataFrame(runs, "run int, k double")
    asked = tables.queries(spark, sf).withColumnRenamed("tf", "weight").crossJoin(F.broadcast(ks.select("run")))
    scores = retrieval.tfidf_runs(asked, tables.corpus(spark, sf), runs)
    ap = retrieval.average_precision(scores, tables.relevant(spark, sf), by=("run",)).join(F.broadcast(ks), "run")
    return ap.groupBy("k").agg(F.round(F.avg("ap"), 6).alias("map"))


def trec_lines_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.run_lines(overlap_scores(spark, sf))


def term_counts(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.term_counts(tables.table(spark, sf, "documents"))


def doc_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return tables.corpus(spark, sf, once=True).df


def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(tables.corpus(spark, sf, once=True).stats, "avg_length")


#: Bags with counts of either sign: lines per part and per supplier, less a fixed number.
BAGS = """
a AS (SELECT l_partkey AS elem, count(*) - 30 AS n FROM lineitem GROUP BY 1),
b AS (SELECT l_suppkey AS elem, count(*) - 600 AS n FROM lineitem GROUP BY 1),
m AS (SELECT elem, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b USING (elem))"""


def _bags(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    li = tables.table(spark, sf, "lineitem")
    return tuple(bags.count(li, F.col(c)).withColumn("n", F.col("n") - less) for c, less in (("l_partkey", 30), ("l_suppkey", 600)))


def _bag_query(f):
    return lambda spark, sf: f(*_bags(spark, sf))


def bag_elements(spark: SparkSession, sf: str) -> DataFrame:
    return bags.elements(_bags(spark, sf)[0])


def bag_most_common(spark: SparkSession, sf: str) -> DataFrame:
    words = retrieval.term_counts(tables.table(spark, sf, "documents")).groupBy(F.col("term").alias("elem")).agg(F.sum("tf").alias("n"))
    return bags.most_common(words, 100)


QUERIES = {
    "overlap_scores": (overlap_scores, f"WITH {CORPUS} SELECT query_id, doc_id, count(*) AS score FROM asked JOIN postings USING (term) GROUP BY query_id, doc_id"),
    "tfidf_scores": (tfidf_scores, f"WITH {CORPUS}, {_tfidf_sql('2')} SELECT query_id, doc_id, round(score, 6) AS score FROM scores"),
    "tfidf_topk": (tfidf_topk, f"WITH {CORPUS}, {_tfidf_sql('2')} SELECT query_id, rank::INT AS rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores) WHERE rank <= 10"),
    "prf_scores": (prf_scores, f"WITH {CORPUS}, {_feedback_sql(SINGLE)} SELECT query_id, doc_id, round(score, 6) AS score FROM scores"),
    "prf_expansion_terms": (prf_expansion_terms, f"WITH {CORPUS}, {_feedback_sql(SINGLE)} SELECT query_id, term, round(weight, 6) AS weight FROM expansion"),
    "prf_grid_map": (
        prf_grid_map,
        f"""WITH {CORPUS}, {_feedback_sql(GRID)},
rel AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY run, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores QUALIFY rank <= 1000),
hit AS (SELECT t.run, t.query_id, rank, rel.doc_id IS NOT NULL AS is_rel, sum((rel.doc_id IS NOT NULL)::INT) OVER (PARTITION BY t.run, t.query_id ORDER BY rank) AS hits FROM top t LEFT JOIN rel USING (doc_id)),
ap AS (SELECT run, query_id, sum(CASE WHEN is_rel THEN hits / rank ELSE 0 END) / (SELECT count(*) FROM rel) AS ap FROM hit GROUP BY ALL)
SELECT run, k, n_d, n_w, round(avg(ap), 6) AS map FROM ap JOIN grid USING (run) GROUP BY run, k, n_d, n_w""",
    ),
    "tfidf_grid_map": (
        tfidf_grid_map,
        f"""WITH {CORPUS}, ks AS (SELECT unnest([{", ".join(f"{k}::DOUBLE" for k in KS)}]) AS k),
scores AS (SELECT k, query_id, doc_id, sum(q.tf * (p.tf / (p.tf + k * p.length / avg_length)) * ln(n_docs / df)) AS score FROM ks CROSS JOIN asked q JOIN postings p USING (term) JOIN dfs USING (term) CROSS JOIN stats GROUP BY ALL),
rel AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY k, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores QUALIFY rank <= 1000),
hit AS (SELECT t.k, t.query_id, rank, rel.doc_id IS NOT NULL AS is_rel, sum((rel.doc_id IS NOT NULL)::INT) OVER (PARTITION BY t.k, t.query_id ORDER BY rank) AS hits FROM top t LEFT JOIN rel USING (doc_id)),
ap AS (SELECT k, query_id, sum(CASE WHEN is_rel THEN hits / rank ELSE 0 END) / (SELECT count(*) FROM rel) AS ap FROM hit GROUP BY ALL)
SELECT k, round(avg(ap), 6) AS map FROM ap GROUP BY k""",
    ),
    "trec_lines_overlap": (trec_lines_overlap, f"WITH {CORPUS} SELECT query_id || ' 0 ' || doc_id || ' 0 ' || count(*) || ' 0' AS line FROM asked JOIN postings USING (term) GROUP BY query_id, doc_id"),
    "term_counts": (term_counts, f"WITH {CORPUS} SELECT doc_id, term, tf FROM postings"),
    "doc_frequency": (doc_frequency, f"WITH {CORPUS} SELECT term, df FROM dfs"),
    "corpus_stats": (corpus_stats, f"WITH {CORPUS} SELECT n_docs, total_length::BIGINT AS total_length, round(avg_length, 6) AS avg_length FROM stats"),
    "bag_add": (_bag_query(bags.add), f"WITH {BAGS} SELECT elem, x + y AS n FROM m WHERE x + y > 0"),
    "bag_subtract_keep_pos": (_bag_query(bags.subtract_positive), f"WITH {BAGS} SELECT elem, x - y AS n FROM m WHERE x - y > 0"),
    "bag_subtract_signed": (_bag_query(bags.subtract_signed), f"WITH {BAGS} SELECT elem, x - y AS n FROM m"),
    "bag_update": (_bag_query(bags.update), f"WITH {BAGS} SELECT elem, x + y AS n FROM m"),
    "bag_union_max": (_bag_query(bags.union_max), f"WITH {BAGS} SELECT elem, greatest(x, y) AS n FROM m WHERE greatest(x, y) > 0"),
    "bag_intersect_min": (_bag_query(bags.intersect_min), f"WITH {BAGS} SELECT elem, least(x, y) AS n FROM m WHERE least(x, y) > 0"),
    "bag_elements": (bag_elements, f"WITH {BAGS} SELECT elem FROM (SELECT elem, unnest(range(n)) FROM a WHERE n > 0)"),
    "bag_most_common": (bag_most_common, f"WITH {CORPUS} SELECT term AS elem, sum(tf)::BIGINT AS n FROM postings GROUP BY 1 ORDER BY n DESC, elem LIMIT 100"),
}
