"""Queries that write the tables in the text formats and read them back with the readers, with their SQL over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import linkgraph, mail, retrieval
from quillgraph.plans import duplicate_queries, graph_queries, retrieval_queries, tables
from quillgraph.plans.retrieval_queries import WORDS
from quillgraph.sources import readers, sinks
from quillgraph.storage import folder

_SPACE = r"[ \t\n\r\f\x0B]+"


def _written(lines: DataFrame, line: Column, **options: object) -> str:
    """The folder that the lines are written to."""
    at = folder(lines.sparkSession, "files")
    lines.select(line.alias("line")).write.options(**options).text(at)
    return at


def scan_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a line of its number and its words."""
    docs = tables.table(spark, sf, "documents")
    line = F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.array_join(T.tokens(F.col("text")), " "))
    return readers.terms(spark, _written(docs, line))


def scan_speeches(spark: SparkSession, sf: str) -> DataFrame:
    """Every nation as a file of its own, whose name is its id."""
    nations = tables.table(spark, sf, "nation")
    at = _written(nations, F.concat("n_name", F.lit("\nof region "), F.col("n_regionkey").cast("string")), maxRecordsPerFile=1)
    return readers.speeches(spark, at).select(T.strip(F.col("text")).alias("text"), F.col("id").rlike(r"^part-[0-9]{5}-[^./]*$").alias("named"))


def scan_edges(spark: SparkSession, sf: str) -> DataFrame:
    messages = tables.messages(spark, sf)
    line = F.concat_ws(" ", F.concat(F.lit("m"), F.col("msg_id").cast("string")), F.col("src").cast("string"), F.col("dst").cast("string"))
    return readers.edge_list(spark, _written(messages, line)).select("msg_id", "src", "dst")


def scan_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer as a line of two addresses, known by the name of a nation."""
    c = tables.table(spark, sf, "customer").join(F.broadcast(tables.table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    key = F.col("c_custkey").cast("string")
    return readers.aliases(spark, _written(c, F.concat("n_name", F.lit(" : c"), key, F.lit("@x.com, d"), key, F.lit("@y.com ,"))))


def scan_roles(spark: SparkSession, sf: str) -> DataFrame:
    c = tables.table(spark, sf, "customer")
    at = _written(c, F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("\t"), "c_name", F.lit("  x  Employee  "), "c_mktsegment"))
    return readers.roles(spark, at, special={"customer.000000001": "first@y.com"}).select("email", "alias", "extra")


def _mail(spark: SparkSession, sf: str) -> DataFrame:
    turns = tables.table(spark, sf, "conversations")
    name = F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    record = F.concat(F.lit("<DOC> mail/box/"), name, F.lit("/part\nFrom: "), "role", F.lit("\nSubject: Re: "), "role", F.lit(" says 7 things\n\n"), "text", F.lit("\n</DOC>"))
    return readers.mail_archive(spark, _written(turns, record))


def scan_mail(spark: SparkSession, sf: str) -> DataFrame:
    return _mail(spark, sf).select("msg_id", "subject", F.array_join(T.tokens(F.col("body")), " ").alias("body"))


def _vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    parts = tables.table(spark, sf, "part")
    return readers.vocabulary(spark, _written(parts, F.concat(F.lit("The "), "p_name", F.lit(", ("), "p_type", F.lit(") says user"))))


def scan_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return _vocabulary(spark, sf)


def mail_subject_words(spark: SparkSession, sf: str) -> DataFrame:
    """Subject words that the vocabulary has."""
    known = mail.known_terms(_mail(spark, sf).select("msg_id", T.subject_terms(F.col("subject")).alias("terms")), _vocabulary(spark, sf))
    return known.select("msg_id", F.array_join("terms", " ").alias("terms"))


def mail_body_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the bodies that a vocabulary has, the documents' words, and how often each stands in all mail."""
    docs = tables.table(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    return mail.known_body_words(_mail(spark, sf), docs).groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("mails"))


def run_file(spark: SparkSession, sf: str) -> DataFrame:
    """Scores written as a run and read as lines."""
    at = folder(spark, "files")
    sinks.run_file(retrieval_queries.tfidf_topk(spark, sf).withColumn("score", F.round("score", 3)), at)
    return spark.read.text(at).withColumnRenamed("value", "line")


def pair_file(spark: SparkSession, sf: str) -> DataFrame:
    at = folder(spark, "files")
    sinks.pair_file(duplicate_queries.near_dups_bands(spark, sf), at)
    return spark.read.text(at).withColumnRenamed("value", "line")


def score_file(spark: SparkSession, sf: str) -> DataFrame:
    """Hubs, kept back unless the best one's score lies where it must."""
    at = folder(spark, "files")
    scores = graph_queries.hits_hubs_top10(spark, sf)
    best = scores.orderBy(F.desc("hub"), "node").first()
    refused = sinks.score_file(scores, at, "hub", (best["node"], 0.0, best["hub"] / 2))
    written = sinks.score_file(scores, at, "hub", (best["node"], best["hub"] / 2, 1.0))
    return spark.read.text(at).select(F.col("value").alias("line"), F.lit(written and not refused).alias("checked"))


def dot_file(spark: SparkSession, sf: str) -> DataFrame:
    at = folder(spark, "files")
    sinks.dot_file(graph_queries.relation_labels(spark, sf), at)
    return spark.read.text(at).withColumnRenamed("value", "line")


def grid_file(spark: SparkSession, sf: str) -> DataFrame:
    at = folder(spark, "files")
    points = retrieval.grid(spark)
    sinks.grid_blocks(points.select("k", "n_d", "n_w", (F.col("n_w") / F.lit(8.0)).alias("map")), at)
    return spark.read.text(at).withColumnRenamed("value", "line")


def interesting_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Messages among the interesting nodes, both ends with what is known of the people."""
    edges = graph_queries.alias_edges(spark, sf)
    chosen = linkgraph.interesting(edges, linkgraph.pagerank(edges))
    kept = linkgraph.relations(edges, chosen, more_than=0)
    nations = tables.table(spark, sf, "nation").select((-1 - F.col("n_nationkey")).cast("bigint").alias("email"), mail.person(F.concat("n_name", F.lit("@x.com")), F.concat("n_name", F.lit("  x  Vice President  Vice President of "), F.col("n_regionkey").cast("string"))).alias("person"))
    for end in ("src", "dst"):
        names = mail.with_people(kept.select(F.col(end).alias("node")).distinct(), nations, F.concat(F.lit("part."), F.col("node").cast("string"), F.lit("@x.com")))
        kept = kept.join(names.select(F.col("node").alias(end), mail.description(F.struct("name", "job", "extra")).alias(f"{end}_name")), end)
    return kept.select("src", "dst", "mult", "src_name", "dst_name")


MAIL = "mails AS (SELECT conv_id || '.' || turn AS msg_id, 'Re: ' || role || ' says 7 things' AS subject, text FROM conversations)"
VOCABULARY = f"""vocabulary AS (SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(translate(lower('The ' || p_name || ', (' || p_type || ') says user'), '{T.PUNCTUATION.replace("'", "''")}', ''), '{_SPACE}')) AS word FROM part)
WHERE word <> '' AND word NOT IN ({", ".join(f"'{w}'" for w in T.STOPWORDS)}))"""
_NAME = "CASE WHEN {0} < 0 THEN 'NATION_' || (-1 - {0}) || '\\n(' || 'VP of ' || n_regionkey || ')' ELSE 'Part ' || {0} || '\\n(, )' END"

QUERIES = {
    "scan_terms": (scan_terms, f"SELECT doc_id, coalesce(array_to_string({WORDS.format('text')}, ' '), '') AS text FROM documents"),
    "scan_speeches": (scan_speeches, "SELECT n_name || chr(10) || 'of region ' || n_regionkey AS text, true AS named FROM nation"),
    "scan_edges": (scan_edges, "SELECT 'm' || l_orderkey AS msg_id, o_custkey::VARCHAR AS src, l_partkey::VARCHAR AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey"),
    "scan_aliases": (scan_aliases, "SELECT unnest(['c' || c_custkey || '@x.com', 'd' || c_custkey || '@y.com']) AS email, n_name AS alias FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "scan_roles": (scan_roles, "SELECT email, email AS alias, extra FROM (SELECT CASE WHEN c_custkey = 1 THEN 'first@y.com' ELSE replace(lower(c_name), '#', '.') || '@example.com' END AS email, c_name || '  x  Employee  ' || c_mktsegment AS extra FROM customer)"),
    "scan_mail": (scan_mail, f"WITH {MAIL} SELECT msg_id, subject, coalesce(array_to_string({WORDS.format('text')}, ' '), '') AS body FROM mails"),
    "scan_vocabulary": (scan_vocabulary, f"WITH {VOCABULARY} SELECT word FROM vocabulary"),
    "mail_subject_words": (mail_subject_words, f"WITH {MAIL}, {VOCABULARY} SELECT msg_id, string_agg(word, ' ' ORDER BY pos) AS terms FROM (SELECT msg_id, unnest(string_split(lower(subject[5:]), ' ')) AS word, unnest(range(4)) AS pos FROM mails) JOIN vocabulary USING (word) GROUP BY msg_id"),
    "mail_body_words": (
        mail_body_words,
        f"""WITH words AS (SELECT conv_id, turn, unnest({WORDS.format('text')}) AS word FROM conversations), known AS (SELECT DISTINCT unnest({WORDS.format('text')}) AS word FROM documents)
SELECT word, sum(n)::BIGINT AS n, count(*) AS mails FROM (SELECT conv_id, turn, word, count(*) AS n FROM words WHERE word IN (SELECT word FROM known) AND NOT regexp_matches(word, '^[0-9]+$') GROUP BY ALL) GROUP BY word""",
    ),
    "run_file": (run_file, retrieval_queries.QUERIES["tfidf_topk"][1].replace("SELECT query_id, rank::INT AS rank, doc_id, round(score, 6) AS score", "SELECT query_id || ' 0 ' || doc_id || ' 0 ' || round(round(score, 6), 3) || ' 0' AS line")),
    "pair_file": (pair_file, duplicate_queries.QUERIES["near_dup_lines"][1]),
    "score_file": (score_file, f"WITH best AS ({graph_queries.QUERIES['hits_hubs_top10'][1]}) SELECT printf('%.8f', hub) || ' ' || node AS line, true AS checked FROM best"),
    "dot_file": (dot_file, graph_queries.QUERIES["dot_lines"][1]),
    "grid_file": (
        grid_file,
        """WITH ks AS (SELECT round(i * 0.1, 1) AS k FROM range(1, 31) t(i)), points AS (SELECT k, n_d, unnest(range(2 * n_d - 10, 2 * n_d + 10)) AS n_w FROM ks, range(15, 31) t(n_d))
SELECT k || ',' || n_d || ',' || n_w || ',' || (n_w / 8.0)::DOUBLE AS line FROM points UNION ALL SELECT '' FROM ks""",
    ),
    "interesting_relations": (
        interesting_relations,
        f"""WITH {graph_queries.ALIASED}, edges AS (SELECT * FROM alias_edges), nodes AS MATERIALIZED (SELECT src AS node FROM edges UNION SELECT dst FROM edges), {graph_queries.pagerank_sql()}, {graph_queries.INTERESTING}
SELECT src, dst, mult, {_NAME.format('src').replace('n_regionkey', 'a.n_regionkey')} AS src_name, {_NAME.format('dst').replace('n_regionkey', 'b.n_regionkey')} AS dst_name FROM edges
LEFT JOIN nation a ON src = -1 - a.n_nationkey LEFT JOIN nation b ON dst = -1 - b.n_nationkey WHERE src IN (SELECT node FROM chosen) AND dst IN (SELECT node FROM chosen)""",
    ),
}
