"""Queries over message graphs and mail, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import linkgraph, mail
from quillgraph.plans import tables
from quillgraph.plans.retrieval_queries import WORDS
from quillgraph.storage import cut

MESSAGES = """
messages AS (SELECT l_orderkey AS msg_id, o_custkey AS src, l_partkey AS dst, l_shipdate AS day, l_orderkey, l_linenumber, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
edges AS MATERIALIZED (SELECT src, dst, count(*) AS mult FROM messages WHERE src <> dst GROUP BY ALL),
nodes AS MATERIALIZED (SELECT src AS node FROM edges UNION SELECT dst FROM edges)"""


def pagerank_sql(rounds: int = 10) -> str:
    """CTEs up to r{rounds}(node, score)."""
    steps = ["outs AS MATERIALIZED (SELECT src, sum(mult) AS total FROM edges GROUP BY src)", "size AS (SELECT count(*) AS n FROM nodes)", "r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / n AS score FROM nodes CROSS JOIN size)"]
    for i in range(1, rounds + 1):
        steps.append(
            f"""r{i} AS MATERIALIZED (SELECT node, ((0.2 + 0.8 * (SELECT coalesce(sum(score), 0) FROM r{i - 1} WHERE node NOT IN (SELECT src FROM outs))) / (SELECT n FROM size)) + 0.8 * coalesce(gain, 0) AS score
FROM nodes LEFT JOIN (SELECT dst AS node, sum(mult * score / total) AS gain FROM edges JOIN outs USING (src) JOIN r{i - 1} ON node = src GROUP BY dst) USING (node))"""
        )
    return ",\n".join(steps)


def hits_sql(rounds: int = 10) -> str:
    """CTEs up to h{rounds}(node, score) and a{rounds}(node, score)."""
    steps = ["a0 AS MATERIALIZED (SELECT node, 1 / sqrt((SELECT count(*) FROM nodes)) AS score FROM nodes)"]
    for i in range(1, rounds + 1):
        for name, of, to, frm in (("h", "dst", "src", f"a{i - 1}"), ("a", "src", "dst", f"h{i}")):
            steps.append(f"{name}x{i} AS MATERIALIZED (SELECT node, coalesce(raw, 0) AS raw FROM nodes LEFT JOIN (SELECT {to} AS node, sum(mult * score) AS raw FROM edges JOIN {frm} ON node = {of} GROUP BY {to}) USING (node))")
            steps.append(f"{name}{i} AS MATERIALIZED (SELECT node, raw / sqrt((SELECT sum(raw * raw) FROM {name}x{i})) AS score FROM {name}x{i})")
    return ",\n".join(steps)


def _top_sql(source: str, column: str, n: int = 10) -> str:
    return f"SELECT node, round(score, 8) AS {column} FROM {source} ORDER BY {column} DESC, node LIMIT {n}"


def two_core_sql(rounds: int = 30) -> str:
    """CTEs up to k{rounds}(src, dst, mult) from relations."""
    steps = ["k0 AS MATERIALIZED (SELECT * FROM relations)"]
    for i in range(1, rounds + 1):
        last = f"k{i - 1}"
        steps.append(f"weak{i} AS MATERIALIZED (SELECT node FROM (SELECT src AS node, dst AS other FROM {last} UNION SELECT dst, src FROM {last}) GROUP BY node HAVING count(*) < 2)")
        steps.append(f"k{i} AS MATERIALIZED (SELECT * FROM {last} WHERE src NOT IN (SELECT node FROM weak{i}) AND dst NOT IN (SELECT node FROM weak{i}))")
    return ",\n".join(steps)


INTERESTING = f"""best AS ({_top_sql("r10", "score", 8)}),
contact AS (SELECT src, dst FROM edges QUALIFY row_number() OVER (PARTITION BY src ORDER BY mult DESC, dst) = 2),
chosen AS (SELECT node FROM best UNION SELECT dst FROM contact JOIN best ON node = src)"""

#: A subject for each message: its order's priority and status as words.
SUBJECT = "'Re: ' || o_orderpriority || ' ' || o_orderstatus || ' order'"
TERMS = """list_filter(string_split_regex(translate(trim(replace(replace(replace(replace(lower({}), 're: ', ''), 'fw: ', ''), 're ', ''), 'fw ', '')), '{}', ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '' AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN ({}))"""
_PUNCT, _STOP = T.PUNCTUATION.replace("'", "''"), ", ".join(f"'{w}'" for w in T.STOPWORDS)


def _terms_sql(text: str) -> str:
    return TERMS.format(text, _PUNCT, _STOP)


LABELS = f"""relations AS (SELECT src, dst, mult FROM edges WHERE mult > 1),
subjects AS (SELECT o_orderkey AS msg_id, {_terms_sql(SUBJECT)} AS terms FROM orders),
said AS (SELECT src, term, count(*) AS n FROM (SELECT src, unnest(terms) AS term FROM (SELECT DISTINCT src, msg_id FROM messages WHERE src <> dst) JOIN subjects USING (msg_id)) GROUP BY ALL),
label AS (SELECT src, term FROM said QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, term) = 1),
labelled AS (SELECT r.src, r.dst, coalesce(term, '') AS label FROM relations r LEFT JOIN label USING (src))"""


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return linkgraph.edges(tables.messages(spark, sf))


def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf)


def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    return linkgraph.stats(_edges(spark, sf))


def sink_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return linkgraph.sinks(_edges(spark, sf))


def message_run_count(spark: SparkSession, sf: str) -> DataFrame:
    return linkgraph.message_runs(tables.messages(spark, sf), "day", "line")


def alias_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of one nation count as one."""
    c = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("email"), (-1 - F.col("c_nationkey")).cast("bigint").alias("alias"))
    return linkgraph.edges(linkgraph.rename(tables.messages(spark, sf), c))


def pagerank_top10(spark: SparkSession, sf: str) -> DataFrame:
    return linkgraph.top(linkgraph.pagerank(_edges(spark, sf)))


def hits_hubs_top10(spark: SparkSession, sf: str) -> DataFrame:
    return linkgraph.top(linkgraph.hits(_edges(spark, sf)), column="hub")


def hits_auth_top10(spark: SparkSession, sf: str) -> DataFrame:
    return linkgraph.top(linkgraph.hits(_edges(spark, sf)), column="authority")


def interesting_nodes(spark: SparkSession, sf: str) -> DataFrame:
    e = cut(_edges(spark, sf))
    return linkgraph.interesting(e, linkgraph.pagerank(e))


def relations_2core(spark: SparkSession, sf: str) -> DataFrame:
    return linkgraph.two_core(linkgraph.relations(alias_edges(spark, sf), more_than=11))


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    m = cut(tables.messages(spark, sf).select("msg_id", "src", "dst"))
    subject = F.concat(F.lit("Re: "), "o_orderpriority", F.lit(" "), "o_orderstatus", F.lit(" order"))
    subjects = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("msg_id"), T.subject_terms(subject).alias("terms"))
    return mail.labels(linkgraph.relations(linkgraph.edges(m), more_than=1), linkgraph.message_ids(m), subjects)


def relation_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(spark, sf)


def dot_lines(spark: SparkSession, sf: str) -> DataFrame:
    return mail.dot_lines(_labels(spark, sf))


def subject_terms(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(T.subject_terms(F.col("text")), " ").alias("terms"))


def _extra() -> F.Column:
    odd = F.col("c_custkey") % 4
    return F.concat(
        F.when(odd == 0, "xxx").otherwise(F.col("c_name")), F.lit("  "), F.when(odd == 1, "N/A").otherwise("x"), F.lit("   "),
        F.when(odd == 2, "Employee").otherwise("Vice President"), F.lit("  "), F.when(F.col("c_custkey") % 3 == 0, "Vice President of ").otherwise(""), F.col("c_mktsegment"),
    )


def person_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    email = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))
    return tables.table(spark, sf, "customer").select("c_custkey", mail.description(mail.person(email, _extra())).alias("description"))


def mail_best_word(spark: SparkSession, sf: str) -> DataFrame:
    turns = tables.table(spark, sf, "conversations").withColumn("msg_id", F.struct("conv_id", "turn"))
    return mail.best_words(turns)


ALIASED = """named AS (SELECT coalesce(-1 - a.c_nationkey, o_custkey)::BIGINT AS src, coalesce(-1 - b.c_nationkey, l_partkey)::BIGINT AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey
LEFT JOIN customer a ON a.c_custkey = o_custkey LEFT JOIN customer b ON b.c_custkey = l_partkey),
alias_edges AS MATERIALIZED (SELECT src, dst, count(*) AS mult FROM named WHERE src <> dst GROUP BY ALL)"""

_G = f"WITH {MESSAGES}"
QUERIES = {
    "graph_edges": (graph_edges, f"{_G} SELECT * FROM edges"),
    "alias_edges": (
        alias_edges,
        f"WITH {ALIASED} SELECT * FROM alias_edges",
    ),
    "graph_stats": (graph_stats, f"{_G}, s AS (SELECT DISTINCT src AS node FROM edges), r AS (SELECT DISTINCT dst AS node FROM edges), c AS (SELECT (SELECT count(*) FROM s) AS senders, (SELECT count(*) FROM r) AS recipients, (SELECT count(*) FROM s JOIN r USING (node)) AS both_, (SELECT count(*) FROM nodes) AS either) SELECT senders, recipients, both_ AS \"both\", either, senders + recipients - both_ = either AS consistent FROM c"),
    "sink_nodes": (sink_nodes, f"{_G} SELECT node FROM nodes WHERE node NOT IN (SELECT src FROM edges)"),
    "message_run_count": (message_run_count, f"{_G} SELECT sum(new)::BIGINT AS runs FROM (SELECT (msg_id IS DISTINCT FROM lag(msg_id) OVER (ORDER BY day, l_orderkey, l_linenumber, l_suppkey))::INT AS new FROM messages)"),
    "pagerank_top10": (pagerank_top10, f"{_G}, {pagerank_sql()} {_top_sql('r10', 'score')}"),
    "hits_hubs_top10": (hits_hubs_top10, f"{_G}, {hits_sql()} {_top_sql('h10', 'hub')}"),
    "hits_auth_top10": (hits_auth_top10, f"{_G}, {hits_sql()} {_top_sql('a10', 'authority')}"),
    "interesting_nodes": (interesting_nodes, f"{_G}, {pagerank_sql()}, {INTERESTING} SELECT node FROM chosen"),
    "relations_2core": (relations_2core, f"WITH {ALIASED}, relations AS (SELECT src, dst, mult FROM alias_edges WHERE mult > 11), {two_core_sql()} SELECT * FROM k30"),
    "relation_labels": (relation_labels, f"{_G}, {LABELS} SELECT src, dst, label FROM labelled"),
    "dot_lines": (dot_lines, f"{_G}, {LABELS} SELECT 'digraph G {{' AS line UNION ALL SELECT '\"' || src || '\" -> \"' || dst || '\" [label = \"' || label || '\"];' FROM labelled UNION ALL SELECT '}}'"),
    "subject_terms": (subject_terms, f"SELECT conv_id, turn, CASE WHEN len(t) > 0 THEN array_to_string(t, ' ') END AS terms FROM (SELECT conv_id, turn, {_terms_sql('text')} AS t FROM conversations)"),
    "person_descriptions": (
        person_descriptions,
        r"""WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Customer ' || c_name[10:] ELSE c_name END AS name,
CASE WHEN c_custkey % 4 < 2 THEN '' WHEN c_custkey % 4 = 2 THEN 'Employee' ELSE 'VP' END AS job,
CASE WHEN c_custkey % 4 < 2 THEN '' ELSE CASE WHEN c_custkey % 3 = 0 THEN 'VP of ' ELSE '' END || c_mktsegment END AS extra FROM customer)
SELECT c_custkey, name || '\n(' || CASE WHEN job = 'Employee' OR starts_with(extra, job) THEN extra ELSE job || ', ' || extra END || ')' AS description FROM p""",
    ),
    "mail_best_word": (
        mail_best_word,
        f"""WITH sized AS (SELECT conv_id, turn, {WORDS.format("text")} AS words FROM conversations),
postings AS (SELECT conv_id, turn, term, length, count(*) AS tf FROM (SELECT conv_id, turn, len(words) AS length, unnest(words) AS term FROM sized) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term), stats AS (SELECT count(*) AS n_docs, sum(len(words)) / count(*) AS avg_length FROM sized)
SELECT term, round(sum((tf / (tf + 2 * length / avg_length)) * ln(n_docs / df)), 6) AS score FROM postings JOIN dfs USING (term) CROSS JOIN stats GROUP BY term HAVING score > 0 ORDER BY score DESC, term LIMIT 1""",
    ),
}
