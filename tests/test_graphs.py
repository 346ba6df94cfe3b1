import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import linkgraph as G
from quillgraph.operators import mail

LINES = "m1 ann bob|m1 ann cat|m2 bob cat|m3 cat bob|m3 bob bob|m1 ann bob|m4 cat dan".split("|")
SCORES = {"ann": (0.09871162, 0.88765033, 0), "bob": (0.29594612, 0.17214783, 0.88765034), "cat": (0.36200253, 0.42713233, 0.42713227), "dan": (0.24333973, 0, 0.17214787)}


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame([(i, i // 3, *x.split()) for i, x in enumerate(LINES)], "line int, day int, msg_id string, src string, dst string")


def test_edges_runs_and_stats(messages):
    e = G.edges(messages)
    assert {(r.src, r.dst): r.mult for r in e.collect()} == {("ann", "bob"): 2, ("ann", "cat"): 1, ("bob", "cat"): 1, ("cat", "bob"): 1, ("cat", "dan"): 1}
    assert G.message_runs(messages, "day", "line").first().runs == 5
    assert [r.node for r in G.sinks(e).collect()] == ["dan"]
    assert tuple(G.stats(e).first()) == (3, 3, 2, 4, True)


def test_pagerank_and_hits(messages):
    e = G.edges(messages)
    ranks = G.pagerank(e)
    assert {r.node: round(r.score, 8) for r in ranks.collect()} == {k: v[0] for k, v in SCORES.items()}
    both = {r.node: (r.hub, r.authority) for r in G.hits(e).collect()}
    for k, (_, hub, auth) in SCORES.items():
        assert both[k] == pytest.approx((hub, auth), abs=1e-8)
    assert G.check_node(ranks, "dan", 0.24, 0.25) and not G.check_node(ranks, "dan", 0.1, 0.2)
    again = G.pagerank(e, iterations=5, start=G.pagerank(e, iterations=5))
    assert {r.node: round(r.score, 8) for r in again.collect()} == {k: v[0] for k, v in SCORES.items()}
    with pytest.raises(ValueError, match="add up"):
        G.check_total(0.5)


def test_interesting_nodes_and_aliases(spark, messages):
    e = G.edges(messages)
    got = {r.node for r in G.interesting(e, G.pagerank(e), 1).collect()}
    assert got == {"cat", "dan"}
    named = G.rename(messages, spark.createDataFrame([("bob", "cat")], "email string, alias string"))
    assert {(r.src, r.dst): r.mult for r in G.edges(named).collect()} == {("ann", "cat"): 3, ("cat", "dan"): 1}


def test_two_core(spark):
    rel = spark.createDataFrame([("a", "b", 9), ("b", "c", 9), ("c", "a", 9), ("c", "d", 9), ("d", "e", 9)], "src string, dst string, mult bigint")
    assert {(r.src, r.dst) for r in G.two_core(rel).collect()} == {("a", "b"), ("b", "c"), ("c", "a")}
    assert G.two_core(rel.where("src = 'd'")).collect() == []


def test_subjects_labels_and_dot(spark, messages):
    s = spark.createDataFrame([("m1", "Re: Fire drill 2024"), ("m2", "FW: the"), ("m3", None)], "msg_id string, subject string")
    terms = {r.msg_id: r.t for r in s.select("msg_id", T.subject_terms(F.col("subject")).alias("t")).collect()}
    assert terms == {"m1": ["fidrill"], "m2": None, "m3": None}
    rel = G.relations(G.edges(messages), more_than=1)
    got = mail.labels(rel, G.message_ids(messages), s.select("msg_id", T.subject_terms(F.col("subject")).alias("terms")))
    assert [r.line for r in mail.dot_lines(got).collect()] == ["digraph G {", '"ann" -> "bob" [label = "fidrill"];', "}"]


@pytest.mark.parametrize(
    ("email", "extra", "want"),
    [
        ("a.b@x", None, "A B\\n()"),
        ("a.b@x", "xxx  N/A  Job  More", "A B\\n()"),
        ("a@x", "Ann Lee  N/A  Job", "Ann Lee\\n()"),
        ("a@x", "Ann Lee  y  Employee  Trading desk", "Ann Lee\\n(Trading desk)"),
        ("a@x", "Ann Lee  y  Vice President   Vice President of Gas", "Ann Lee\\n(VP of Gas)"),
        ("a@x", "Ann Lee  y  Manager  Gas", "Ann Lee\\n(Manager, Gas)"),
    ],
)
def test_people(spark, email, extra, want):
    df = spark.createDataFrame([(email, extra)], "email string, extra string")
    assert df.select(mail.description(mail.person(F.col("email"), F.col("extra"))).alias("d")).first().d == want
