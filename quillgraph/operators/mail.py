"""Mail: people from role lists, labels of relations from subjects, the best word, and graphs as DOT lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import body_words
from quillgraph.operators.retrieval import corpus, weight


def default_name(email: Column) -> Column:
    """The local part with dots as spaces and words capitalised, letters after other signs included."""
    words = F.split(F.replace(F.split_part(email, F.lit("@"), F.lit(1)), F.lit("."), F.lit(" ")), "(?<=[^A-Za-z])(?=[A-Za-z])")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, F.length(w))))), "")


def person(email: Column, extra: Column) -> Column:
    """struct(name, job, extra) from a role line of name, a field that is not used, job and further text, parted by two or more spaces.

    A name of xxx means the default name and ends the line; so does N/A in the unused field.
    """
    fields = F.filter(F.split(F.coalesce(extra, F.lit("")), "  +"), lambda x: x != "")
    named = F.coalesce(F.get(fields, F.lit(0)) != "xxx", F.lit(False))
    goes_on = named & F.coalesce(F.get(fields, F.lit(1)) != "N/A", F.lit(False))

    def field(i: int) -> Column:
        return F.coalesce(F.when(goes_on, F.replace(F.get(fields, F.lit(i)), F.lit("Vice President"), F.lit("VP"))), F.lit(""))

    return F.struct(F.when(named, F.get(fields, F.lit(0))).otherwise(default_name(email)).alias("name"), field(2).alias("job"), field(3).alias("extra"))


def description(p: Column) -> Column:
    """Name, a line break as DOT writes it, and in brackets job and further text, or the text alone if it starts with the job or the job says little."""
    name, job, extra = p["name"], p["job"], p["extra"]
    inner = F.when((job == "Employee") | F.startswith(extra, job), extra).otherwise(F.concat(job, F.lit(", "), extra))
    return F.concat(name, F.lit("\\n("), inner, F.lit(")"))


def known_terms(subjects: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(msg_id, terms): the terms that the vocabulary (word) has, in their order; subjects without any are left out."""
    each = subjects.select("msg_id", F.posexplode("terms").alias("at", "word")).join(vocabulary.select("word"), "word", "left_semi")
    return each.groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("x")).select("msg_id", F.col("x.word").alias("terms"))


def known_body_words(mails: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(msg_id, word, n): words of the bodies that the vocabulary (word) has and that are not digits only."""
    each = mails.select("msg_id", F.explode(body_words(F.col("body"))).alias("word")).join(vocabulary.select("word"), "word", "left_semi")
    return each.groupBy("msg_id", "word").agg(F.count("*").alias("n"))


def with_people(nodes: DataFrame, people: DataFrame, address: Column | None = None) -> DataFrame:
    """(node, name, job, extra); nodes that no role line names get the default name of their address, which is the node itself unless given."""
    blank = person(F.col("node") if address is None else address, F.lit(None).cast("string"))
    got = nodes.join(people.select(F.col("email").alias("node"), "person"), "node", "left").withColumn("person", F.coalesce("person", blank))
    return got.select("node", "person.*")


def labels(relations: DataFrame, sent: DataFrame, subjects: DataFrame) -> DataFrame:
    """(src, dst, label): the most frequent subject word of the sender's messages, whoever got them; empty without any.

    ``sent`` is (src, msg_id), ``subjects`` (msg_id, terms). Words are counted once a sender, not once a relation.
    """
    senders = relations.select("src").distinct()
    words = sent.join(senders, "src", "left_semi").join(subjects, "msg_id").select("src", F.explode("terms").alias("term"))
    counted = words.groupBy("src", "term").agg(F.count("*").alias("n"))
    best = counted.groupBy("src").agg(F.min(F.struct((-F.col("n")).alias("n"), "term"))["term"].alias("label"))
    return relations.join(best, "src", "left").select("src", "dst", F.coalesce("label", F.lit("")).alias("label"))


def best_words(messages: DataFrame, k: float = 2.0, n: int = 1, id_col: str = "msg_id", text_col: str = "text") -> DataFrame:
    """(term, score): words by their tf.idf summed over all messages; sums of zero and below are left out."""
    c = corpus(messages, id_col, text_col)
    rows = c.postings.join(c.df, "term").crossJoin(F.broadcast(c.stats))  # one row of statistics
    w = weight(F.col("tf"), F.col("length"), F.col("df"), F.col("n_docs"), F.col("avg_length"), F.lit(k))
    sums = rows.groupBy("term").agg(F.round(F.sum(w), 6).alias("score")).where("score > 0")
    return sums.orderBy(F.desc("score"), "term").limit(n)


def dot_lines(labelled: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(line): a digraph's lines, its edges in order; a sort by ranges, so that no task holds all of them."""
    text = F.format_string('"%s" -> "%s" [label = "%s"];', F.col(src).cast("string"), F.col(dst).cast("string"), "label")
    body = labelled.select(F.lit(1).alias("part"), F.col(src).alias("src"), F.col(dst).alias("dst"), text.alias("line"))
    ends = labelled.sparkSession.createDataFrame([(0, "digraph G {"), (2, "}")], "part int, line string")
    return body.unionByName(ends, allowMissingColumns=True).orderBy("part", "src", "dst").select("line")
