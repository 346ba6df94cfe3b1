"""Ranked retrieval: word overlap, tf.idf, pseudo-relevance feedback over parameter grids, and average precision.

A corpus is tokenised once and written; postings, statistics and document frequencies all come from what is written. Postings are
long: one row a document and term. Queries meet documents by an equi-join on the term only, so documents that share no term with any
query are never touched: by broadcast if the query terms are few, else by term, hot terms in parts. Runs of a grid are columns of
one aggregation, so that postings are joined once for all of them. Ranks use scores rounded to nine places and then the document, so
that engines agree.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import counter_text, tokens
from quillgraph.storage import cut

#: Up to so many distinct terms, ids or query rows (some 50 MB) are broadcast.
MOST_BROADCAST = 1_000_000
#: Postings of a term that meet their queries in one task; terms of more are dealt out in parts.
SPLIT = 1_000_000
#: Runs that are summed side by side.
WIDE = 48


@dataclass
class Corpus:
    """sized (doc_id, words, length; one row a document), stats (n_docs, total_length, avg_length; one row)."""

    sized: DataFrame
    stats: DataFrame

    @cached_property
    def words(self) -> DataFrame:
        """(doc_id, length, term), one row a token."""
        return self.sized.select("doc_id", "length", F.explode("words").alias("term"))

    @cached_property
    def postings(self) -> DataFrame:
        """(doc_id, term, length, tf)."""
        return self.words.groupBy("doc_id", "term", "length").agg(F.count("*").alias("tf"))

    @cached_property
    def df(self) -> DataFrame:
        """(term, df), counted from each document's distinct words: summed before anything is shuffled."""
        return self.df_of()

    def df_of(self, terms: DataFrame | None = None) -> DataFrame:
        each = self.sized.select(F.explode(F.array_distinct("words")).alias("term"))
        if terms is not None:
            each = each.join(_small(terms.select("term").distinct()), "term", "left_semi")
        return each.groupBy("term").agg(F.count("*").alias("df"))

    def about(self, terms: DataFrame) -> Corpus:
        """The corpus with the postings of some terms only, written out once; its statistics stay those of all documents.

        Other words are dropped where they are read, so that neither they nor their counts are ever shuffled.
        """
        part = Corpus(self.sized, self.stats)
        part.__dict__["words"] = self.words.join(_small(terms.select("term").distinct()), "term", "left_semi")
        part.__dict__["postings"] = cut(part.postings)
        part.__dict__["df"] = cut(part.postings.groupBy("term").agg(F.count("*").alias("df")))
        return part

    def only(self, ids: DataFrame) -> Corpus:
        """The documents with some ids; its statistics stay those of all documents."""
        return Corpus(self.sized.join(_small(ids.select("doc_id").distinct()), "doc_id", "left_semi"), self.stats)

    def meet(self, queries: DataFrame) -> DataFrame:
        """The postings of each query row (term, ...), with its term's df and the corpus' statistics."""
        asked = cut(queries.join(self.df, "term"))
        if asked.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
            rows = self.postings.join(F.broadcast(asked), "term")
        else:
            # There are at most (postings / SPLIT) hot terms.
            hot = F.broadcast(self.df.where(F.col("df") > SPLIT).withColumnRenamed("df", "_df"))
            parts = lambda c: F.ceil(F.col(c) / SPLIT).cast("int")
            dealt = self.postings.join(hot, "term", "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("doc_id"), parts("_df")), F.lit(0)).cast("int")).drop("_df")
            rows = dealt.join(asked.withColumn("_part", F.explode(F.sequence(F.lit(0), parts("df") - 1))), ["term", "_part"]).drop("_part")
        return rows.crossJoin(F.broadcast(self.stats))  # one row of statistics


def _small(df: DataFrame) -> DataFrame:
    """Written out, and marked for broadcast if it has few enough rows."""
    df = cut(df)
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf)."""
    words = docs.select(F.col(id_col).alias("doc_id"), F.explode(tokens(F.col(text_col))).alias("term"))
    return words.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", once: bool = False) -> Corpus:
    """The documents' words, written out unless they are needed ``once`` only."""
    # The length is known before words are exploded: no second aggregation by document.
    sized = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("words")).withColumn("length", F.size("words").cast("long"))
    sized = sized if once else cut(sized)
    stats = sized.agg(F.count("*").alias("n_docs"), F.sum("length").alias("total_length")).withColumn("avg_length", F.col("total_length") / F.col("n_docs"))
    return Corpus(sized, stats if once else cut(stats))


def overlap(queries: DataFrame, docs: Corpus) -> DataFrame:
    """Distinct query words that a document holds; queries are (query_id, term, tf)."""
    q = queries.select("query_id", "term").distinct()
    return docs.about(q).meet(q).groupBy("query_id", "doc_id").agg(F.count("*").alias("score"))


def weight(tf: Column, length: Column, df: Column, n: Column, average: Column, k: Column) -> Column:
    return tf / (tf + k * length / average) * F.log(n / df)


def _weight(k: Column) -> Column:
    return weight(F.col("tf"), F.col("length"), F.col("df"), F.col("n_docs"), F.col("avg_length"), k)


def tfidf(queries: DataFrame, docs: Corpus, k: float = 2.0) -> DataFrame:
    """Sums of query weight times tf.idf for each query and document."""
    queries = cut(queries)
    rows = docs.about(queries).meet(queries)
    return rows.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * _weight(F.lit(k))).alias("score"))


def tfidf_runs(queries: DataFrame, docs: Corpus, runs: list[tuple[int, float]]) -> DataFrame:
    """(run, query_id, doc_id, score): ``queries`` are (run, query_id, term, weight), and runs give the k of each.

    A document's postings meet a query's terms once for ``WIDE`` runs, whose scores are sums side by side.
    """
    queries = cut(queries)
    docs, out = docs.about(queries), None
    for at in range(0, len(runs), WIDE):
        part = runs[at : at + WIDE]
        mine = queries.where(F.col("run").isin([r for r, _ in part])) if len(runs) > WIDE else queries
        wide = mine.groupBy("query_id", "term").agg(*(F.max(F.when(F.col("run") == r, F.col("weight"))).alias(f"w{i}") for i, (r, _) in enumerate(part)))
        ks = sorted({k for _, k in part})
        rows = docs.meet(wide).withColumns({f"f{j}": _weight(F.lit(k)) for j, k in enumerate(ks)})
        sums = rows.groupBy("query_id", "doc_id").agg(*(F.sum(F.col(f"w{i}") * F.col(f"f{ks.index(k)}")).alias(f"s{i}") for i, (_, k) in enumerate(part)))
        each = F.array(*(F.struct(F.lit(r).alias("run"), F.col(f"s{i}").alias("score")) for i, (r, _) in enumerate(part)))
        scores = sums.select("query_id", "doc_id", F.inline(F.filter(each, lambda x: x["score"].isNotNull()))).select("run", "query_id", "doc_id", "score")
        out = scores if out is None else out.unionByName(scores)
    return out


def top(scores: DataFrame, n: int | Column, by: tuple[str, ...] = (), item: str = "doc_id") -> DataFrame:
    """The n best items of each query, with their rank."""
    w = Window.partitionBy(*by, "query_id").orderBy(F.desc(F.round("score", 9)), item)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def expansion_terms(queries: DataFrame, docs: Corpus, grid: DataFrame) -> DataFrame:
    """(run, k, query_id, term, weight): the n_w best words of the query and its n_d best documents, taken as one text.

    ``grid`` has run, k, n_d and n_w. Words that the corpus lacks are dropped.
    """
    # Documents are ranked once for each k, words once for each k and n_d; then every run keeps its own number. A grid is small.
    points = grid.collect()
    ks = list(enumerate(sorted({p["k"] for p in points})))
    which = {k: i for i, k in ks}
    sets = sorted({(p["k"], p["n_d"]) for p in points})
    most = {x: max(p["n_w"] for p in points if (p["k"], p["n_d"]) == x) for x in sets}
    spark = grid.sparkSession
    texts = F.broadcast(spark.createDataFrame([(i, which[k], k, n_d, most[k, n_d]) for i, (k, n_d) in enumerate(sets)], "run int, which int, k double, n_d int, n_w int"))
    queries = cut(queries)
    asked = queries.withColumnRenamed("tf", "weight").crossJoin(F.broadcast(spark.createDataFrame([(i,) for i, _ in ks], "run int")))
    first = tfidf_runs(asked, docs, ks)
    best = top(first, max(p["n_d"] for p in points), ("run",)).select(F.col("run").alias("which"), "query_id", "doc_id", "rank")
    kept = ("run", "k", "n_d", "n_w", "query_id")
    picked = cut(best.join(texts, "which").where("rank <= n_d").select(*kept, "doc_id"))
    theirs = picked.join(docs.only(picked).postings, "doc_id").select(*kept, "term", "tf")
    own = picked.select(*kept).distinct().join(queries, "query_id").select(*kept, "term", "tf")
    mega = own.unionByName(theirs).groupBy(*kept, "term").agg(F.sum("tf").alias("tf"))
    mega = cut(mega.withColumn("length", F.sum("tf").over(Window.partitionBy("run", "query_id"))))
    scored = mega.join(docs.df_of(mega), "term").crossJoin(F.broadcast(docs.stats))
    ranked = top(scored.withColumn("score", _weight(F.col("k"))), F.col("n_w"), ("run",), "term").select("k", "n_d", "query_id", "term", "score", "rank")
    runs = F.broadcast(grid.select("run", "k", "n_d", "n_w"))
    return ranked.join(runs, ["k", "n_d"]).where("rank <= n_w").select("run", "k", "query_id", "term", F.col("score").alias("weight"))


def feedback(queries: DataFrame, docs: Corpus, grid: DataFrame) -> DataFrame:
    """(run, query_id, doc_id, score) of pseudo-relevance feedback."""
    runs = [(r["run"], r["k"]) for r in grid.orderBy("run").collect()]
    return tfidf_runs(expansion_terms(queries, docs, grid), docs, runs)


def single(spark, k: float = 0.75, n_d: int = 19, n_w: int = 38) -> DataFrame:
    """A grid of one run; a value of 0 means the default."""
    return spark.createDataFrame([(0, float(k or 0.75), int(n_d or 19), int(n_w or 38))], "run int, k double, n_d int, n_w int")


def grid(spark, ks=None, n_ds=None, n_ws=None) -> DataFrame:
    """Parameter grid; by default k of 0.1 to 3, n_d of 15 to 30 and n_w of 2 n_d - 10 up to 2 n_d + 9."""
    ks = [round(0.1 * i, 1) for i in range(1, 31)] if ks is None else ks
    n_ds = range(15, 31) if n_ds is None else n_ds
    points = [(float(k), n_d, n_w) for k in ks for n_d in n_ds for n_w in (range(2 * n_d - 10, 2 * n_d + 10) if n_ws is None else n_ws(n_d))]
    return spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "run int, k double, n_d int, n_w int")


def average_precision(scores: DataFrame, relevant: DataFrame, most: int = 1000, by: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, ap) over the first ``most`` documents; ``relevant`` is (doc_id) for all queries or (query_id, doc_id)."""
    on = [c for c in ("query_id", "doc_id") if c in relevant.columns]
    ranked = top(scores, most, by).join(relevant.select(*on).distinct().withColumn("rel", F.lit(1)), on, "left")
    w = Window.partitionBy(*by, "query_id").orderBy("rank")
    found = ranked.withColumn("hits", F.sum(F.coalesce("rel", F.lit(0))).over(w))
    sums = found.groupBy(*by, "query_id").agg(F.sum(F.when(F.col("rel") == 1, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("total"))
    if on == ["doc_id"]:
        sums = sums.crossJoin(F.broadcast(relevant.agg(F.count_distinct("doc_id").alias("n_rel"))))  # one row
    else:
        sums = sums.join(relevant.groupBy("query_id").agg(F.count_distinct("doc_id").alias("n_rel")), "query_id")
    return sums.select(*by, "query_id", (F.col("total") / F.col("n_rel")).alias("ap"))


def run_lines(scores: DataFrame) -> DataFrame:
    """Lines of a run file."""
    text = F.col("score").cast("string") if dict(scores.dtypes)["score"] in ("bigint", "int") else counter_text(F.col("score"))
    return scores.select(F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("0"), F.col("doc_id").cast("string"), F.lit("0"), text, F.lit("0")).alias("line"))
