"""Document quality by hierarchical empirical Bayes over classifier evidence, in DataFrame expressions.

Classifier: shares of marks other than a sentence's, capitals, repeated lines and repeated words, length, and the mean weight of the
text's distinct words, cut at quantiles of the training rows; its evidence is the smoothed log-likelihood ratio of the bins, scaled
by the factor that fits the training labels best. Words are hashed into ``BUCKETS``; a bucket's weight is the smoothed log-likelihood
ratio of its documents, counted over at most ``LEXICAL`` labelled rows, those of the smallest id hashes. They are in two halves, and a
training row's words are weighed by the other half, so that bins and scale are fitted to what new documents show. Sites: every
document adds to its path and host, a training row its label, any other document its classifier probability. The global Beta prior
comes from the hosts' rates by moments; a host's posterior mean is the prior of its paths, with the strength the paths' rates show,
so that sparse sites shrink to their host and sparse hosts to the whole. A document's score joins its evidence with the posterior
of its path, its own share taken out.

All statistics are grouped sums over all documents. Sites join back by salted keys, so a hot host is spread over ``SALTS`` tasks.

Defined cases: null and empty texts have the bins of zero length; a null host or path is a site of its own; without training rows
of both classes the evidence is 0 and the score is the share of good rows (0.5 without any); an id labelled twice counts as good if
one label says so; repeated rows are scored each and each adds to its site; an empty table gives an empty result; null ids are not
trained on; texts of any length are weighed whole; of equally good scales the smallest counts; further columns are dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import WORD, crc_mod, cut, only

BINS, SMOOTH, SALTS = 12, 1.0, 16
BUCKETS, LEXICAL = 1 << 15, 20_000
FEATURES = ("marks", "capitals", "lines", "repeats", "words", "lexical")
SCALES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0)
STRONGEST, WEAKEST = 200.0, 2.0


def measures(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.split(t, "\n")
    return {
        "marks": F.regexp_count(t, F.lit(r"""[^\p{L}\p{N}\s.,;:!?'"()-]""")) / n,
        "capitals": F.regexp_count(t, F.lit(r"\p{Lu}")) / n,
        "lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "repeats": F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)),
        "words": F.log1p(F.size(words)),
    }


def buckets(text: Column) -> Column:
    """The buckets of the text's distinct words, lower-cased."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)))
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def _half(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(5), doc_id), F.lit(2)).cast("int")


def weights(counts: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Weights of the buckets by each half and by both, from (half, label, bucket, documents), where bucket -1 counts all documents."""
    seen, total = np.zeros((2, 2, BUCKETS)), np.zeros((2, 2))
    for half, label, bucket, n in counts:
        if bucket < 0:
            total[half, label] += n
        else:
            seen[half, label, bucket] += n
    out = []
    for halves in ([0], [1], [0, 1]):
        k, n = seen[halves].sum(0), total[halves].sum(0)
        share = (k + SMOOTH) / (n[:, None] + 2 * SMOOTH)
        out.append(np.log(share[1]) - np.log(share[0]))
    return np.round(np.stack(out), 9)


def lexical(docs: DataFrame, y: DataFrame, doc_id: Column, text: Column) -> Column:
    """The mean weight of a text's words: by the first half of the training rows, by the second, and by both. ``y`` has doc_id and y."""
    few = F.broadcast(y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LEXICAL))
    own = docs.select(doc_id.alias("doc_id"), text.alias("text")).join(few, "doc_id")
    each = own.select(_half(F.col("doc_id")).alias("half"), "y", F.explode(F.concat(F.array(F.lit(-1)), buckets(F.col("text")))).alias("bucket"))
    held = docs.sparkSession.sparkContext.broadcast(weights([tuple(r) for r in each.groupBy("half", "y", "bucket").count().collect()]))

    @F.pandas_udf("array<double>")
    def mean(parts: pd.Series) -> pd.Series:
        w = held.value
        return pd.Series([w[:, np.asarray(x, np.int64)].mean(1).round(9) if len(x) else np.zeros(3) for x in parts], dtype=object)

    return mean(buckets(text))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _beta(mean: float, variance: float, size: float) -> float:
    """Strength of a Beta prior whose draws, seen through samples of about ``size``, vary this much."""
    within = mean * (1 - mean)
    between = variance - within / max(size, 1.0)
    if within <= 0:
        return STRONGEST
    return min(STRONGEST, max(WEAKEST, within / between - 1 if between > 0 else STRONGEST))


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, host, path, held_out, evidence, prior, score and keep (score of 0.5 or more). ``labels`` has the ids to learn from."""
    y = only(labels, id_col, label_col).toDF("doc_id", "y").where("doc_id is not null and y in (0, 1)")
    y = y.groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    its_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    d = docs.select(its_id.alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), *(c.alias(k) for k, c in measures(text).items()), lexical(docs, y, its_id, text).alias("lexical"))
    other = F.when(F.col("y").isNull(), 2).otherwise(1 - _half(F.col("doc_id")))
    d = cut(d.join(y, "doc_id", "left").withColumn("lexical", F.get("lexical", other)))
    known = d.where("y is not null")
    n, good = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    share = good / n if n else 0.5
    evidence = F.lit(0.0)
    if n and 0 < good < n:
        marks = known.agg(*(F.percentile_approx(f, [i / BINS for i in range(1, BINS)], 1000).alias(f) for f in FEATURES)).first()
        edges = {f: sorted(set(marks[f])) for f in FEATURES}
        bins = {f: sum((F.when(F.col(f) > e, 1).otherwise(0) for e in edges[f]), F.lit(0)) for f in FEATURES}
        cells = known.select("y", F.explode(F.array(*(F.struct(F.lit(f).alias("f"), b.alias("b")) for f, b in bins.items()))).alias("x"))
        seen = {(r["f"], r["b"]): (r["k"], r["n"]) for r in cells.groupBy("x.f", "x.b").agg(F.sum("y").alias("k"), F.count("*").alias("n")).collect()}
        for f in FEATURES:
            ratio = []
            for b in range(len(edges[f]) + 1):
                k, m = seen.get((f, b), (0, 0))
                ratio.append(round(math.log((k + SMOOTH) / (good + SMOOTH * BINS)) - math.log((m - k + SMOOTH) / (n - good + SMOOTH * BINS)), 9))
            evidence = evidence + F.get(F.array(*map(F.lit, ratio)), bins[f])
        base = math.log(good / (n - good))
        z = [s * evidence + base for s in SCALES]
        loss = known.agg(*(F.sum(F.round(F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0)) - F.col("y") * x, 6).cast("decimal(30,6)")).alias(str(i)) for i, x in enumerate(z))).first()
        evidence = evidence * min(zip(loss, SCALES, strict=True))[1]
    d = d.withColumn("evidence", evidence)
    base = math.log(share / (1 - share)) if 0 < share < 1 else 0.0
    own = F.coalesce(F.col("y").cast("double"), 1 / (1 + F.exp(-(F.col("evidence") + base))) if 0 < share < 1 else F.lit(share))
    # Integers, so that the order of additions cannot change a sum.
    d = d.withColumn("own", F.round(own * (1 << 30)).cast("long"))
    paths = d.groupBy("host", "path").agg(F.count("*").alias("n"), (F.sum("own") / (1 << 30)).alias("k"))
    paths = cut(paths)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum(F.round(F.col("k") * 1e6).cast("long")).alias("host_k")).withColumn("host_k", F.col("host_k") / 1e6)

    def moments(df: DataFrame, k: str, m: str) -> tuple[float, float]:
        r = df.agg(F.sum(k), F.sum(m), F.avg(m), F.var_pop(F.col(k) / F.col(m))).first()
        mean = (r[0] or 0.0) / r[1] if r[1] else share
        return mean, _beta(mean, r[3] or 0.0, r[2] or 1.0)

    mean, strength = moments(hosts, "host_k", "host_n")
    _, path_strength = moments(paths, "k", "n")
    host_mean = (F.col("host_k") + strength * mean) / (F.col("host_n") + strength)
    hosts = hosts.select(F.col("host").alias("its_host"), host_mean.alias("host_mean"))
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("its_host"))).select("host", "path", "n", "k", "host_mean")
    sites = sites.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    d = d.withColumn("salt", F.pmod(F.xxhash64("doc_id", "evidence"), F.lit(SALTS)).cast("int"))
    s = d.alias("d").join(sites.alias("s"), F.expr("d.salt = s.salt and d.host <=> s.host and d.path <=> s.path"))
    mine = F.col("d.own") / (1 << 30)
    prior = (F.col("s.k") - mine + path_strength * F.col("s.host_mean")) / (F.col("s.n") - 1 + path_strength)
    out = s.select("d.doc_id", "d.host", "d.path", "d.evidence", F.round(prior, 9).alias("prior"))
    p = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("prior")))))
    out = out.withColumn("score", F.round(p, 6)).withColumn("keep", (F.col("score") >= 0.5).cast("int"))
    return out.select("doc_id", "host", "path", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "evidence", "prior", "score", "keep")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Sources stand for hosts and a source's languages for its paths; ids whose crc32 is divisible by 5 are held out."""
    return score(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0), F.col("source"), F.concat_ws("/", "source", "lang"))
