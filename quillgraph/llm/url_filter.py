"""URL filtering: fixed rules first, gradient-boosted trees on lexical features for the rest, all in DataFrame expressions.

Training: labelled URLs are collapsed, one row a URL (label 1 if any row says block), and at most about ``SAMPLE`` of them are used,
those of the smallest hashes. Features are cut at quantiles. Each level of each tree is one grouped aggregation of gradients over
(node, feature, bin), in integers so that the order of additions does not matter; the driver sees those sums only and picks the
splits. The sample is bounded, so it is kept as one partition and the sums need no shuffle. Trees become nested conditionals.
Suffix statistics are the smoothed log-odds of the host's last label, of its last two, and of the path's extension, for suffixes of
``FEWEST`` training URLs or more; they are joined as a broadcast of at most ``3 * SAMPLE / FEWEST`` rows. Training
URLs are in ``FOLDS`` folds by hash, and one's odds are those of the other folds, so that trees see no label of a URL's own.

Defined cases: a null URL or one without ``://`` has empty host and path, no rule, and is scored on what there is; without labelled
URLs of both classes the score is the share of blocked ones (0 without any); of rules of one length that fit, block wins;
null ids are kept; URLs of any length are read whole, the entropy's time is in proportion to length and distinct characters;
repeated rows give repeated results; an empty table gives an empty result; further columns are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import cut, only

SAMPLE, FEWEST, BINS, FOLDS = 20_000, 5, 16, 5
TREES, DEPTH, RATE, RIDGE, LEAST_GAIN = 12, 3, 0.3, 1.0, 1e-3
SCALE = float(1 << 20)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUFFIXES = ("last", "last_two", "extension")
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "hyphens", "entropy", "parameters", "query_length", *(f"odds_{s}" for s in SUFFIXES))

#: The rules of the query: verdict, then host and path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    there = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.when(there, host).otherwise(""), F.when(there, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, r in sorted(rules, key=lambda x: (len(x[1]), x[0] == "block")):
        h, _, p = r.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _entropy(s: Column) -> Column:
    n = F.length(s)
    each = F.transform(F.array_distinct(F.split(s, "")), lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(F.filter(each, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def lexical(df: DataFrame) -> DataFrame:
    """``df`` with url, host and path, and the features but for the suffixes' statistics."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = F.regexp_count(url, F.lit("[0-9]"))
    labels = F.split("host", r"\.")
    return df.withColumns(
        {
            "length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"),
            "depth": F.regexp_count("path", F.lit("/+[^/]")), "labels": F.size(labels), "digits": digits / n,
            "host_digits": F.regexp_count("host", F.lit("[0-9]")), "hyphens": F.regexp_count("host", F.lit("-")), "entropy": _entropy(url),
            "parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")), "query_length": F.length(query),
            "last": F.element_at(labels, -1), "last_two": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."), "extension": F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})/?$", 1),
        }
    )


class Model:
    """Trees over FEATURES: a leaf is a number, a node (feature, edge, at most, above)."""

    def __init__(self, base: float, trees: list, odds: DataFrame | None) -> None:
        self.base, self.trees, self.odds = base, trees, odds

    def with_features(self, df: DataFrame, fold: Column | None = None) -> DataFrame:
        """``df`` with all features; for training rows, with the odds that the other folds show."""
        df = lexical(df)
        for s in SUFFIXES:
            if self.odds is None:
                df = df.withColumn(f"odds_{s}", F.lit(0.0))
                continue
            mine = self.odds.where(F.col("kind") == s).select(F.col("suffix").alias(s), F.col("odds").alias("_odds"), F.col("others").alias("_others"))
            own = F.col("_odds") if fold is None else F.get("_others", fold)
            df = df.join(F.broadcast(mine), s, "left").withColumn(f"odds_{s}", F.coalesce(own, F.lit(0.0))).drop("_odds", "_others")
        return df

    def margin(self) -> Column:
        def grow(t) -> Column:
            return F.lit(float(t)) if not isinstance(t, tuple) else F.when(F.col(t[0]) <= t[1], grow(t[2])).otherwise(grow(t[3]))

        total = F.lit(self.base)
        for t in self.trees:
            total = total + grow(t)
        return total

    def score(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))


def _leaf(g: float, h: float) -> float:
    return round(-RATE * g / (h + RIDGE), 6)


def _split(sums: dict, edges: dict) -> tuple | None:
    """The best (gain, feature, bin) of a node from its sums {(feature, bin): (g, h)}."""
    best = None
    for f in FEATURES:
        bins = {b: v for (name, b), v in sums.items() if name == f}
        g, h = (sum(v[i] for v in bins.values()) for i in (0, 1))
        gl = hl = 0.0
        for b in range(len(edges[f])):
            gl, hl = gl + bins.get(b, (0, 0))[0], hl + bins.get(b, (0, 0))[1]
            gain = gl * gl / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g * g / (h + RIDGE)
            if gain > LEAST_GAIN and (best is None or gain > best[0]):
                best = gain, f, b
    return best


def fit(labelled: DataFrame) -> Model:
    """``labelled`` has url and label (1: block)."""
    each = only(labelled, "url", "label").where("url is not null and label in (0, 1)").groupBy("url").agg(F.max("label").cast("int").alias("label"))
    n, blocked = each.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n or not 0 < blocked < n:
        return Model(700.0 if blocked else -700.0, [], None)
    top = 1 << 20
    rows = each.where(F.pmod(F.xxhash64("url"), F.lit(top)) < math.ceil(top * min(1.0, SAMPLE / n))).orderBy(F.xxhash64("url"), "url").limit(SAMPLE)
    host, path = host_and_path(F.col("url"))
    rows = cut(lexical(rows.withColumns({"host": host, "path": path})).coalesce(1))
    n, blocked = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < blocked < n:
        return Model(700.0 if blocked else -700.0, [], None)
    base = math.log(blocked / (n - blocked))
    fold = F.pmod(F.xxhash64(F.lit(3), "url"), F.lit(FOLDS)).cast("int")
    kinds = rows.select("label", fold.alias("fold"), F.explode(F.create_map(*(x for s in SUFFIXES for x in (F.lit(s), F.col(s))))).alias("kind", "suffix"))
    out = [F.count_if(F.col("fold") != i).alias(f"n{i}") for i in range(FOLDS)] + [F.sum(F.when(F.col("fold") != i, F.col("label")).otherwise(0)).alias(f"k{i}") for i in range(FOLDS)]
    sums = kinds.groupBy("kind", "suffix").agg(F.count("*").alias("n"), F.sum("label").alias("k"), *out).where(F.col("n") >= FEWEST)
    share = blocked / n

    def odds(seen: str, bad: str) -> Column:
        return F.round(F.log((F.col(bad) + 4 * share) / (F.col(seen) - F.col(bad) + 4 * (1 - share))) - base, 6)

    others = F.array(*(odds(f"n{i}", f"k{i}") for i in range(FOLDS)))
    model = Model(round(base, 6), [], cut(sums.select("kind", "suffix", odds("n", "k").alias("odds"), others.alias("others")).coalesce(1)))
    rows = model.with_features(rows, fold).select("label", *(F.col(f).cast("double").alias(f) for f in FEATURES))
    marks = rows.agg(*(F.percentile_approx(f, [i / BINS for i in range(1, BINS)], 10_000).alias(f) for f in FEATURES)).first()
    edges = {f: sorted(set(marks[f])) for f in FEATURES}
    bins = F.array(*(F.struct(F.lit(f).alias("f"), sum((F.when(F.col(f) > e, 1).otherwise(0) for e in edges[f]), F.lit(0)).alias("b")) for f in FEATURES))
    rows = cut(rows.withColumn("bins", bins).coalesce(1))
    for _ in range(TREES):
        p = model.score()
        state = rows.withColumn("p", p).withColumns({"g": F.round((F.col("p") - F.col("label")) * SCALE).cast("long"), "h": F.round(F.col("p") * (1 - F.col("p")) * SCALE).cast("long")})
        tree = _tree(state, edges)
        if not isinstance(tree, tuple):
            break
        model.trees.append(tree)
    return model


def _tree(state: DataFrame, edges: dict):
    """One tree, grown a level at a time."""
    paths, leaves, splits = {"": F.lit(True)}, {}, {}
    for depth in range(DEPTH + 1):
        if not paths:
            break
        node = F.coalesce(*(F.when(c, F.lit(k)) for k, c in paths.items()))
        sums: dict = {k: {} for k in paths}
        cells = state.withColumn("node", node).where("node is not null").select("node", "g", "h", F.explode("bins").alias("x"))
        for r in cells.groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            sums[r["node"]][r["f"], r["b"]] = (r["g"] / SCALE, r["h"] / SCALE)
        nxt = {}
        for k, c in paths.items():
            mine = {b: v for (f, b), v in sums[k].items() if f == FEATURES[0]}
            leaves[k] = _leaf(sum(v[0] for v in mine.values()), sum(v[1] for v in mine.values()))
            best = _split(sums[k], edges) if depth < DEPTH else None
            if best:
                _, f, b = best
                splits[k] = (f, edges[f][b])
                nxt[k + "l"] = c & (F.col(f) <= edges[f][b])
                nxt[k + "r"] = c & (F.col(f) > edges[f][b])
        paths = nxt

    def build(k: str):
        return (*splits[k], build(k + "l"), build(k + "r")) if k in splits else leaves[k]

    return build("")


def judge(pages: DataFrame, rules: tuple = RULES, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, host, path, rule, verdict and score of every row. Without ``labelled``, the URLs that rules judge are the training set."""
    df = only(pages, id_col, url_col).toDF("page_id", "url")
    host, path = host_and_path(F.col("url"))
    df = df.withColumns({"host": host, "path": path})
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    df = df.withColumns({"rule": rule, "says": says})
    if labelled is None:
        labelled = df.where("rule is not null").select("url", (F.col("says") == "block").cast("int").alias("label"))
    model = fit(labelled)
    out = model.with_features(df).withColumn("score", model.score())
    verdict = F.coalesce("says", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return out.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), "score")
