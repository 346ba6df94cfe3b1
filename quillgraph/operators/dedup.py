"""Duplicate pairs: equal checksums or words, and fingerprints that match in bands or bits.

Equal fingerprints are collapsed before anything is compared, so a large group of copies is one fingerprint. Matches within d
differing parts are found by cutting a fingerprint into d + 1 blocks, one of which must be equal, and joining on (block, digits);
candidates are then measured. Pairs of documents are written out last, from classes and matches of classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.components import components, join_hot
from quillgraph.operators.fingerprint import differing_digits, hamming
from quillgraph.storage import cut


def exact_classes(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """(id, class_id): the smallest id with the same key. One row a document however large a group is."""
    return _shared(df, key, id_col).select("id", "class_id")


def _shared(df: DataFrame, key: Column, id_col: str, check: Column | None = None) -> DataFrame:
    """(id, _key, _check, class_id) of the rows that do not have their key alone."""
    keyed = cut(df.select(F.col(id_col).alias("id"), key.alias("_key"), (F.lit(None) if check is None else check).cast("string").alias("_check"))).where("_key is not null")
    least = keyed.groupBy("_key").agg(F.min("id").alias("class_id"), F.count("*").alias("_n")).where("_n > 1")
    return keyed.join(least, "_key").select("id", "_key", "_check", "class_id")


def same_words(words: Column) -> Column:
    """A key that is equal where the words are: they hold no space, and the digest is short to shuffle."""
    return same_text(F.array_join(words, " "))


def same_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def class_pairs(classes: DataFrame) -> DataFrame:
    """All pairs (id_a < id_b) within classes, as the pair files list them."""
    classes = cut(classes)
    a, b = classes.select(F.col("id").alias("id_a"), "class_id"), classes.select(F.col("id").alias("id_b"), "class_id")
    return a.join(b, "class_id").where("id_a < id_b").select("id_a", "id_b")


def exact_pairs(df: DataFrame, key: Column, id_col: str, check: Column | None = None) -> DataFrame:
    """All pairs (id_a < id_b) of one key, and of one ``check`` if the key is a checksum that different texts may have in common."""
    return class_pairs(_shared(df, key, id_col, check).select("id", F.struct("_key", "_check").alias("class_id")))


def _blocks(digits: int, d: int, per_digit: int = 1) -> list[tuple[int, int]]:
    n = min(d + 1, digits // per_digit)
    edge = [round(i * digits / n) for i in range(n + 1)]
    return [(edge[i] + 1, edge[i + 1] - edge[i]) for i in range(n)]


def near_matches(prints: DataFrame, digits: int, distance: int, bands: bool = True) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints that differ in at most ``distance`` digits (bands) or bits.

    In bands at least one digit must be shared too. Up to digits - 1 differing digits, or as many bits as there are digits less
    one, a block is shared for certain; beyond that every pair is measured.
    """
    distinct = prints.select(F.col("print")).where("print <> ''").distinct()
    measure = differing_digits if bands else hamming
    far = F.least(F.lit(distance), F.lit(digits - 1)) if bands else F.lit(distance)
    a, b = distinct.select(F.col("print").alias("a")), distinct.select(F.col("print").alias("b"))
    if distance + 1 > digits and not bands:
        pairs = a.join(b, F.col("a") < F.col("b"))
        return pairs.where(measure(F.col("a"), F.col("b"), digits) <= far)
    blocks = _blocks(digits, min(distance, digits - 1))

    def cut(df: DataFrame, c: str) -> DataFrame:
        return df.select(c, F.posexplode(F.array(*(F.substring(c, at, n) for at, n in blocks))).alias("block", "part"))

    pairs = cut(a, "a").join(cut(b, "b"), ["block", "part"]).where("a < b")
    # A pair counts in its first shared block only, so that no distinct is needed.
    first = F.coalesce(*(F.when(F.substring("a", at, n) == F.substring("b", at, n), F.lit(i)) for i, (at, n) in enumerate(blocks)))
    return pairs.where((first == F.col("block")) & (measure(F.col("a"), F.col("b"), digits) <= far)).select("a", "b")


def near_pairs(prints: DataFrame, digits: int = 32, distance: int = 4, bands: bool = True) -> DataFrame:
    """(id_a, id_b) of documents (id, print) whose fingerprints match. Empty fingerprints match nothing in bands, all in bits."""
    prints = cut(prints.select("id", "print")).where("print is not null")
    same = prints.where("print <> ''")
    equal = class_pairs(same.select("id", F.col("print").alias("class_id")))
    matched = near_matches(prints, digits, distance, bands)
    a, b = same.select(F.col("id").alias("x"), F.col("print").alias("a")), same.select(F.col("id").alias("y"), F.col("print").alias("b"))
    crossed = matched.join(a, "a").join(b, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    out = equal.unionByName(crossed)
    if not bands:
        empty = prints.where("print = ''").select(F.col("id").alias("x"))
        every = prints.select(F.col("id").alias("y"), "print")
        loose = empty.join(every, (F.col("x") != F.col("y")) & ((F.col("print") != "") | (F.col("x") < F.col("y"))))
        out = out.unionByName(loose.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")))
    return out


def near_classes(prints: DataFrame, digits: int = 32, distance: int = 4, bands: bool = True) -> DataFrame:
    """(id, class_id, links) of documents with a match: the smallest id reachable over matches, and how many documents match.

    Classes come from matches of distinct fingerprints, so no pair of copies is ever listed. Empty fingerprints match nothing in
    bands; in bits they match every document, which are one class then.
    """
    prints = cut(prints.select("id", "print")).where("print is not null")
    total = prints.count()
    empty = 0 if bands else prints.where("print = ''").count()
    same = prints.where("print <> ''")
    distinct = cut(same.groupBy("print").agg(F.min("id").alias("own"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    matched = near_matches(distinct, digits, distance, bands)
    ends = [distinct.select(F.col("print").alias(c), F.col("node").alias(f"{c}_node"), F.col("n").alias(f"{c}_n")) for c in "ab"]
    pairs = cut(matched.join(ends[0], "a").join(ends[1], "b").select("a_node", "b_node", "a_n", "b_n"))
    others = pairs.select(F.col("a_node").alias("node"), F.col("b_n").alias("m")).unionByName(pairs.select(F.col("b_node").alias("node"), F.col("a_n").alias("m")))
    root = components(pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    each = distinct.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    each = cut(each.join(others.groupBy("node").agg(F.sum("m").alias("m")), "node", "left").select("print", "own", "n", "root", (F.col("n") - 1 + F.coalesce("m", F.lit(0)) + empty).alias("links")))
    least = each.groupBy("root").agg(F.min("own").alias("class_id"), F.count("*").alias("n"))
    named = join_hot(each.select("print", "root", "links", F.col("n").alias("docs")), least, ["root"], each.count()).where("links > 0")
    if empty:
        first = prints.agg(F.min("id")).first()[0]
        named = named.withColumn("class_id", F.lit(first))
    out = join_hot(same, cut(named.select("print", "class_id", "links", F.col("docs").alias("n"))), ["print"], total).select("id", "class_id", "links")
    if empty and total > 1:
        out = out.unionByName(prints.where("print = ''").select("id", F.lit(first).alias("class_id"), F.lit(total - 1).cast("long").alias("links")))
    return out


def pair_lines(pairs: DataFrame) -> DataFrame:
    """Lines of a pair file, smaller id first, in order."""
    return pairs.orderBy("id_a", "id_b").select(F.concat_ws("-", F.col("id_a").cast("string"), F.col("id_b").cast("string")).alias("line"))
