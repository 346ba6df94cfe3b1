"""Secret scanning by fixed patterns and by sliding-window entropy, as one projection without a shuffle.

Entropy spans: a candidate is a maximal run of at least ``WINDOW`` characters of the base-64 and URL-safe alphabet; one of
hexadecimal digits only belongs to that class, any other to the larger one. A window of that length slides over it. The sum of c*log2(c) over the window's character
counts is kept up to date by the one count that falls and the one that rises, in integers of 2**-20 bits, so that every engine
gets the same sum. A candidate becomes a span if its highest window entropy reaches the threshold of its class, unless the
allow-list suppresses it or a pattern's span covers it.

Values that a step needs more than once are bound first, and arrays grow by chunks, so that candidates of any length and texts with any
number of matches take time in proportion.

Defined cases: null and empty texts have no spans; null ids are kept; overlapping entropy spans do not arise; repeated rows give repeated results; further columns are dropped; offsets
count code points, ends are exclusive; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import only

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A maximal run is what the greedy pattern finds, so the length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "hexrun", "b64run")

WINDOW, CHUNK, BLOCK = 20, 256, 1024
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SCALE = 1 << 20
RUN = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
HEX_RUN = "^[0-9A-Fa-f]+$"
#: Character class: least entropy in bits of some window of 20 characters.
CLASSES = {"hexrun": 2.9, "b64run": 3.6}
#: Candidates that are no secrets: those without a digit or without a letter, UUIDs, rulers, and documented sample keys.
ALLOW = r"^[^0-9]*$|^[^A-Za-z]*$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|(?i)example|sample|placeholder|changeme|x{6}|0{8}|(.)\1{7}"

#: c*log2(c) - (c-1)*log2(c-1), what the c-th occurrence of a character adds.
STEP = [round(c * math.log2(c) * SCALE) - (round((c - 1) * math.log2(c - 1) * SCALE) if c > 1 else 0) for c in range(1, WINDOW + 1)]


def most_allowed(threshold: float) -> int:
    """The largest sum of c*log2(c) at which a window's entropy still reaches the threshold."""
    return math.floor(WINDOW * (math.log2(WINDOW) - threshold) * SCALE)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the value, which is evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _fold(items: Column, kind: str, add: Callable[[Column, Column], Column]) -> Column:
    """Joins what ``add(at, item)``, a struct of the next ``at`` and an array ``out``, gives for one item after the other.

    Items are folded ``CHUNK`` at a time, so that joining arrays stays linear in the number of items.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")

    def join(state: Column, more: Column) -> Column:
        return F.struct(more["at"].alias("at"), F.concat(state["out"], more["out"]).alias("out"))

    def chunk(state: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(state["at"].alias("at"), none.alias("out")), lambda t, x: _bound(add(t["at"], x), lambda r: join(t, r)))
        return _bound(inner, lambda r: join(state, r))

    def whole(all_items: Column) -> Column:
        last = F.floor((F.greatest(F.size(all_items), F.lit(1)) - 1) / CHUNK).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(all_items, k * CHUNK + 1, F.lit(CHUNK)))
        return F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), chunk)

    return _bound(items, whole)


def _matches(text: Column, pattern: str, rank: int, group: int = 0, least: int = 0) -> Column:
    """Spans of a pattern's matches: (start, rank, stop, found). Offsets come from the lengths of what lies between matches."""
    kind = "struct<start:bigint,rank:int,stop:bigint,found:string>"
    parts = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))

    def items(p: Column) -> Column:
        return F.transform(p["whole"], lambda x, i: F.struct(F.length(F.get(p["between"], i)).cast("long").alias("gap"), F.length(x).cast("long").alias("size"), x.alias("found"), (F.length(F.get(p["part"], i)) >= least).alias("fits")))

    def add(at: Column, m: Column) -> Column:
        start = at + m["gap"]
        stop = start + m["size"]
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), m["found"].alias("found")))
        return F.struct(stop.alias("at"), F.when(m["fits"], span).otherwise(F.expr(f"cast(array() as array<{kind}>)")).alias("out"))

    found = _fold(_bound(parts, items), kind, add)["out"]
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.expr(f"cast(array() as array<{kind}>)"))


def least_sum(found: Column) -> Column:
    """The smallest sum of c*log2(c) over the windows of a candidate, from counts that are kept up to date."""
    step = F.array(*(F.lit(x).cast("long") for x in STEP))
    places = F.transform(F.filter(F.split(found, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))

    def changed(counts: Column, at: Column, by: int) -> Column:
        return F.concat(F.slice(counts, F.lit(1), at - 1), F.array(F.get(counts, at - 1) + by), F.slice(counts, at + 1, F.lit(len(ALPHABET))))

    def slide(chars: Column) -> Callable[[Column, Column], Column]:
        def one(state: Column, i: Column) -> Column:
            old, new = F.get(chars, i - WINDOW), F.get(chars, i)
            full = i >= WINDOW
            left = F.struct(
                F.when(full, changed(state["counts"], old, -1)).otherwise(state["counts"]).alias("counts"),
                F.when(full, state["total"] - F.get(step, F.get(state["counts"], old - 1) - 1)).otherwise(state["total"]).alias("total"),
            )

            def enter(s: Column) -> Column:
                total = s["total"] + F.get(step, F.get(s["counts"], new - 1))
                return F.struct(changed(s["counts"], new, 1).alias("counts"), total.alias("total"), F.when(i >= WINDOW - 1, F.least(state["least"], total)).otherwise(state["least"]).alias("least"))

            return _bound(left, enter)

        return one

    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0).cast("long").alias("total"), F.lit(1 << 60).cast("long").alias("least"))
    return _bound(places, lambda chars: F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), zero, slide(chars))["least"])


def _entropy_spans(text: Column) -> Column:
    """Spans of the entropy method; a run of hexadecimal digits only is judged as such."""
    candidates = F.filter(_matches(text, RUN, KINDS.index("b64run")), lambda s: ~F.regexp_like(s["found"], F.lit(ALLOW)))

    def judge(s: Column) -> Column:
        hexed = F.regexp_like(s["found"], F.lit(HEX_RUN))
        most = F.when(hexed, most_allowed(CLASSES["hexrun"])).otherwise(most_allowed(CLASSES["b64run"]))
        kind = F.when(least_sum(s["found"]) <= most, F.when(hexed, KINDS.index("hexrun")).otherwise(KINDS.index("b64run")))
        return F.struct(s["start"].alias("start"), kind.alias("rank"), s["stop"].alias("stop"), s["found"].alias("found"))

    return F.filter(F.transform(candidates, judge), lambda s: s["rank"].isNotNull())


def _write(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["stop"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the text, and ``base`` and ``added``: arrays of (start, rank, stop, found), ``rank`` an index into ``KINDS``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = only(docs, id_col, text_col).toDF("doc_id", "text")
    d = d.withColumns({"assign": _matches(text, ASSIGN, 0, 2, 8), "access": _matches(text, ACCESS, 1), "hex": _matches(text, HEX, 2)})
    d = d.withColumn("base", F.concat("assign", "access", "hex"))
    uncovered = F.filter(F.col("runs"), lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] <= s["start"]) & (b["stop"] >= s["stop"])))
    return d.withColumn("runs", _entropy_spans(text)).withColumn("added", uncovered).drop("runs")


def report(docs: DataFrame) -> DataFrame:
    """One row per document with counts, the digest of the patterns' spans and all spans as text."""
    d = scan(docs)
    return d.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_write(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _write(F.concat("base", "added")).alias("spans"),
    )


def _between(blocks: Column, start: Column, stop: Column) -> Column:
    """What stands from start to stop in a text cut into blocks of ``BLOCK`` code points, so that no position is counted from its start."""
    i, j = (F.floor(x / BLOCK).cast("int") for x in (start, stop))
    first, last = (F.coalesce(F.get(blocks, k), F.lit("")) for k in (i, j))
    at, end = (F.pmod(x, F.lit(BLOCK)).cast("int") for x in (start, stop))
    far = F.concat(F.substring(first, at + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, i + 2, j - i - 1), ""), F.substring(last, F.lit(1), end))
    return F.when(i == j, F.substring(first, at + 1, (stop - start).cast("int"))).otherwise(far)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark``; overlapping spans are replaced as one."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = F.concat(_matches(text, ASSIGN, 0, 2, 8), _matches(text, ACCESS, 1), _matches(text, HEX, 2), _entropy_spans(text))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    d = docs.select(row, F.array_sort(F.transform(base, lambda s: F.struct(s["start"], s["stop"]))).alias("_spans"))
    text = F.col(f"_row.`{text_col}`")

    def masked_of(blocks: Column) -> Column:
        def cover(at: Column, s: Column) -> Column:
            piece = F.when(s["start"] < at, F.expr("cast(array() as array<string>)")).otherwise(F.array(_between(blocks, at, s["start"]), F.lit(mark)))
            return F.struct(F.greatest(s["stop"], at).alias("at"), piece.alias("out"))

        return _bound(_fold(F.col("_spans"), "string", cover), lambda done: F.concat(F.array_join(done["out"], ""), _between(blocks, done["at"], F.length(text).cast("long"))))

    whole = _bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), masked_of)
    masked = F.when(F.size("_spans") > 0, whole).otherwise(text)
    return d.select(*((masked if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))
