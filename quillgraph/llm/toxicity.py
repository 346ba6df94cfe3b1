"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. Both begin with what the trainer takes from ordinary
text as a whole. Then come, in either, what it takes from the class's own spans: those parts of words that tell the class from the
other (segments of 6 to 8 characters, found one after the other by likelihood ratio; a segment's words are taken out of the counts
before the next is looked for). Every such span stands in up to ``EACH`` samples, parted by bytes that no text holds twice, so that
the trainer weighs spans alike and finds nothing across them. How many there are is not limited.

A text is cut into windows of ``WORDS`` words. A window's gain is its compressed length with the ordinary dictionary less that with
the toxic one; both end with the block that every window starts with, so that none falls under zstandard's least saving. The
document's evidence is the sum of gains that reach a least gain, over the square root of the number of windows. Least gain and
threshold are calibrated on documents that the dictionaries have not seen, and the score is a logistic curve through 0.5 at the
threshold. Dictionaries are loaded for their content: in windows of six words entropy tables cost more than they tell.

Training reads at most ``TOXIC`` and ``ORDINARY`` labelled documents of at most ``LONGEST`` characters and of each class at most
``CHARACTERS`` in all, those of the smallest id hashes, one of each text. Every document is scored over its whole text.

Defined cases: null and empty texts have no evidence and get the score of none; without labels of both classes every score is 0;
labels other than 0 and 1 are not used; an id labelled twice counts as toxic if one label says so; of equally good thresholds the
one in the widest gap counts, documents of equal evidence get equal scores; very long texts are windows like any other, and windows
of more than ``CAP`` bytes are cut; repeated rows give repeated results; an empty table gives an empty result; null ids are scored;
further columns are dropped by ``score`` and kept by ``clean``.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import crc_mod, cut, only

TOXIC, ORDINARY, LONGEST, CHARACTERS = 3000, 6000, 20_000, 16_000_000
WORDS, LENGTHS, CAP = 6, (6, 7, 8), 2048
#: A segment is over-represented if it is this many times as frequent as in the other class, and stands in so many documents.
TIMES, FEWEST = 20, 4
#: Bytes of the dictionaries: of what both begin with, for each segment of a class, and at least; samples of a span, samples in all; the
#: trainer's segments and units; bytes of a span with its filler.
BASE, PER_SPAN, LEAST_SIZE, EACH, SAMPLES, UNIT, BLOCK = 512, 128, 512, 8, 8, (32, 8), 16
#: What an ordinary document taken for toxic costs, in toxic ones missed.
FALSE = 4
#: Least log-likelihood ratio of a segment's split between the classes, above what the best of millions of segments reach by chance.
STRENGTH = 20.0
SHARED = bytes(range(1, 9)) + bytes(range(14, 30))
NOT_WORD = re.compile(r"[\W_]+")


def marked_words(text: str | None) -> list[str]:
    """The words, their first six letters in capitals: what stands inside of words then looks unlike what starts them."""
    return [w[:6].upper() + w[6:] for w in NOT_WORD.sub(" ", text.lower()).split()] if text else []


def windows(text: str | None) -> list[bytes]:
    w = marked_words(text)
    out = []
    for i in range(0, len(w), WORDS):
        b = f" {' '.join(w[i : i + WORDS])} ".encode("utf-8", "surrogatepass")
        out.extend(b[j : j + CAP] for j in range(0, len(b), CAP))
    return out


def _document_counts(texts: list[str]) -> Counter:
    c: Counter = Counter()
    for t in texts:
        c.update(set(marked_words(t)))
    return c


def _parts(word: str) -> set[str]:
    w = f" {word[:64]} "
    return {w[i : i + k] for k in LENGTHS for i in range(len(w) - k + 1)}


def _apart(texts: list[str]) -> list[str]:
    """The texts without those that share one of two least shingle hashes with an earlier one, which near copies mostly do."""
    seen: set = set()
    out = []
    for t in texts:
        w = marked_words(t)
        h = np.array([zlib.crc32(" ".join(w[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(w) - 4))], np.uint64)
        sketch = {(0, int(h.min())), (1, int((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(16)).min()))}
        if not seen & sketch:
            out.append(t)
        seen |= sketch
    return out


def contrast(own: Counter, other: Counter, n_own: int, n_other: int) -> list[str]:
    """Segments over-represented in ``own``, the strongest first, each counted without the words that earlier ones explain."""
    rate = n_own / n_other
    mine: Counter = Counter()
    for w, n in own.items():
        for g in _parts(w):
            mine[g] += n
    mine = Counter({g: n for g, n in mine.items() if n >= FEWEST})
    theirs: Counter = Counter()
    for w, n in other.items():
        for g in _parts(w):
            if g in mine:
                theirs[g] += n
    good = {g for g, n in mine.items() if n >= TIMES * rate * (theirs[g] + 0.5)}
    holders = defaultdict(list)
    for w in own:
        for g in _parts(w) & good:
            holders[g].append(w)

    def strength(n: float, m: float) -> float:
        p, q = rate / (1 + rate), n / (n + m)
        return (n + m) * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0))

    heap = [(-strength(mine[g], theirs[g]), -len(g), g) for g in good]
    heapq.heapify(heap)
    picked, gone = [], set()
    while heap:
        old, size, g = heapq.heappop(heap)
        n = sum(own[w] for w in holders[g] if w not in gone)
        if n < FEWEST or n < TIMES * rate * (theirs[g] + 0.5) or strength(n, theirs[g]) < STRENGTH:
            continue
        now = -strength(n, theirs[g])
        if heap and (now, size, g) > heap[0] and now > old:
            heapq.heappush(heap, (now, size, g))
            continue
        picked.append(g)
        gone.update(holders[g])
    return picked


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(window_log=17, chain_log=16, hash_log=16, search_log=4, min_match=6, target_length=64, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


def spans(texts: list[str], segments: list[str]) -> list[bytes]:
    """Training samples of what in the words of a class is covered by its segments."""
    held, seen, pieces = set(segments), Counter(), []
    for w in (w for t in texts for w in marked_words(t)):
        s = f" {w[:64]} "
        at = [(i, i + k) for k in LENGTHS for i in range(len(s) - k + 1) if s[i : i + k] in held]
        if at:
            span = s[min(i for i, _ in at) : max(j for _, j in at)].encode("utf-8", "surrogatepass")
            seen[span] += 1
            if seen[span] <= EACH:
                pieces.append(span + _filler(span, BLOCK - len(span)) + _filler(b"%d" % seen[span] + span, UNIT[1]))
    return [b"".join(pieces[i::SAMPLES]) for i in range(SAMPLES)] if pieces else []


def _filler(of: bytes, size: int) -> bytes:
    """Bytes that follow from ``of`` and stand in no text."""
    return bytes(x | 0x80 for x in hashlib.blake2b(of, digest_size=64).digest()[: max(0, size)])


def trained(samples: list[bytes], size: int) -> bytes:
    """What zstandard's trainer makes of the samples; where they are too few for it, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=UNIT[0], d=UNIT[1], notifications=0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(bad: list[str], fine: list[str]) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary."""
    b, f = _document_counts(bad), _document_counts(fine)
    base = trained([f" {' '.join(marked_words(t))} ".encode("utf-8", "surrogatepass") for t in fine], BASE)

    def of(texts: list[str], own: Counter, other: Counter, n_other: int) -> bytes:
        segments = contrast(own, other, len(texts), n_other)
        return base + trained(spans(texts, segments), max(LEAST_SIZE, PER_SPAN * len(segments))) + SHARED

    return of(bad, b, f, len(fine)), of(fine, f, b, len(bad))


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    least: int = 2
    threshold: float = 0.5
    slope: float = 4.0
    trained: bool = True

    def gains(self, text: str | None) -> list[int]:
        if not hasattr(self, "_pair"):
            self._pair = _compressor(self.ordinary).compress, _compressor(self.toxic).compress
        plain, marked = self._pair
        return [len(plain(b)) - len(marked(b)) for b in (SHARED + w for w in windows(text))]

    def evidence(self, gains: list[int], least: int | None = None) -> float:
        least = self.least if least is None else least
        return sum(g for g in gains if g >= least) / math.sqrt(len(gains)) if gains else 0.0

    def score(self, text: str | None) -> float:
        if not self.trained:
            return 0.0
        z = self.slope * (self.evidence(self.gains(text)) - self.threshold)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_pair"}


def train(rows: list[tuple[str, int]]) -> Model:
    """rows: (text, label). Three quarters of the texts, by hash, make the dictionaries, the rest the thresholds."""
    rows = sorted({t: y for t, y in sorted(rows)}.items())
    held = [r for r in rows if zlib.crc32(r[0].encode("utf-8", "surrogatepass")) % 4 == 0]
    made = [r for r in rows if zlib.crc32(r[0].encode("utf-8", "surrogatepass")) % 4]
    bad, fine = _apart([t for t, y in made if y]), _apart([t for t, y in made if not y])
    if not bad or not fine:
        return Model(b"", b"", trained=False)
    model = Model(*dictionaries(bad, fine))
    if len({y for _, y in held}) < 2:
        held = rows
    y = np.array([y for _, y in held])
    gains = [model.gains(t) for t, _ in held]
    best = None
    for least in (1, 2, 3, 4):
        s = np.array([model.evidence(g, least) for g in gains])
        cuts = np.unique(s)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            at = (lo + hi) / 2
            hit, false = (s[y == 1] >= at).mean(), (s[y == 0] >= at).mean()
            key = (hit - FALSE * false, hi - lo)
            if best is None or key > best[0]:
                best = key, least, at
    if best is None:
        return Model(model.toxic, model.ordinary, trained=False)
    _, model.least, model.threshold = best
    s = np.array([model.evidence(g, model.least) for g in gains]) - model.threshold
    grid = np.geomspace(0.5, 50, 25)
    loss = [np.mean(np.logaddexp(0, np.where(y == 1, -k * s, k * s))) for k in grid]
    model.slope = float(grid[int(np.argmin(loss))])
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from labelled documents; ``labels`` has the ids to learn from and nothing else."""
    spark = docs.sparkSession
    y = only(labels, id_col, label_col).toDF("doc_id", "label").where("doc_id is not null and label in (0, 1)")
    y = y.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    ids = [tuple(r) for label, n in ((1, TOXIC), (0, ORDINARY)) for r in y.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
    few = spark.createDataFrame(ids, y.schema)  # at most TOXIC + ORDINARY rows
    d = only(docs, id_col, text_col).toDF("doc_id", "text").where(F.length("text").between(1, LONGEST)).join(F.broadcast(few), "doc_id")
    # An id may stand in any number of rows: one row of each text, then those of the smallest hashes, as many as the bounds allow.
    d = cut(d.groupBy(F.xxhash64("text").alias("h"), "label").agg(F.first("text").alias("text"), F.min(F.xxhash64("doc_id")).alias("at")))
    kept = []
    for label, n in ((1, TOXIC), (0, ORDINARY)):
        far = 0
        for r in d.where(F.col("label") == label).select("h", F.length("text").alias("n"), "at").orderBy("at", "h").limit(n).collect():
            far += r["n"]
            if far <= CHARACTERS:
                kept.append((r["h"], label))
    kept = spark.createDataFrame(kept, "h bigint, label int")  # at most TOXIC + ORDINARY rows
    return train([(r[0], r[1]) for r in d.join(F.broadcast(kept), ["h", "label"]).select("text", "label").collect()])


def score_column(docs: DataFrame, model: Model, text: Column) -> Column:
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(held.value.score, na_action=None).astype(float)

    return score(text)


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that the contract lets a model learn from."""
    return labels.where(crc_mod(F.col(id_col), 5) != 0)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = fit(docs, training_labels(labels), id_col, text_col)
    d = only(docs, id_col, text_col).toDF("doc_id", "text")
    s = d.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), score_column(d, model, F.col("text")).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` without those predicted toxic. ``labelled`` has the texts to learn from, if not ``docs``."""
    model = fit(docs if labelled is None else labelled, training_labels(labels), id_col, text_col)
    return docs.where(score_column(docs, model, F.col(f"`{text_col}`")) < 0.5)
