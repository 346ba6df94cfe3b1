"""Language identification with interpolated Kneser-Ney character models.

Text is lower-cased, everything but letters becomes one space. For each language, orders 1 to ``ORDER`` are counted over a bounded
training sample; the highest order counts occurrences, lower ones distinct left contexts; one discount an order. All languages
share one sorted array of n-gram hashes per order, with a column of probabilities per language, and a second one of contexts with
the back-off weights, so one search in a sorted array serves all languages. A text's language has the lowest cross-entropy per
character over the whole text.

Calibration on sampled texts that the models have not seen: the score is a logistic curve of the margin to the second language,
times that of the language itself not being rejected; a text is rejected if its cross-entropy is above what ``KEPT`` of its
language's own texts reach. Rejection is a column of its own: the prediction stays the nearest learned language.

Training reads every language, of each at most about ``PER_LANGUAGE`` documents, those of the smallest id hashes, and of their texts
at most ``CHARACTERS`` characters, fewer if there are so many languages that the broadcast tables, which hold a number for each
n-gram and language, would grow beyond about ``CELLS`` numbers. The characters are counted before anything is sent to the driver.
More than ``LANGUAGES`` languages are an error, none is left out.

Defined cases: a null text or one without any letter is ``und`` with score 0; without training rows every text is; a null id is not
held out and not trained on; a null language is not trained on; texts of any length are read in chunks; repeated rows give repeated results; ties go to the first language
by code point; an empty table gives an empty result; further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import crc_mod, only, packed

ORDER, PER_LANGUAGE, CHARACTERS, CALIBRATE, LANGUAGES, CELLS = 4, 240, 300_000, 5, 1000, 400_000_000
CHUNK = 1 << 18
KEPT = 0.995
MIX = np.uint64(0x9E3779B97F4A7C15)
SPACE = 32

_fold: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Code point to its lower-case letter, or a space."""
    global _fold
    if _fold is None:
        table = np.full(0x110000, SPACE, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _fold = table
    return _fold


def letters(text: str | None) -> np.ndarray:
    """Code points of the text, folded, runs of spaces as one; empty if there is no letter."""
    if not text:
        return np.zeros(0, np.uint32)
    x = fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = x == SPACE
    keep = ~space
    keep[1:] |= ~space[:-1]
    x = x[keep]
    if len(x) and x[0] == SPACE:
        x = x[1:]
    if len(x) and x[-1] == SPACE:
        x = x[:-1]
    return x


def grams(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that end at each character; ``x`` starts with ORDER - 1 spaces of padding."""
    h = np.zeros(len(x) - ORDER + 1, np.uint64)
    for j in range(n):
        part = x[ORDER - n + j : len(x) - n + j + 1].astype(np.uint64)
        h = (h + part + np.uint64(1)) * MIX
        h ^= h >> np.uint64(29)
    return h


def padded(x: np.ndarray) -> np.ndarray:
    return np.concatenate((np.full(ORDER - 1, SPACE, np.uint32), x))


class Sorted:
    """A sorted array of hashes with a row of values each, entered through an index over the leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bits = max(1, int(np.ceil(np.log2(len(keys) + 1))) + 1)
        start = np.arange((1 << self.bits) + 1, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.first = np.searchsorted(self.keys, start[:-1]).astype(np.int32)
        sizes = np.diff(np.append(self.first, len(keys)))
        self.most = int(sizes.max(initial=0))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 if there is none."""
        at = self.first[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        row = np.full(len(h), -1, np.int32)
        last = len(self.keys) - 1
        open_ = np.arange(len(h))
        for _ in range(self.most):
            here = np.minimum(at[open_], last)
            k = self.keys[here]
            same = k == h[open_]
            row[open_[same]] = here[same]
            open_ = open_[k < h[open_]]
            if not len(open_):
                break
            at[open_] += 1
        return row


class Model:
    """Per order, probabilities by n-gram and language, and back-off weights by context and language."""

    def __init__(self, samples: dict[str, list[np.ndarray]]) -> None:
        self.languages = sorted(samples)
        n_lang = len(self.languages)
        alphabet = max(2, len(np.unique(np.concatenate([x for v in samples.values() for x in v]))) + 1) if n_lang else 2
        self.floor = 1.0 / alphabet
        self.tables: list[Sorted] = []
        self.weights: list[Sorted] = []
        counts: list[list[dict]] = []
        for lang in self.languages:
            text = [padded(x) for x in samples[lang]]
            own = []
            for n in range(1, ORDER + 1):
                own.append(self._count(text, n))
            counts.append(own)
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([c[n - 1]["gram"] for c in counts]))
            contexts = np.unique(np.concatenate([c[n - 1]["context"] for c in counts]))
            p, back = np.zeros((len(keys), n_lang)), np.ones((len(contexts), n_lang))
            for i, c in enumerate(counts):
                d = c[n - 1]
                back[np.searchsorted(contexts, d["context"]), i] = d["weight"]
                p[np.searchsorted(keys, d["gram"]), i] = d["share"]
            # Interpolation with the order below, whose n-gram is the same one without its first character.
            any_lang = {k: (u, v) for c in counts for k, u, v in zip(c[n - 1]["gram"].tolist(), c[n - 1]["lower"].tolist(), c[n - 1]["of"].tolist(), strict=True)}
            lower = np.array([any_lang[k][0] for k in keys.tolist()], np.uint64)
            of = np.array([any_lang[k][1] for k in keys.tolist()], np.uint64)
            weight = back[np.searchsorted(contexts, of)]
            if n == 1:
                below = np.full((len(keys), n_lang), self.floor)
            else:
                row = self.tables[-1].find(lower)
                below = self.tables[-1].values[row]
            self.tables.append(Sorted(keys, p + weight * below))
            self.weights.append(Sorted(contexts, back))
        self.log_tables = [Sorted(t.keys, np.log2(t.values).astype(np.float32)) for t in self.tables]
        self.log_weights = [Sorted(w.keys, np.log2(np.maximum(w.values, 1e-12)).astype(np.float32)) for w in self.weights]
        del self.tables, self.weights

    def _count(self, text: list[np.ndarray], n: int) -> dict:
        """n-grams with their discounted shares, contexts with back-off weights, and each n-gram's lower n-gram and context."""
        full = np.concatenate([grams(x, n) for x in text])
        low = np.concatenate([grams(x, n - 1) for x in text]) if n > 1 else np.zeros(len(full), np.uint64)
        of = np.concatenate([grams(x[:-1], n - 1) if n > 1 else np.zeros(len(x) - ORDER, np.uint64) for x in ([np.concatenate((x[:1], x)) for x in text])])
        if n < ORDER:  # types of one longer n-gram, each counted once
            longer = np.concatenate([grams(x, n + 1) for x in text])
            _, first = np.unique(longer, return_index=True)
            full, low, of = full[first], low[first], of[first]
        gram, first, c = np.unique(full, return_index=True, return_counts=True)
        low, of = low[first], of[first]
        once, twice = (c == 1).sum(), (c == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        context, which = np.unique(of, return_inverse=True)
        total, kinds = np.bincount(which, c), np.bincount(which)
        return {"gram": gram, "share": (c - discount) / total[which], "lower": low, "of": of, "context": context, "weight": discount * kinds / total}

    def bits(self, x: np.ndarray) -> np.ndarray:
        """Cross-entropy of folded text in bits a character, for each language."""
        total = np.zeros(len(self.languages))
        whole = padded(x)
        for at in range(0, len(x), CHUNK):
            total -= self._log2(whole[at : at + CHUNK + ORDER - 1]).sum(0, dtype=np.float64)
        return total / len(x)

    def _log2(self, x: np.ndarray) -> np.ndarray:
        """log2 of each character's probability for each language; the first ORDER - 1 are context."""
        n = len(x) - ORDER + 1
        out = np.zeros((n, len(self.languages)), np.float32)
        open_ = np.arange(n)
        for k in range(ORDER, 0, -1):
            h = grams(x, k)[open_] if len(open_) < n else grams(x, k)
            row = self.log_tables[k - 1].find(h)
            hit = row >= 0
            out[open_[hit]] += self.log_tables[k - 1].values[row[hit]]
            open_ = open_[~hit]
            if not len(open_):
                return out
            # The n-gram is unknown to all: its context's back-off weight, and on with the order below.
            if k > 1:
                context = grams(np.concatenate((x[:1], x[:-1])), k - 1)[open_]
            else:
                context = np.zeros(len(open_), np.uint64)
            row = self.log_weights[k - 1].find(context)
            known = row >= 0
            out[open_[known]] += self.log_weights[k - 1].values[row[known]]
        out[open_] += np.float32(np.log2(self.floor))
        return out


class Identifier:
    """A model with its calibration: (language, score, rejected) of a text."""

    def __init__(self, model: Model | None, held: list[tuple[np.ndarray, str]]) -> None:
        self.model, self.slope, self.limit = model, 4.0, {}
        if model is None:
            return
        got = [(model.bits(x), lang) for x, lang in held if len(x)]
        margins, right = [], []
        for b, lang in got:
            i = int(np.argmin(b))
            right.append(model.languages[i] == lang)
            margins.append(self._margin(b, i))
        if margins:
            m, y = np.array(margins), np.array(right)
            grid = np.geomspace(0.5, 64, 29)
            self.slope = float(grid[int(np.argmin([np.mean(np.where(y, np.logaddexp(0, -k * m), np.logaddexp(0, k * m))) for k in grid]))])
        for i, lang in enumerate(model.languages):
            own = [b[i] for b, own in got if own == lang]
            self.limit[lang] = float(np.quantile(own, KEPT)) * 1.05 if own else np.inf

    @staticmethod
    def _margin(b: np.ndarray, i: int) -> float:
        return float(np.partition(b, 1)[1] - b[i]) if len(b) > 1 else 8.0

    def identify(self, text: str | None) -> tuple[str, float, bool]:
        x = letters(text)
        if self.model is None or not len(x):
            return "und", 0.0, True
        b = self.model.bits(x)
        i = int(np.argmin(b))
        lang = self.model.languages[i]
        sure = 1 / (1 + np.exp(-self.slope * self._margin(b, i)))
        fits = 1 / (1 + np.exp(min(50.0, 8 * (b[i] - self.limit[lang] - 0.5)))) if np.isfinite(self.limit[lang]) else 1.0
        return lang, float(sure * fits), bool(b[i] > self.limit[lang])


def train(rows: list[tuple[str, str]], characters: int = CHARACTERS) -> Identifier:
    """rows: (text, language); every ``CALIBRATE``-th text of a language calibrates, of the others at most so many characters are used."""
    samples: dict[str, list] = {}
    held, used = [], {}
    for k, (text, lang) in enumerate(sorted(rows, key=lambda r: (r[1], r[0]))):
        x = letters(text)
        if not len(x):
            continue
        if k % CALIBRATE == 0 and samples.get(lang):
            held.append((x[:20_000], lang))
        elif used.get(lang, 0) < characters:
            x = x[: characters - used.get(lang, 0)]
            used[lang] = used.get(lang, 0) + len(x)
            samples.setdefault(lang, []).append(x)
    return Identifier(Model(samples) if samples else None, held)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Identifier:
    """A model from all rows of ``labelled``, sampled by id hash to about PER_LANGUAGE documents a language."""
    d = only(labelled, id_col, text_col, lang_col).toDF("doc_id", "text", "lang").where("lang is not null")
    sizes = {r[0]: r[1] for r in d.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if not sizes:
        return Identifier(None, [])
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    most = max(400, min(CHARACTERS, CELLS // len(sizes) ** 2))
    top = 1 << 30
    shares = d.sparkSession.createDataFrame([(s, max(1, int(top * min(1.0, PER_LANGUAGE / n)))) for s, n in sizes.items()], "lang string, share bigint")
    at = F.pmod(F.xxhash64("doc_id"), F.lit(top))
    few = d.where(F.length("text") > 0).join(F.broadcast(shares), "lang").where(at < F.col("share"))
    # A language's sample is small; of it, texts are taken until the characters are used up, calibration's share on top.
    rank = Window.partitionBy("lang").orderBy(at, "text").rowsBetween(Window.unboundedPreceding, -1)
    few = few.withColumn("before", F.coalesce(F.sum(F.length("text")).over(rank), F.lit(0))).where(F.col("before") < 2 * most)
    return train([tuple(r) for r in few.select(F.substring("text", 1, most).alias("text"), "lang").collect()], most)


def predict(docs: DataFrame, identifier: Identifier, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected, in place of columns of its own that have these names."""
    held = docs.sparkSession.sparkContext.broadcast(identifier)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def say(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield pd.DataFrame([held.value.identify(t) for t in part], columns=["lang_pred", "score", "rejected"])

    kept = packed(docs, "lang_pred", "score", "rejected") if text_col not in ("lang_pred", "score", "rejected") else packed(docs)
    return kept.select("_row", say(F.col(f"_row.`{text_col}`")).alias("_said")).select("_row.*", "_said.*")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected; learned from the documents that are not held out."""
    d = only(docs, id_col, text_col, lang_col).toDF("doc_id", "text", "lang")
    model = fit(d.where(crc_mod(F.col("doc_id"), 3) != 1))
    d = d.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "text")
    return predict(d, model).drop("text")
