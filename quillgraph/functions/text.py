"""Column expressions over text: tokens, cleaning, predicates and checksums."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space; written out because engines differ on the short class.
SPACE = r"[ \t\n\r\f\x0B]+"
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf|infinity)$"

#: Common English words that carry no content.
STOPWORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
    do does did doing a an the and but if or because as until while of at by for with about against between into through during
    before after above below to from up down in out on off over under again further then once here there when where why how all any
    both each few more most other some such no nor not only own same so than too very s t can will just don should now
    """.split()
)


def tokens(text: Column) -> Column:
    """Maximal runs of other than white space, as they stand."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def strip_punctuation(text: Column) -> Column:
    """Deletes ASCII punctuation; what it parted is joined."""
    return F.translate(text, PUNCTUATION, "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}|{SPACE}$", "")


def without(words: Column, stop: tuple[str, ...] = STOPWORDS) -> Column:
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def is_number(word: Column) -> Column:
    """Whether a word reads as a floating-point number, nan and infinity included. A cast would also take 12d and 12f."""
    return F.regexp_like(word, F.lit(NUMBER))


def clean_speech(text: Column, title_words: int = 7) -> Column:
    """A speech's words: two banner lines go, then a line of at most seven words if one follows; empty lines go, then punctuation.

    Null for fewer than three lines. A line of punctuation only leaves an empty string behind, hence doubled spaces.
    """
    lines = F.transform(F.split(text, "\n"), strip)
    body = F.slice(lines, 3, F.size(lines))
    body = F.when(F.size(tokens(F.get(body, F.lit(0)))) <= title_words, F.slice(body, 2, F.size(body))).otherwise(body)
    words = F.transform(F.filter(body, lambda x: x != ""), strip_punctuation)
    return F.when(F.size(lines) >= 3, F.array_join(words, " "))


def subject_terms(subject: Column, vocabulary: Column | None = None, stop: tuple[str, ...] = STOPWORDS) -> Column:
    """Words of a subject line, without reply and forward marks (wherever they stand), stop words and digits; null if none is left."""
    s = F.lower(subject)
    for mark in ("re: ", "fw: ", "re ", "fw "):
        s = F.replace(s, F.lit(mark), F.lit(""))
    s = strip_punctuation(strip(s))
    s = F.when(s.isin("re", "fw"), "").otherwise(s)
    words = without(F.filter(tokens(s), lambda w: ~F.regexp_like(w, F.lit("^[0-9]+$"))), stop)
    if vocabulary is not None:
        words = F.filter(words, lambda w: F.array_contains(vocabulary, w))
    return F.when(F.size(words) > 0, words)


def body_words(line: Column) -> Column:
    """Words of a body line that are not digits only; case is kept."""
    return F.filter(tokens(line), lambda w: ~F.regexp_like(w, F.lit("^[0-9]+$")))


def counter_text(score: Column) -> Column:
    """A score with 12 significant digits and no zeros after them but one behind the point, as run files print it."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.12g", score), r"(\.\d*?)0+$", "$1"), r"\.$", ".0")


def power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def adler32(text: Column) -> Column:
    """Adler-32 of the UTF-8 bytes, unsigned."""

    @F.pandas_udf("bigint")
    def of(s: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else zlib.adler32(t.encode()) for t in s], dtype="Int64")

    return of(text)


def signed32(x: Column) -> Column:
    return F.when(x >= 2**31, x - 2**32).otherwise(x)


def manual_checksum(text: Column) -> Column:
    """Sums b and sums of sums a over the bytes but spaces, both from 0, modulo 65521: a in the high half, b in the low one."""

    @F.pandas_udf("bigint")
    def of(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            if t is None:
                out.append(None)
                continue
            c = np.frombuffer(t.encode().replace(b" ", b""), np.uint8).astype(np.int64)
            low = int(c.sum()) % 65521
            high = int(((np.arange(len(c), 0, -1) % 65521) * c).sum() % 65521) if len(c) < 1 << 30 else sum(int(x) * (len(c) - i) for i, x in enumerate(c)) % 65521
            out.append(high << 16 | low)
        return pd.Series(out, dtype="Int64")

    return of(text)
