"""Token fingerprints: the sign of summed MD5 bits, packed as hexadecimal digits, and distances between them.

By default the bits before a hash's first set bit add nothing (``textbook=False``); in the textbook form they subtract.
"""

from __future__ import annotations

from collections import Counter
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.text import STOPWORDS, power_of_two

#: Words whose bits are summed at once.
CHUNK = 1 << 15


def signs(words: list[str], bits: int, textbook: bool) -> np.ndarray:
    """+1, -1 or 0 for each of the leading ``bits`` bits of each word's MD5; beyond 128 bits, zeros stand in front."""
    h = np.frombuffer(b"".join(md5(w.encode("utf-8", "surrogatepass")).digest() for w in words), np.uint8)
    h = np.unpackbits(h.reshape(-1, 16), axis=1)[:, :bits].astype(np.int8)
    out = 2 * h - 1
    if not textbook:
        out *= np.maximum.accumulate(h, axis=1)
    return np.concatenate((np.zeros((len(words), max(0, bits - 128)), np.int8), out), axis=1)


def simhash(words: Column, bits: int = 128, stop: tuple[str, ...] = STOPWORDS, textbook: bool = False) -> Column:
    """The fingerprint of an array of words as bits/4 hexadecimal digits; empty without words; null for null. Ties give 0."""
    if not power_of_two(bits) or bits < 4:
        raise ValueError("the number of bits must be a power of two from 4 on")
    skip = frozenset(stop)

    @F.pandas_udf("string")
    def of(column: pd.Series) -> pd.Series:
        out = []
        for ws in column:
            if ws is None:
                out.append(None)
                continue
            counted = [(w, n) for w, n in Counter(ws).items() if w not in skip]
            total = np.zeros(bits)
            for at in range(0, len(counted), CHUNK):
                names, counts = zip(*counted[at : at + CHUNK], strict=True)
                total += np.array(counts, float) @ signs(names, bits, textbook)
            out.append(np.packbits(total > 0).tobytes().hex()[: bits // 4] if counted else "")
        return pd.Series(out, dtype=object)

    return of(words)


def differing_digits(a: Column, b: Column, digits: int) -> Column:
    """Hexadecimal digits that differ. Equal blocks of 15 digits are left out by exclusive or on numbers."""
    total = F.lit(0)
    for at in range(0, digits, 15):
        n = min(15, digits - at)
        x = F.conv(F.substring(a, at + 1, n), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(b, at + 1, n), 16, 10).cast("long"))
        folded = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseOR(F.shiftright(x, 3)).bitwiseAND(F.lit(0x111111111111111))
        total = total + F.bit_count(folded)
    return total


def hamming(a: Column, b: Column, digits: int) -> Column:
    """Bits that differ."""
    total = F.lit(0)
    for at in range(0, digits, 15):
        n = min(15, digits - at)
        total = total + F.bit_count(F.conv(F.substring(a, at + 1, n), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(b, at + 1, n), 16, 10).cast("long")))
    return total


def bands(print_: Column) -> Column:
    """(band, digit) of every hexadecimal digit, four bits each."""
    return F.transform(F.filter(F.split(print_, ""), lambda c: c != ""), lambda c, i: F.struct(i.cast("int").alias("band"), c.alias("digit")))
