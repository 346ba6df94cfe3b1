"""Licence scanning by Dice's coefficient over word bigrams, as one projection without a shuffle.

Text is lower-cased, letters and digits are kept, lines are trimmed. Its lines, its paragraphs (parted by empty lines) and the whole
text are each held against licence templates. Two sets of m and n bigrams can reach a coefficient t only if
t/(2-t) m <= n <= (2-t)/t m, so the number of distinct bigrams decides which templates are compared at all, and most lines with none.

They also share t/(2-t) m bigrams at least. Of each template, words are marked that stand in more of its bigrams than may be missing:
a text without any marked word holds no unit that reaches the coefficient, and is left after one search for these words.

Defined cases: null and empty texts match nothing; null ids are kept; texts of any length are compared whole; templates are compared as sets of distinct bigrams; of equal coefficients the
template listed first wins; repeated rows give repeated results; an empty table gives an empty result; further columns are dropped.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import only

THRESHOLD = 0.8
#: Words of ordinary English, which are marked last.
USUAL = frozenset("the a of and to or in is for this that with from at not may be any all by under as it are".split())
#: Short notices and public licence texts.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    (
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "bsd-3-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)


def normal_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def bigrams_of(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def sizes(m: int, threshold: float) -> tuple[int, int]:
    """The numbers of bigrams that can reach the threshold against m."""
    t = Fraction(str(threshold))
    return math.ceil(m * t / (2 - t)), math.floor(m * (2 - t) / t)


def marked_words(grams: list[str], threshold: float) -> list[str]:
    """Words, the longest first and usual ones last, that together stand in more bigrams than a set may lack that reaches the threshold."""
    missing = len(grams) - sizes(len(grams), threshold)[0]
    left, out = list(grams), []
    for w in sorted({w for g in grams for w in g.split(" ")}, key=lambda w: (w in USUAL, -len(w), w)):
        if len(grams) - len(left) > missing:
            break
        if any(w in g.split(" ") for g in left):
            left = [g for g in left if w not in g.split(" ")]
            out.append(w)
    return out


def normal(text: Column) -> Column:
    """Lower-cased letters and digits, one space between words, lines kept and trimmed."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    return F.regexp_replace(t, " ?\n ?", "\n")


def _words(unit: Column) -> Column:
    return F.filter(F.split(unit, "[ \n]"), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))
    return F.array_distinct(pairs)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice (of the best unit and template; null if none reaches the threshold), licenses (all, joined) and n_units."""
    held = []
    for i, (name, text) in enumerate(templates):
        grams = bigrams_of(normal_words(text))
        held.append((i, name, grams, *sizes(len(grams), threshold)))
    fewest = min(h[3] for h in held)
    most = max(h[4] for h in held)
    table = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(name).alias("name"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, name, grams, lo, hi in held))

    def best(grams: Column) -> Column:
        fits = F.filter(table, lambda t: (F.size(grams) >= t["lo"]) & (F.size(grams) <= t["hi"]))
        scored = F.transform(fits, lambda t: F.struct((-2.0 * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + F.size(t["grams"]))).alias("d"), t["i"].alias("i"), t["name"].alias("name")))
        return F.array_min(F.filter(scored, lambda s: s["d"] <= -threshold))

    marks = sorted({w for h in held for w in marked_words(h[2], threshold)})
    some = F.regexp_like("text", F.lit(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(marks)})(?![\p{{L}}\p{{N}}])"))
    d = only(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", normal(F.col("text")))
    d = d.withColumn("text", F.when(some, F.col("text")).otherwise(""))
    units = F.concat(F.split("text", "\n"), F.split("text", "\n\n+"), F.array("text"))
    # Distinct bigrams decide what a unit can reach, however often they are repeated. It has more words than any of them, and at least
    # as many distinct bigrams as distinct words less one; long units are not made into bigrams where these are too many.
    able = lambda w: (F.size(w) > fewest) & ((F.size(w) <= most) | (F.size(F.array_distinct(w)) <= most + 1))
    worded = F.filter(F.transform(F.array_distinct(units), _words), able)
    d = d.withColumn("units", F.transform(worded, _bigrams))
    d = d.withColumn("hits", F.filter(F.transform("units", best), lambda h: h.isNotNull()))
    top = F.array_min("hits")
    return d.select("doc_id", top["name"].alias("license"), (-top["d"]).alias("dice"), F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["name"]))), ",").alias("licenses"), F.size("hits").cast("long").alias("n_units"))
