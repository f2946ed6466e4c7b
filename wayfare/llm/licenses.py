"""Licence scans by the Dice coefficient of word bigrams, in DataFrame functions only.

A text's segments (the whole text, its paragraphs, its lines and its sentences) are normalised to lower-case words. The
bigram sets of a segment and a template have Dice coefficient ``2 |A & B| / (|A| + |B|)``, which reaches t only if
``t / (2 - t) <= |A| / |B| <= (2 - t) / t``; a template outside those bounds is never compared. Such a
segment also shares ``t / (2 - t)`` of the template's bigrams, hence some of a few words (:func:`needles`), which settles
nearly all texts. Templates are constants of the plan, so a scan and one projection without a shuffle do the work.

A licence may also stretch over several lines, sentences or paragraphs of a longer text. Runs of consecutive lines or
sentences within a template's bounds are compared where the text as a whole shares enough of its bigrams (:func:`_runs`);
the best run counts once for each template that no segment of the row matches as well.

Defined cases: null, blank and one-word texts match nothing; ties go to the template first by name; repeated rows are
scanned alike; very long texts are scanned whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import text

THRESHOLD = 0.8
#: Notices of public licences, and two short licences in full.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the '
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
        'copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


#: Words that are too frequent in prose to prune with.
COMMON = {"free", "other", "person", "or", "any", "into", "unless", "shall", "without", "be", "as", "can", "may", "if", "a", "you", "use", "see", "an", "are", "not", "at", "writing", "copy", "following", "the", "of", "and", "to", "in", "is", "this", "that", "with", "for", "from", "under", "by", "version", "work", "public", "released"}


def normalise(t: str) -> list[str]:
    """The words of a template, as the plan normalises texts: lower case, letters and digits."""
    return [w for w in re.split(r"[\W_]+", t.lower()) if w]


def bigrams(words: list[str]) -> list[str]:
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """Least and most bigrams of a segment that can reach the threshold against a template of n."""
    least, most = n * threshold / (2 - threshold), n * (2 - threshold) / threshold
    return max(1, int(-(-least // 1)) if least % 1 > 1e-9 else round(least)), int(most + 1e-9)


def needles(grams: list[str], threshold: float) -> set[str]:
    """Words, or bigrams, of which any segment that reaches the threshold against the template has one.

    It shares at least ``t / (2 - t)`` of the template's bigrams, so it misses fewer than the words returned here stand in.
    Long words that stand in several bigrams come first.
    """
    shared = bounds(len(grams), threshold)[0]
    left, out = {g: g.split(" ") for g in grams}, set()
    while len(grams) - len(left) <= len(grams) - shared:
        words = [w for pair in left.values() for w in pair]
        best = max(dict.fromkeys(words), key=lambda w: ((len(w) > 3 or words.count(w) > 1) * (w not in COMMON), min(len(w), 6) * words.count(w), w))
        if len(best) <= 3:  # too frequent alone: a whole bigram instead
            best = max(left, key=lambda g: (len(g), g))
        out.add(best)
        left = {g: pair for g, pair in left.items() if best not in pair and best != g}
    return out


def limits(grams: dict[str, list[str]], threshold: float) -> tuple[int, int]:
    """(least bigrams, most characters) of a segment that can match any template."""
    span = [bounds(len(v), threshold) for v in grams.values()]
    return min(s[0] for s in span), max(len(g) for v in grams.values() for g in v) * (max(s[1] for s in span) + 2) * 4


def _score(grams: Column, templates: dict[str, list[str]], threshold: float) -> Column:
    """The best (score, name) of a segment's distinct bigrams, or null."""
    n = F.size(grams)
    scores = []
    for name, b in sorted(templates.items()):
        lo, hi = bounds(len(b), threshold)
        dice = 2.0 * F.size(F.array_intersect(grams, F.array(*map(F.lit, b)))) / (n + len(b))
        scores.append(F.when(n.between(lo, hi), F.when(dice >= threshold, F.struct((-dice).alias("worse"), F.lit(name).alias("name")))))
    return F.array_min(F.array_compact(F.array(*scores)))


def _pairs(words: Column) -> Column:
    """The distinct bigrams of an array of words, which is evaluated once."""
    two = lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    return F.transform(F.array(words), two)[0]


def _runs(d: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """d(pieces, found) with the best (score, name) of runs of at least two pieces added to found, for names it lacks or has with less.

    A run has at most ``(2 - t) / t`` times the words of the template. No template is tried from a piece after which that
    many words share too few of its bigrams.
    """
    grams = {k: bigrams(normalise(v)) for k, v in sorted(templates.items())}
    kinds = [
        F.struct(F.lit(k).alias("name"), F.array(*map(F.lit, g)).alias("grams"), F.lit(bounds(len(g), threshold)[0]).alias("least"), F.lit(bounds(len(normalise(templates[k])), threshold)[1]).alias("most"))
        for k, g in grams.items() if g
    ]
    every = F.array(*map(F.lit, sorted(set().union(*grams.values()))))
    d = d.withColumn("shared", F.array_intersect(_pairs(F.split(F.array_join("pieces", " "), " ")), every))
    d = d.withColumn("close", F.filter(F.array(*kinds), lambda k: F.size(F.array_intersect("shared", k["grams"])) >= k["least"]))
    lacks = lambda k: ~F.exists("found", lambda x: (x["name"] == k["name"]) & (x["worse"] <= -1.0))
    better = lambda r: ~F.exists("found", lambda x: (x["name"] == r["name"]) & (x["worse"] <= r["worse"]))
    # words with a mark before, between and after pieces; a run lies between two marks
    d = d.withColumn("w", F.when(F.exists("close", lacks) & (F.size("pieces") > 1), F.split(F.concat(F.lit("| "), F.array_join("pieces", " | "), F.lit(" |")), " ")).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("m", F.filter(F.transform("w", lambda x, i: F.when(x == "|", i + 1)), lambda i: i.isNotNull()))
    at = lambda i: F.get("m", i)
    after = lambda a, k: F.slice(F.array_remove(F.slice("w", at(a) + 1, 2 * k["most"] + 1), "|"), F.lit(1), k["most"])
    inside = lambda a, b: F.array_remove(F.slice("w", at(a) + 1, at(b) - at(a) - 1), "|")
    dice = lambda g, k: 2.0 * F.size(F.array_intersect(g, k["grams"])) / (F.size(g) + F.size(k["grams"]))
    best = lambda g: F.array_min(F.filter(F.transform("close", lambda k: F.struct((-dice(g, k)).alias("worse"), k["name"].alias("name"))), lambda x: x["worse"] <= -threshold))
    ends = lambda a, k: F.filter(F.sequence(a + 2, F.least(F.size("m") - 1, a + k["most"])), lambda b: (at(b) - at(a) - (b - a)).between(k["least"] + 1, k["most"]))
    starts = lambda k: F.filter(F.sequence(F.lit(0), F.size("m") - 3), lambda a: F.size(F.array_intersect(_pairs(after(a, k)), k["grams"])) >= k["least"])
    of = lambda k: F.flatten(F.transform(starts(k), lambda a: F.transform(ends(a, k), lambda b: F.transform(F.array(_pairs(inside(a, b))), best)[0])))
    more = F.filter(F.array_compact(F.flatten(F.transform(F.filter("close", lacks), of))), better)
    d = d.withColumn("more", F.when(F.size("m") > 2, more).otherwise(F.array().cast("array<struct<worse:double,name:string>>")))
    firsts = F.filter(F.array_sort(F.array_distinct("more")), lambda x: x["worse"] == F.array_min(F.filter("more", lambda y: y["name"] == x["name"]))["worse"])
    return d.withColumn("found", F.concat("found", firsts))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(id, n_matches, best_license, best_score, licenses): segments that match, the best and all names of each row."""
    templates = templates or TEMPLATES
    grams = {k: bigrams(normalise(v)) for k, v in templates.items()}
    grams = {k: v for k, v in grams.items() if v}
    least, longest = limits(grams, threshold)
    d = docs.select(F.col(id_column).alias("id"), F.lower(text(column)).alias("t"))
    # a text without any word that a match must have is done; the comparison below is for the rest
    between = r"[^\p{L}\p{N}]+"
    words = sorted(set().union(*(needles(v, threshold) for v in grams.values())))
    maybe = F.col("t").rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(w.replace(' ', between) for w in words)})(?![\p{{L}}\p{{N}}])")
    d = d.withColumn("t", F.when(maybe, F.col("t")).otherwise(F.lit("")))
    # one pass makes words and keeps only what ends a segment; a blank line marks a paragraph
    d = d.withColumn("t", F.regexp_replace("t", r"[^\p{L}\p{N}.!?\n]+", " "))
    flat = lambda x: F.trim(F.regexp_replace(x, r"[ .!?\n]+", " "))
    # a paragraph or whole text counts only if it is more than one line or sentence, and can be within the bounds
    lines = F.split("t", r"\n+| *(?<=[.!?]) +")
    paragraphs = F.filter(F.split("t", r"\n *\n"), lambda x: (F.length(x) <= longest) & x.rlike(r"\n|[.!?] "))
    whole = F.when((F.length("t") <= longest) & F.col("t").rlike(r"\n *\n"), F.array("t")).otherwise(F.array().cast("array<string>"))
    few = F.filter(F.concat(whole, paragraphs, lines, F.split("t", r"\n+")), lambda x: (F.length(x) > 3) & (F.length(x) <= longest))
    d = d.withColumn("segments", F.array_distinct(F.transform(few, flat)))
    # words of a segment: blanks and one; bigrams are one less, repeats lower that only in the text
    blanks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    d = d.withColumn("segments", F.filter("segments", lambda x: blanks(x) >= least))
    d = d.withColumn("found", F.array_compact(F.transform("segments", lambda x: F.transform(F.array(_pairs(F.split(x, " "))), lambda g: _score(g, grams, threshold))[0])))
    d = _runs(d.withColumn("pieces", F.filter(F.transform(lines, flat), lambda x: x != "")), templates, threshold)
    best = F.array_min("found")
    return d.select(
        "id",
        F.size("found").cast("long").alias("n_matches"),
        F.coalesce(best["name"], F.lit("")).alias("best_license"),
        F.round(F.coalesce(-best["worse"], F.lit(0.0)), 6).alias("best_score"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["name"]))), ",").alias("licenses"),
    )
