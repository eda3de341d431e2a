"""License scans: text compared with licence templates by the Dice coefficient over word bigrams. DataFrame functions only.

A document's segments are its lines, its blocks (lines up to an empty one) and the whole text, in lower case without punctuation. Where a segment has
a distinct bigrams and a template b, Dice = 2 * common / (a + b) can only reach t if t / (2 - t) <= a / b <= (2 - t) / t. A segment whose size is out of
these bounds for every template goes no further, and the others are compared only with the templates they leave. Then at least
t / (2 - t) * b bigrams are common, so of any b + 1 less that number one is: a text without one of these goes nowhere (`telling_bigrams`).

Templates are a parameter, (name, text), and travel with the plan; they are checked to be at most `MOST_TEMPLATES` bigrams.

Defined results: null and empty texts and texts without a match have no licence, score 0 and 0 matches; equal scores go to the name
that sorts first; repeated rows and null ids are reported each.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.llm.common import keyed, lower_ascii, split_words

THRESHOLD = 0.8
MOST_TEMPLATES = 20_000
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between two words of a text as it came.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
IN_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Notices as their licences give them or as they are commonly shortened.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]


def words_of(text: Column) -> Column:
    return split_words(lower_ascii(text), GAPS)


def bigrams_of(words: Column) -> Column:
    """Distinct bigrams; an array of fewer than two words has none."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.slice(words, i, 2)))
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def template_bigrams(text: str) -> list[str]:
    words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def telling_bigrams(known: list[tuple[str, list[str]]], threshold: float) -> list[str] | None:
    """Bigrams of which a text that matches any template has one at least; None if a match needs no common bigram.

    The longest are taken, which are the rarest as a rule.
    """
    told = set()
    for _, bigrams in known:
        common = math.ceil(threshold / (2 - threshold) * len(bigrams) - 1e-6)
        if common < 1:
            return None
        told.update(sorted(bigrams, key=lambda b: (-len(b), b))[: len(bigrams) - common + 1])
    return sorted(told)


def telling_pattern(bigrams: list[str]) -> str:
    """Pattern of texts with one of the bigrams; of words that begin alike the beginning is written once, so most places fail at one letter.

    Words are letters, digits and characters beyond ASCII, and only A-Z have two cases. A bigram starts where a word does.
    """

    def joined(rests: list[str]) -> str:
        if "" in rests:
            return ""  # any longer one has it
        firsts = sorted({r[0] for r in rests})
        parts = [(BETWEEN if c == " " else re.escape(c)) + joined([r[1:] for r in rests if r[0] == c]) for c in firsts]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return f"(?i)(?<!{IN_WORD}){joined(bigrams)}"


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, license (best match or null), score, n_matches (pairs of segment and template)."""
    known = [(name, template_bigrams(text)) for name, text in templates]
    if sum(len(b) for _, b in known) > MOST_TEMPLATES:
        raise ValueError(f"templates have more than {MOST_TEMPLATES} bigrams in all")
    known = [(name, b) for name, b in known if b]
    base = keyed(docs).drop("_row")
    if not known:
        return base.select("doc_id", F.lit(None).cast("string").alias("license"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_matches"))
    text = F.coalesce(F.col("text"), F.lit(""))
    segments = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n[\x20\x09-\x0D]*\n"), F.array(text)))
    telling = telling_bigrams(known, threshold)
    some = base if telling is None else base.filter(F.col("text").rlike(telling_pattern(telling)))
    rows = some.select("_key", F.explode(segments).alias("_s")).select("_key", words_of(F.col("_s")).alias("_w"))
    # a little wider than the bounds, so that rounding prunes nothing that just reaches the threshold
    low, high = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9
    # a segment has at most one bigram less than words, so too few words are out before bigrams are made
    fewest = min((len(b) for _, b in known), default=1) * low
    rows = rows.filter(F.size("_w") - 1 >= fewest)
    rows = rows.select("_key", bigrams_of(F.col("_w")).alias("_b"))
    n = F.size("_b")
    dice = []
    for name, b in known:
        common = F.size(F.array_intersect("_b", F.lit(b)))
        found = F.struct((F.lit(2.0) * common / (n + len(b))).alias("score"), F.lit(name).alias("name"))
        dice.append(F.when((n >= len(b) * low) & (n <= len(b) * high), found))
    # null where the bounds rule a template out; kept inside one expression, so bigrams are made once a segment
    good = F.filter(F.array(*dice), lambda d: d.isNotNull() & (d["score"] >= threshold))
    matched = rows.select("_key", F.explode(good).alias("_d"))
    segment = matched.groupBy("_key").agg(F.min(F.struct((-F.col("_d.score")).alias("s"), F.col("_d.name").alias("name"))).alias("_best"), F.count(F.lit(1)).alias("n_matches"))
    out = base.join(segment, "_key", "left")
    return out.select(
        "doc_id", F.col("_best.name").alias("license"), F.coalesce(-F.col("_best.s"), F.lit(0.0)).alias("score"),
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
    )
