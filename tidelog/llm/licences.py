"""License scans: MinHash bands retrieve templates for overlapping windows, shingle containment verifies them.

Texts are sequences of words (runs of ASCII letters and digits, lower-cased). Templates fall into classes by length,
which double from SHORTEST words to whatever the longest template needs; a class of up to L words looks at windows of
2 L words that start every L words, so each occurrence lies in a window whole. Windows and templates are sets of
SHINGLE-word shingles. A window meets the templates with which it shares one of BANDS MinHash values (bands of one
row): a template that is contained to CONTAINMENT has at least a twelfth of the window's shingles, so the chance to
miss it is below (11 / 12) ** BANDS, one in 68,000. A match has at least CONTAINMENT of the template's shingles in one
window, counted exactly.

Two steps before the bands lose nothing. Only texts with one of a few telling words are cut into shingles: words chosen
so that fewer than CONTAINMENT of any template's shingles lack them. And only windows around a shingle that some
template has are made, since others share no MinHash value with one. A text's shingles are hashed once, and a window
is a slice of these hashes, so work and memory grow with the text's length, not its square. All of it is built-in
functions; no Python runs on the executors.

Defined results: null and empty texts match nothing; repeated rows and null ids are judged row by row (rows that share
an id show one result); an empty table gives no rows; ties and overlapping windows count as one match, at the first.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import table

SHINGLE = 5
BANDS = 128
CONTAINMENT = 0.8
#: Words of the longest template of the first class; each further class has twice as many.
SHORTEST = 8

# The wording of common license notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit-line": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense-line": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "Copyright. All rights reserved by the author.",
}

# Words too common to tell a license.
_COMMON = set("a an and any as at be by do for from if in is it may not of on one or so that the this to under was with you 0 2 3 4".split())


def _words(text: str) -> list[str]:
    return re.findall("[0-9a-z]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def _shingles(words: list[str]) -> list[tuple[str, ...]]:
    return sorted({tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}) if words else []


def span_of(wording: str) -> int:
    """The class of a template: the words of its longest one."""
    span, n = SHORTEST, len(_words(wording))
    while span < n:
        span *= 2
    return span


def telling_words(templates: Mapping[str, str], containment: float = CONTAINMENT) -> list[str]:
    """Words of which every part of a template that counts as a match has one: chosen greedily, common ones last,
    until fewer shingles of each template lack them than a match needs."""
    sets = {name: _shingles(_words(t)) for name, t in templates.items()}
    out: list[str] = []
    while True:
        counts: dict[str, int] = {}
        for shingles in sets.values():
            bare = [s for s in shingles if not set(s) & set(out)]
            if len(bare) >= containment * len(shingles):
                for s in bare:
                    for w in set(s):
                        counts[w] = counts.get(w, 0) + 1
        if not counts:
            return sorted(out)
        out.append(max(counts, key=lambda w: (w not in _COMMON, len(w) > 3, counts[w], w)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once however often and deep it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _has_any(text: Column, words: list[str]) -> Column:
    """Whether a lower-cased text holds any of the strings; the lambda lower-cases it once."""

    def found(lower: Column) -> Column:
        out = lower.contains(words[0])
        for w in words[1:]:
            out = out | lower.contains(w)
        return out

    return F.exists(F.array(F.lower(text)), found)


def _least(shingles: Column, band: int) -> Column:
    return F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(band))))


def _signature(shingles: Column) -> Column:
    """BANDS keys, each the least of one hash of all shingles."""
    return F.array(*[F.xxhash64(F.lit(band), _least(shingles, band)) for band in range(BANDS)])


def _shingle_hashes(words: Column) -> Column:
    """The hash of each shingle of a word array, in order; shorter arrays are one shingle, empty ones none."""
    last = F.greatest(F.size(words) - SHINGLE, F.lit(0))
    # Single words are read from the array: a slice would copy all of it, here for each shingle and below for each window.
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)]))).otherwise(F.array().cast("array<bigint>"))


def _text_words(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, "[^0-9a-z]+"), lambda w: w != "")


def _windows(hashes: Column, spots: Column, span: int) -> Column:
    """The windows of a class around the spots (indexes of shingles): span, first word, distinct hashes."""
    # A shingle that starts at word i lies in the window that starts at the last multiple of span, or the one before.
    starts = F.array_distinct(F.flatten(F.transform(spots, lambda i: F.array(i - i % span, F.greatest(i - i % span - span, F.lit(0))))))
    inside = lambda at: F.sequence(at, F.least(at + 2 * span - SHINGLE, F.size(hashes) - 1))
    return F.transform(starts, lambda at: F.struct(F.lit(span).alias("span"), at.alias("first_word"), F.array_distinct(F.transform(inside(at), lambda i: F.get(hashes, i))).alias("shingles")))


def _cut(hashes: Column, every: list[int], spans: list[int]) -> Column:
    """All classes' windows around the shingles of a text that some template has."""
    wanted = F.array(*[F.lit(h) for h in every])

    def around(met: Column) -> Column:  # the text's shingles that templates have: none, as a rule
        spots = F.filter(F.sequence(F.lit(0), F.greatest(F.size(hashes) - 1, F.lit(0))), lambda i: F.array_contains(met, F.get(hashes, i)))
        spots = F.when(F.size(met) > 0, spots).otherwise(F.array().cast("array<int>"))
        return _let(spots, lambda found: F.concat(*[_windows(hashes, found, span) for span in spans]))

    return _let(F.array_intersect(hashes, wanted), around)


def license_matches(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license, containment, first_word (where its first window starts), windows of each license in a text."""
    spark = docs.sparkSession
    worded = {name: text for name, text in templates.items() if _words(text)}
    if not worded:
        return docs.sparkSession.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, license string, containment double, first_word long, windows long")
    spans = sorted({span_of(text) for text in worded.values()})
    listed = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(span_of(text)).alias("span"), F.split(F.lit(" ".join(_words(text))), " ").alias("words")) for name, text in worded.items()])
    known = spark.range(1).select(F.explode(listed).alias("t")).select("t.license", "t.span", F.array_distinct(_let(F.col("t.words"), _shingle_hashes)).alias("wanted"))
    keyed = known.select("license", "span", "wanted", F.explode(_signature(F.col("wanted"))).alias("band"))
    every = sorted({h for (h,) in known.select(F.explode("wanted")).distinct().collect()})

    told = docs.select("doc_id", "text").where(_has_any(F.col("text"), telling_words(worded)))
    cut = told.select("doc_id", F.explode(_let(_let(_text_words(F.col("text")), _shingle_hashes), lambda h: _cut(h, every, spans))).alias("w"))
    windows = cut.select("doc_id", "w.span", "w.first_word", "w.shingles")
    met = windows.withColumn("band", F.explode(_signature(F.col("shingles")))).join(F.broadcast(keyed), ["span", "band"])  # BANDS rows a template
    share = F.size(F.array_intersect("shingles", "wanted")) / F.size("wanted")
    matched = met.select("doc_id", "license", "first_word", share.alias("containment")).where(F.col("containment") >= CONTAINMENT)
    return matched.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("first_word").cast("long").alias("first_word"), F.count_distinct("first_word").alias("windows"))


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_matches(table(spark, sf_dir, "documents"))
