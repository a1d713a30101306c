"""License scans: coverage of license templates by patience alignment.

Words are runs of letters and digits, lower-cased.  A template's anchors are its
words that are not function words; a document's passages are where its anchors
stand no further apart than `reach` words, with as many words around.  Where a
passage has an anchor more often than the template, notices may stand side by side:
then the places where each anchor puts the template are passages too.  Within a
passage, words unique to both texts are paired, the longest increasing subsequence
of the pairs is kept, and the gaps between them are aligned the same way, after
equal words at their ends.  Coverage is the share of the template's words that are
aligned within the best passage.  Ties go to the longer template, then by name.

Edge cases: null and empty texts, and texts without anchors, have coverage 0 and
no license; a license is named from `least` coverage on; of repeated notices the
first best passage counts; repeated rows give repeated results; an empty table
gives an empty result.  Other columns pass through, unless they have a result's name.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, given
from .textkernel import utf8_views

# Notices of public licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit": "Released under the MIT License.",
    "mit-notice": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
}

# Function words that don't mark a passage.
FUNCTION_WORDS = frozenset("a above all also an and any are as at be by can do either even following for from general in is it later may more must no not of on only option or other that the this to under use will with without work you your".split())

_WORD = re.compile(rb"[a-z0-9]+")


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class LicenseConfig:
    templates: Mapping[str, str] = field(default_factory=lambda: dict(TEMPLATES))
    least: float = 0.8
    reach: int = 12


def increasing(values: Sequence[int]) -> list[int]:
    """Positions of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for at, value in enumerate(values):
        pile = bisect_left(tops, value)
        before.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(value)
            piles.append(at)
        else:
            tops[pile], piles[pile] = value, at
    out, at = [], piles[-1] if piles else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def align(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Pairs (i, j) with a[i] == b[j], increasing in both."""
    pairs, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            pairs.append((lo, low))
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            hi, high = hi - 1, high - 1
            pairs.append((hi, high))
        if lo == hi or low == high:
            continue
        in_a, in_b = Counter(a[lo:hi]), Counter(b[low:high])
        where = {b[j]: j for j in range(low, high) if in_b[b[j]] == 1}
        anchors = [(i, where[a[i]]) for i in range(lo, hi) if in_a[a[i]] == 1 and a[i] in where]
        anchors = [anchors[k] for k in increasing([j for _, j in anchors])]
        if not anchors:
            continue
        pairs += anchors
        last, last_b = lo, low
        for i, j in [*anchors, (hi, high)]:
            todo.append((last, i, last_b, j))
            last, last_b = i + 1, j + 1
    return sorted(pairs)


@dataclass(frozen=True)
class _Template:
    name: str
    words: tuple[bytes, ...]
    anchors: frozenset[bytes]


def compiled(config: LicenseConfig) -> list[_Template]:
    out = []
    for name, text in config.templates.items():
        words = tuple(words_of(text.encode()))
        anchors = frozenset(w for w in words if w.decode() not in FUNCTION_WORDS and not w.isdigit())
        out.append(_Template(name, words, anchors or frozenset(words)))
    return out


def passages(words: Sequence[bytes], template: _Template, reach: int) -> list[tuple[int, int]]:
    """Spans of a text in which the template's anchors stand close together."""
    hits = [i for i, w in enumerate(words) if w in template.anchors]
    spans: list[list[int]] = []
    for i in hits:
        if spans and i - spans[-1][1] <= reach:
            spans[-1][1] = i
        else:
            spans.append([i, i])
    return [(max(0, x - reach), min(len(words), y + reach + 1)) for x, y in spans]


def repeats(words: Sequence[bytes], lo: int, hi: int, template: _Template) -> list[tuple[int, int]]:
    """Within a span with an anchor more often than the template has it, the places of the template by each anchor."""
    most = Counter(w for w in template.words if w in template.anchors)
    found = Counter(w for w in words[lo:hi] if w in most)
    if all(n <= most[w] for w, n in found.items()):
        return []
    offsets: dict[bytes, list[int]] = {}
    for j, w in enumerate(template.words):
        offsets.setdefault(w, []).append(j)
    size = len(template.words)
    begins = {max(lo, i - j) for i in range(lo, hi) if words[i] in most for j in offsets[words[i]]}
    # as long as the template, and with room for words put in
    return [(x, min(hi, x + n)) for n in (size, size + max(1, size // 5)) for x in sorted(begins)]


def scan(text: bytes, templates: list[_Template], config: LicenseConfig) -> tuple:
    """(template, coverage, first word, last word) of the best template; (None, 0.0, None, None) without any."""
    words = words_of(text)
    present = set(words)
    best, rank = (None, 0.0, None, None), (0.0, 0)
    for t in sorted(templates, key=lambda t: t.name):
        if t.anchors.isdisjoint(present):
            continue
        spans = passages(words, t, config.reach)
        for lo, hi in [s for span in spans for s in (*repeats(words, *span, t), span)]:
            if min(hi - lo, len(t.words)) < rank[0] * len(t.words):
                continue
            pairs = align(words[lo:hi], t.words)
            share = len(pairs) / len(t.words)
            if pairs and (share, len(t.words)) > rank:
                rank = (share, len(t.words))
                best = (t.name, share, lo + pairs[0][0], lo + pairs[-1][0])
    return best


def _scanned(text: Column, config: LicenseConfig) -> Column:
    @F.arrow_udf("struct<template:string,coverage:double,first_word:bigint,last_word:bigint>")
    def kernel(texts: pa.Array) -> pa.Array:
        templates = compiled(config)
        rows = [scan(v.tobytes(), templates, config) for v in utf8_views(texts)]
        kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["template", "coverage", "first_word", "last_word"])

    return kernel.asNondeterministic()(text)


def scan_licenses(docs: DataFrame, config: LicenseConfig | None = None, *, text: str = "text") -> DataFrame:
    """`docs` with license (null below the least coverage), coverage, first_word and last_word of the aligned passage.

    A map over rows: no shuffle.
    """
    config = config or LicenseConfig()
    found = docs.select(given(docs, "license", "coverage", "first_word", "last_word").alias("given"), _scanned(column(text), config).alias("s"))
    named = F.when(F.col("s.coverage") >= config.least, F.col("s.template"))
    return found.select("given.*", named.alias("license"), F.round("s.coverage", 6).alias("coverage"), F.col("s.first_word").alias("first_word"), F.col("s.last_word").alias("last_word"))
