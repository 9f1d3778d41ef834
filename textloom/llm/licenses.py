"""Patience alignment of licence templates: words that are unique to both sides anchor the match, the longest
increasing run of anchors is kept, and the gaps between them are aligned the same way.

A template is found where its aligned words cover at least ``COVER`` of it and make at least ``COMPACT`` of the words
from the first to the last of them. The text is read whole: windows start wherever a template's rarest words stand,
so a notice is found anywhere and as often as it occurs; words that the template doesn't have are left out of its
windows, so any of them may stand between. Where notices overlap, the best covered is taken.

The catalogue has short notices and headers of common families, not the full texts of licences.

Edge cases: an empty table gives an empty result; of notices that overlap and are covered alike, the longer template,
then the first by name counts; a very long text takes time in proportion to its words; null and empty texts have no notice; repeated rows and null ids are scanned each; texts with no
template word are finished by one set test; columns other than the id and the text aren't read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches

#: Share of a template's words that have to be aligned.
COVER = 0.8
#: Share of the words from a notice's first to its last that have to be aligned.
COMPACT = 0.4

# The wording of public licence notices.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": "Released under the BSD 2-Clause License",
    "BSD-3-Clause": "Released under the BSD 3-Clause License",
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details."
    ),
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}

_WORD = re.compile(r"[A-Za-z0-9]+(?:[.'-][A-Za-z0-9]+)*")


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that increases in both places, by piles; pairs come in order of the first."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        if p == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[p], at[p] = j, k
        back.append(at[p - 1] if p else -1)
    run, k = [], at[-1] if at else -1
    while k >= 0:
        run.append(pairs[k])
        k = back[k]
    return run[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing on both sides.

    Ends that match are paired off; between them words that occur once on each side anchor the rest.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        left, right = Counter(a[a0:a1]), Counter(b[b0:b1])
        there = {b[j]: j for j in range(b0, b1) if right[b[j]] == 1}
        anchors = increasing([(i, there[a[i]]) for i in range(a0, a1) if left[a[i]] == 1 and a[i] in there])
        last = (a0, b0)
        for i, j in anchors:
            out.append((i, j))
            todo.append((last[0], i, last[1], j))
            last = (i + 1, j + 1)
        if anchors:
            todo.append((last[0], a1, last[1], b1))
    return sorted(out)


class Scanner:
    """Finds notices of the templates in texts."""

    def __init__(self, templates: dict[str, str] | None = None, cover: float = COVER) -> None:
        self.cover = cover
        self.templates = {k: _words(t) for k, t in sorted((templates or TEMPLATES).items())}
        uses = Counter(w for t in self.templates.values() for w in set(t))
        # at most (1 - cover) of a template may be missing, so of its rarest words one more than that is there
        self.keys = {}
        for k, t in self.templates.items():
            missing = int(len(t) * (1 - cover) + 1e-9)
            self.keys[k] = sorted(range(len(t)), key=lambda i, t=t: (uses[t[i]], -len(t[i]), i))[: missing + 1]
        self.words = {k: frozenset(t) for k, t in self.templates.items()}
        self.any = {self.templates[k][i] for k, at in self.keys.items() for i in at}

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(template, start, end, coverage) of every notice; spans are code points, none of one template overlap."""
        if not isinstance(text, str):
            return []
        low = text.lower()
        if not any(w in low for w in self.any):
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        ws = [text[s:e].lower() for s, e in spans]
        where: dict[str, list[int]] = {}
        for i, w in enumerate(ws):
            if w in self.any:
                where.setdefault(w, []).append(i)
        found = []
        for name, t in self.templates.items():
            if not any(t[i] in where for i in self.keys[name]):
                continue
            # the text's words that the template has; windows count these alone
            own = [i for i, w in enumerate(ws) if w in self.words[name]]
            place = {p: k for k, p in enumerate(own)}
            starts = sorted({max(0, place[p] - i) for i in self.keys[name] for p in where.get(t[i], ())})
            past = 0
            for s in starts:
                if s + len(t) <= past:
                    continue
                lo, hi = max(past, s - len(t) // 4 - 2), min(len(own), s + len(t) + len(t) // 4 + 2)
                pairs = align(t, [ws[i] for i in own[lo:hi]])
                if len(pairs) < self.cover * len(t):
                    continue
                first, last = own[lo + pairs[0][1]], own[lo + pairs[-1][1]]
                if len(pairs) < COMPACT * (last - first + 1):
                    continue
                found.append((name, spans[first][0], spans[last][1], len(pairs) / len(t), len(t)))
                past = lo + pairs[-1][1] + 1
        # of notices that overlap the best covered, then the longest
        out: list[tuple[str, int, int, float]] = []
        for x in sorted(found, key=lambda x: (-x[3], -x[4], x[0], x[1])):
            if all(x[2] <= y[1] or y[2] <= x[1] for y in out):
                out.append(x[:4])
        return sorted(out, key=lambda x: (x[1], -x[3], x[0]))


FOUND = "doc_id string, n_notices int, licenses array<string>, best_license string, best_coverage double, notices array<struct<license:string,start:int,end:int,coverage:double>>"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, cover: float = COVER) -> DataFrame:
    """The notices of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, cover)
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"].tolist(), b["text"].tolist(), strict=True):
                got = scanner.scan(text)
                best = max(got, key=lambda x: (x[3], x[2] - x[1]), default=None)
                rows.append((doc, len(got), sorted({g[0] for g in got}), best and best[0], best and best[3], [dict(zip(("license", "start", "end", "coverage"), g, strict=True)) for g in got]))
            out = pd.DataFrame(rows, columns=["doc_id", "n_notices", "licenses", "best_license", "best_coverage", "notices"])
            yield out.astype({"best_coverage": "Float64"})

    bounded_batches(docs.sparkSession)
    # ids pass through Python as text: pandas would make nullable ones floats
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, FOUND)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_licenses": op4_licenses}
SQL = {}
