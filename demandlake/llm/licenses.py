"""License scans: MinHash bands over overlapping text windows retrieve templates, then exact
shingle containment verifies them.

Texts and templates are words (runs of letters and digits, lower case) and their 5-word
shingles (a template of fewer words is one shingle). Templates are grouped by their
number of shingles; a group of at most T shingles is looked for in windows of 2 T
shingles, one starting every T, so every run of T shingles lies whole within a window. Each of
``BANDS`` bands is one minimum over a window: with T at most 1.5 times a template's shingles,
a window that holds the whole template has Jaccard similarity 1/3 or more and misses all
bands with probability (2/3) ** 48 < 1e-8; one that holds 0.8 of it, (3/4) ** 48 < 1e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.llm import textarrays as ta
from demandlake.llm.decontam import Lookup
from demandlake.llm.shared import read_table

SHINGLE = 5
BANDS = 48
GROWTH = 1.5
MIN_CONTAINMENT = 0.8
#: Templates are broadcast: their words together are bounded.
MAX_TEMPLATE_WORDS = 500_000

# FIXED VALUES: public license notices, as their publishers word them
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution."),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

SCHEMA = "doc_id bigint, license string, containment double, from_word int, to_word int"


class Index:
    """Band tables of the templates: for each group (shingle words, T) and band the
    minimum of every template."""

    def __init__(self, templates: dict[str, str]):
        self.names, self.shingles, self.sizes, groups = [], [], [], {}
        total = 0
        for name in sorted(templates):
            words = next(ta.word_chunks(ta.normalized(pa.array([templates[name]])))).hash
            total += len(words)
            if len(words):
                n = min(SHINGLE, len(words))
                shingles = np.unique(ta.grams(words, n))
                reach = 1
                while reach < len(words) - n + 1:
                    reach = max(reach + 1, int(reach * GROWTH))
                groups.setdefault((n, reach), []).append(len(self.names))
                self.names.append(name)
                self.shingles.append(shingles)
                self.sizes.append(n)
        if total > MAX_TEMPLATE_WORDS:
            raise ValueError("too many template words for one scan: scan in blocks of templates")
        #: odd multipliers order the shingle hashes anew for each band
        self.factors = np.random.default_rng(11).integers(1, 2**62, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.groups = {}
        for (n, reach), members in groups.items():
            tables = []
            for f in self.factors:
                low = np.array([(self.shingles[k] * f).min() for k in members], np.uint64)
                keys = np.unique(low)
                tables.append((Lookup(keys), [[members[i] for i in np.flatnonzero(low == key)] for key in keys]))
            self.groups.setdefault(n, []).append((reach, tables))

    def scan(self, w: ta.Words) -> list[tuple[int, int, float, int, int]]:
        """(document, template, containment, first word, end word) of the verified templates of a chunk."""
        found: dict[tuple[int, int], set[int]] = {}
        for n, groups in self.groups.items():
            g, at = ta.gram_rows(w, n)
            if not len(g):
                continue
            doc = np.searchsorted(w.bounds, at, "right") - 1
            first = np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1))  # first shingle of each document that has one
            place = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
            blocks = [(reach, np.flatnonzero(place % reach == 0)) for reach, _ in groups]
            for band, factor in enumerate(self.factors):
                v = g * factor
                for (reach, starts), (_, tables) in zip(blocks, groups, strict=True):
                    if reach == 1:  # windows of one shingle: one band finds all that are equal
                        if band:
                            continue
                        low = v
                    else:  # a window is a block and the next one of the same document
                        low = np.minimum.reduceat(v, starts)
                        same = np.flatnonzero(doc[starts[1:]] == doc[starts[:-1]])
                        low[same] = np.minimum(low[same], low[same + 1])
                    lookup, owners = tables[band]
                    hit, slot = lookup.find(low)
                    for x, s in zip(starts[hit].tolist(), slot.tolist(), strict=True):
                        for k in owners[s]:
                            found.setdefault((int(doc[x]), k), set()).add(int(at[x]))
        return [x for (d, k), starts in sorted(found.items()) for x in self._verify(w, d, k, sorted(starts))]

    def _verify(self, w: ta.Words, d: int, k: int, starts: list[int]) -> Iterator[tuple[int, int, float, int, int]]:
        """Exact containment around each window; of overlapping finds of one template the best, then the first."""
        want, n = self.shingles[k], self.sizes[k]
        lo, hi = int(w.bounds[d]), int(w.bounds[d + 1])
        reach = 2 * max(1, int(len(want) * GROWTH)) + 2
        spans = []
        for s in starts:
            a, b = max(lo, s - reach), min(hi, s + 2 * reach + n)
            spans.append((a, b) if not spans or a >= spans[-1][1] else (spans.pop()[0], b))
        for a, b in spans:
            g = ta.grams(w.hash[a:b], n)
            inside = np.flatnonzero(np.isin(g, want))
            best, upto = None, -1
            for i in inside:  # runs of template shingles no longer than the template with room for edits
                run = inside[slice(*np.searchsorted(inside, (i, i + int(len(want) * 1.25) + 1)))]
                share = len(np.unique(g[run])) / len(want)
                if share >= MIN_CONTAINMENT:
                    x, y = a + int(i) - lo, a + int(run[-1]) + n - lo
                    if best is None or x >= upto:
                        if best:
                            yield d, k, *best
                        best, upto = (share, x, y), y
                    elif share > best[0]:
                        best, upto = (share, x, y), y
            if best:
                yield d, k, *best


def template_blocks(templates: dict[str, str], most: int | None = None) -> list[dict[str, str]]:
    """The templates in blocks of at most ``most`` words (``MAX_TEMPLATE_WORDS``), one larger template alone."""
    most = most or MAX_TEMPLATE_WORDS
    blocks, room = [], 0
    for name in sorted(templates):
        n = sum(len(w.hash) for w in ta.word_chunks(ta.normalized(pa.array([templates[name]]))))
        if not blocks or n > room:
            blocks.append({})
            room = most
        blocks[-1][name] = templates[name]
        room -= n
    return blocks


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per document and place of a license: doc_id, license, containment (share of the template's shingles,
    at least ``MIN_CONTAINMENT``), from_word, to_word.

    Templates are broadcast in blocks of at most ``MAX_TEMPLATE_WORDS`` words, and the documents are scanned once for
    each block. Null and empty texts have none, as have null templates and those without words; repeated documents each
    give rows; very long texts are gone through whole; null ids are carried; an empty table or no templates give no
    rows; extra columns, whatever their names, are ignored."""
    templates = {k: t for k, t in (TEMPLATES if templates is None else templates).items() if t is not None}
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    blocks = template_blocks(templates)
    for i, block in enumerate(blocks):
        found = _scan(docs, Index(block), id_col, text_col)
        out = out.union(found) if i else found
    return out


def _scan(docs: DataFrame, index: Index, id_col: str, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            out = []
            for w in ta.word_chunks(ta.normalized(batch.column(1))):
                out += [(batch.column(0)[w.first + d].as_py(), index.names[k], share, x, y)
                        for d, k, share, x, y in index.scan(w)]
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)],
                [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))
