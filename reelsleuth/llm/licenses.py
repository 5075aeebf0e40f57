"""License scans: winnowed fingerprints pick candidate templates, banded alignment reports coverage and spans."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a fingerprint, and fingerprints of which the least is kept: any GRAM + KEEP - 1 shared words share one.
GRAM, KEEP = 3, 2
#: Diagonals searched on each side of a candidate's own; and the share of a template that a match must cover.
BAND, LEAST_COVERAGE = 12, 0.8
#: The number of a word that a match holds; unknown words are 0.
TAKEN = -1
#: Share of a template's kept fingerprints that a candidate needs.
LEAST_VOTES = 0.25

# Notices by which licenses are granted, by SPDX identifier.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
}
WORD = re.compile(r"[^\W_]+")


class Index:
    """Templates as word numbers, and where their kept fingerprints occur."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES) -> None:
        self.names, self.words, self.number = [], [], {}
        for name, texts in templates.items():
            for i, text in enumerate(texts):
                self.names.append((name, i))
                self.words.append(np.array([self.number.setdefault(w, len(self.number) + 1) for w in WORD.findall(text.lower())], np.int64))
        self.places, self.kept, self.seen = defaultdict(list), [], None
        for t, words in enumerate(self.words):
            at, grams = self.winnowed(words)
            self.kept.append(len(at))
            for a, g in zip(at.tolist(), grams.tolist()):
                self.places[g].append((t, a))
        self.keys = np.array(sorted(self.places), np.int64)
        base = len(self.number) + 1
        self.seen = {int((w[i] * base + w[i + 1]) * base + w[i + 2]) for w in self.words for i in range(len(w) - 2)}

    def winnowed(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, fingerprint): of each KEEP neighbouring ones the least, the right one of equals. Unknown words make none."""
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(words) < GRAM:
            return nothing
        base = len(self.number) + 1
        code = np.zeros(len(words) - GRAM + 1, np.int64)
        known = np.ones(len(code), bool)
        for k in range(GRAM):
            known &= words[k : len(code) + k] > 0
        if not known.any():
            return nothing
        for k in range(GRAM):
            code = code * base + words[k : len(code) + k]
        if self.seen is not None and self.seen.isdisjoint(code[known].tolist()):
            return nothing  # it shares no word run with any template
        # An odd multiplier mixes the codes, so that the least isn't that of the words first numbered.
        mixed = np.where(known, (code * np.int64(0x5851F42D4C957F2D)) & np.int64(0x7FFFFFFFFFFFFFFF), np.iinfo(np.int64).max)
        if len(mixed) < KEEP:
            at = np.arange(len(mixed))
        else:
            views = np.lib.stride_tricks.sliding_window_view(mixed, KEEP)[:, ::-1]
            at = np.unique(np.arange(len(views)) + KEEP - 1 - views.argmin(axis=1))
        at = at[known[at]]
        return at, mixed[at]

    def candidates(self, words: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(template, sorted (diagonal, place in the template) of its hits): clusters of shared fingerprints with near diagonals and votes enough."""
        at, grams = self.winnowed(words)
        hit = np.isin(grams, self.keys)
        by_template = defaultdict(list)
        for a, g in zip(at[hit].tolist(), grams[hit].tolist()):
            for t, p in self.places[g]:
                by_template[t].append((a - p, p))
        for t, found in sorted(by_template.items()):
            found.sort()
            group: list = []
            for d, p in [*found, (None, 0)]:
                if group and (d is None or d - group[-1][0] > BAND):
                    if len({x[1] for x in group}) >= max(1, LEAST_VOTES * self.kept[t]):
                        yield t, group
                    group = []
                if d is not None:
                    group.append((d, p))


def align(template: np.ndarray, words: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(equal words, first, last) of the best alignment of the template with words near a diagonal.

    Equal words score 2, others and gaps -1; the template may begin and end anywhere. Only cells within `band`
    of the diagonal are filled. Of equal scores the earliest end wins. No alignment goes through a word TAKEN.
    """
    width = 2 * band + 1
    none = (0, 0, -1, -1)  # score, equal, first, last
    row, best = [none] * width, none
    for i in range(len(template)):
        now = []
        for k in range(width):
            j = i + diagonal + k - band
            cell = none
            if 0 <= j < len(words) and words[j] != TAKEN:
                diag = row[k]
                if template[i] == words[j]:
                    cell = (diag[0] + 2, diag[1] + 1, diag[2] if diag[0] > 0 else j, j)
                elif diag[0] > 1:
                    cell = (diag[0] - 1, *diag[1:])
                for near in (row[k + 1] if k + 1 < width else none, now[k - 1] if k else none):
                    if near[0] - 1 > cell[0]:
                        cell = (near[0] - 1, *near[1:])
                if cell[0] > best[0]:
                    best = cell
            now.append(cell)
        row = now
    return best[1], best[2], best[3]


def matches_of(template: np.ndarray, words: np.ndarray, hits: list[tuple[int, int]], least: float) -> list[tuple[int, int, int]]:
    """align() of each match that a cluster of hits holds: along the median diagonal, then along all others.

    A cluster may hold many copies, or parts of some and one whole. The words of each match are taken, so that the next one
    is found beside it; a diagonal whose hits all lie in matches is done.
    """
    words, found = words.copy(), []
    places = defaultdict(list)
    for d, p in hits:
        places[d].append(d + p)
    for d in [hits[len(hits) // 2][0], *sorted(places)]:
        at = places.pop(d, [])
        while any(words[a] != TAKEN for a in at):
            equal, first, last = align(template, words, d)
            if not equal or equal / len(template) < least:
                break
            found.append((equal, first, last))
            words[first : last + 1] = TAKEN
    return found


def scan_text(text: str | None, index: Index, least: float = LEAST_COVERAGE) -> list[tuple[str, int, int, int, float, int, int]]:
    """(license, template, equal words, template words, coverage, start, end) of each match, by start.

    Of matches that overlap, the one with more equal words stays, then the greater coverage, then the earlier template.
    """
    lower = (text or "").lower()
    if len(lower) != len(text or ""):  # a few letters grow when lowered; places must stay those of the text
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found = WORD.findall(lower)
    number = index.number
    words = np.array([number.get(w, 0) for w in found], np.int64)
    if np.count_nonzero(words) < GRAM:
        return []
    matches = []
    for t, hits in index.candidates(words):
        for equal, first, last in matches_of(index.words[t], words, hits, least):
            matches.append((-equal, -equal / len(index.words[t]), t, first, last))
    if not matches:
        return []
    spans = [(m.start(), m.end()) for m in WORD.finditer(lower)]
    out, taken = [], []
    for equal, coverage, t, first, last in sorted(matches):
        if all(last < a or first > b for a, b in taken):
            taken.append((first, last))
            name, i = index.names[t]
            out.append((name, i, -equal, len(index.words[t]), -coverage, spans[first][0], spans[last][1]))
    return sorted(out, key=lambda x: x[5])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST_COVERAGE) -> DataFrame:
    """(doc_id, license, template, equal_words, template_words, coverage, start, end), one row a match.

    template numbers the license's notices; start and end are code points, the end exclusive. Null and empty texts
    match nothing. Repeated rows give their matches again; a null doc_id like others; an empty table gives no rows;
    other columns are ignored. The index follows the templates alone.
    """
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(templates)
        for batch in batches:
            rows = [(i, *m) for i, t in zip(batch["id"], batch["text"]) for m in scan_text(t, index, least)]
            yield pd.DataFrame(rows, columns=["id", "license", "template", "equal_words", "template_words", "coverage", "start", "end"])

    own = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    found = own.mapInPandas(scan, "id string, license string, template long, equal_words long, template_words long, coverage double, start long, end long")
    return found.withColumn("doc_id", F.col("id").cast("long")).select("doc_id", *found.columns[1:])
