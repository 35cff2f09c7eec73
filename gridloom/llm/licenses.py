"""License notices found by winnowed fingerprints and banded alignment.

Templates are words; of every ``WINDOW`` consecutive word triples the one with the smallest
hash is a fingerprint, so that a shared run of TRIPLE + WINDOW - 1 words always shares one.
An inverted index from fingerprints to template positions names the candidates in a document:
a template and where it would begin. A local alignment in a narrow band around that place
then gives the matched words, the share of the template they cover and the span of the text.

Licenses often differ in a word or a clause. Where one template would pass for another, the words
it does not share with that one tell them apart, and a match must hold them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.text import Words, plain_words, sequences, slices

TRIPLE = 3
WINDOW = 2
BAND = 8  # words a match may drift against the template
MIN_COVERAGE = 0.8
TELLING = 0.8  # share of the words that tell a template from a similar one a match must hold

# Texts and notices by which files state their license, with SPDX identifiers. Short
# licenses are there whole (their grant and conditions), long ones by the notices put into files.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
    'software and associated documentation files (the "Software"), to deal in the Software '
    "without restriction"
)
_MIT_RIGHTS = (
    ", including without limitation the rights to use, copy, modify, merge, publish, distribute, "
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
    "furnished to do so"
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are "
    "permitted provided that the following conditions are met"
)
_BSD_CONDITIONS = (
    ": 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to "
    "endorse or promote products derived from this software without specific prior written permission."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
    "without fee is hereby granted"
)
_GNU = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the "
    "GNU {kind} as published by the Free Software Foundation, {version}."
)
_LATER = "either version {} of the License, or (at your option) any later version"
_CC = "This work is licensed under a Creative Commons {} License."


def _gnu(kind: str, version: str, what: str = "program") -> str:
    return _GNU.format(kind=kind, version=version, what=what)


TEMPLATES = {
    "0BSD": [_ISC + "."],
    "AGPL-3.0-only": [_gnu("Affero General Public License", "version 3 of the License")],
    "AGPL-3.0-or-later": [_gnu("Affero General Public License", _LATER.format("3"))],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License.",
    ],
    "Artistic-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of "
        "the Artistic License 2.0."
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", _BSD + _BSD_CONDITIONS],
    "BSD-3-Clause": [_BSD, "Licensed under the BSD 3-Clause License.", f"{_BSD}{_BSD_CONDITIONS} 3.{_BSD_NAMES}"],
    "BSD-4-Clause": [
        f"{_BSD}{_BSD_CONDITIONS} 3. All advertising materials mentioning features or use of this "
        "software must display the following acknowledgement: This product includes software developed "
        f"by the organization. 4.{_BSD_NAMES}"
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of "
        'the software and accompanying documentation covered by this license (the "Software") to use, '
        "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative "
        "works of the Software, and to permit third-parties to whom the Software is furnished to do so, "
        "all subject to the following",
    ],
    "CC-BY-3.0": ["Licensed under CC BY 3.0.", _CC.format("Attribution 3.0 Unported")],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", _CC.format("Attribution 4.0 International")],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", _CC.format("Attribution-NonCommercial 4.0 International")],
    "CC-BY-NC-ND-4.0": [
        "Licensed under CC BY-NC-ND 4.0.",
        _CC.format("Attribution-NonCommercial-NoDerivatives 4.0 International"),
    ],
    "CC-BY-NC-SA-4.0": [
        "Licensed under CC BY-NC-SA 4.0.",
        _CC.format("Attribution-NonCommercial-ShareAlike 4.0 International"),
    ],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", _CC.format("Attribution-NoDerivatives 4.0 International")],
    "CC-BY-SA-3.0": ["Licensed under CC BY-SA 3.0.", _CC.format("Attribution-ShareAlike 3.0 Unported")],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", _CC.format("Attribution-ShareAlike 4.0 International")],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights"],
    "CDDL-1.0": [
        "The contents of this file are subject to the terms of the Common Development and Distribution "
        'License (the "License"). You may not use this file except in compliance with the License.'
    ],
    "EPL-1.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse "
        "Public License v1.0 which accompanies this distribution"
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse "
        "Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"
    ],
    "GPL-2.0-only": [
        "This work is licensed under the GNU General Public License, version 2.",
        _gnu("General Public License", "version 2 of the License"),
    ],
    "GPL-2.0-or-later": [_gnu("General Public License", _LATER.format("2"))],
    "GPL-3.0-only": [
        "This work is licensed under the GNU General Public License, version 3.",
        _gnu("General Public License", "version 3 of the License"),
    ],
    "GPL-3.0-or-later": [_gnu("General Public License", _LATER.format("3"))],
    "ISC": [_ISC + ", provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.0-or-later": [_gnu("Library General Public License", _LATER.format("2"), "library")],
    "LGPL-2.1-or-later": [_gnu("Lesser General Public License", _LATER.format("2.1"), "library")],
    "LGPL-3.0-or-later": [_gnu("Lesser General Public License", _LATER.format("3"))],
    "MIT": [
        "Released under the MIT License.",
        _MIT,
        _MIT + _MIT_RIGHTS + ", subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MIT-0": [_MIT + _MIT_RIGHTS + "."],
    "MPL-1.1": [
        'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); '
        "you may not use this file except in compliance with the License."
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "PSF-2.0": [
        'This LICENSE AGREEMENT is between the Python Software Foundation ("PSF"), and the Individual or '
        'Organization ("Licensee") accessing and otherwise using this software ("Python") in source or '
        "binary form and its associated documentation."
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
        "modify, publish, use, compile, sell, or distribute this software, either in source code form or "
        "as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ],
    "WTFPL": [
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license "
        "document, and changing it is allowed as long as the name is changed."
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the "
        "authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions"
    ],
}

_FOUND = "license string, template int, coverage double, matched long, start long, end long, excerpt string"


def fingerprints(hashes: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and hashes of the winnowed triples of each text."""
    grams = sequences(hashes, TRIPLE)
    if not len(grams):
        return np.zeros(0, np.int64), grams
    inside = words.doc[: len(grams)] == words.doc[TRIPLE - 1 :]
    at = np.flatnonzero(inside)
    grams, doc = grams[at], words.doc[at]
    if not len(at):
        return at, grams
    chosen = np.zeros(len(at), bool)
    starts = np.arange(len(at))
    best = starts.copy()
    for k in range(1, WINDOW):
        other = np.minimum(starts + k, len(at) - 1)
        same = doc[other] == doc
        better = same & (starts + k < len(at)) & (grams[other] <= grams[best])
        best = np.where(better, other, best)
    # A window that a text's end cuts short counts only if the text has no whole one.
    last = np.minimum(starts + WINDOW - 1, len(at) - 1)
    whole = (starts + WINDOW - 1 < len(at)) & (doc[last] == doc)
    first = np.append(True, doc[1:] != doc[:-1])
    chosen[best[whole | first]] = True
    return at[chosen], grams[chosen]


class Index:
    """Templates and the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, list[str]]):
        self.names = [(name, i) for name, texts in templates.items() for i in range(len(texts))]
        found = plain_words(pa.array([t for texts in templates.values() for t in texts], pa.string()))
        hashes = found.hashes()
        self.words = [hashes[a:b] for a, b in zip(found.first[:-1], found.first[1:])]
        at, grams = fingerprints(hashes, found)
        order = np.argsort(grams, kind="stable")
        self.keys, at = grams[order], at[order]
        self.template = found.doc[at]
        self.place = at - found.first[self.template]
        self.present = np.zeros(1 << 16, bool)
        self.present[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.telling = self._telling(hashes, found)

    def _telling(self, hashes: np.ndarray, found: Words) -> list[list[np.ndarray]]:
        """Of each template and each it would pass for, the places of the words only it has."""
        telling: list[list[np.ndarray]] = [[] for _ in self.names]
        for other, mine, begin in self.candidates(hashes, found):
            words = self.words[mine]
            if self.names[other][0] != self.names[mine][0]:
                kept = matched_places(words, self.words[other])
                if MIN_COVERAGE * len(words) <= len(kept) < len(words):
                    telling[mine].append(np.setdiff1d(np.arange(len(words)), kept))
        return telling

    def told_apart(self, template: int, text: np.ndarray, begin: int, matched: int) -> bool:
        """Whether a match holds the words that tell its template from each similar one."""
        words = self.words[template]
        for places in self.telling[template]:
            rest = align(np.delete(words, places), text, begin)[0]
            if matched - rest < TELLING * len(places):
                return False
        return True

    def candidates(self, hashes: np.ndarray, words: Words):
        """(text, template, first word) for each place where a template may begin."""
        at, grams = fingerprints(hashes, words)
        maybe = self.present[(grams & np.uint64(0xFFFF)).astype(np.int64)]
        at, grams = at[maybe], grams[maybe]
        low = np.searchsorted(self.keys, grams, "left")
        high = np.searchsorted(self.keys, grams, "right")
        many = high - low
        hit = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = np.repeat(at, many)
        doc, template = words.doc[at], self.template[hit]
        begin = at - words.first[doc] - self.place[hit]
        order = np.lexsort((begin, template, doc))
        last = (-1, -1, 0)
        for i in order.tolist():
            here = (int(doc[i]), int(template[i]), int(begin[i]))
            # Places less than a band apart are one candidate.
            if here[:2] != last[:2] or here[2] > last[2] + BAND:
                last = here
                yield here


def matched_places(template: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Places of the template's words in a longest common subsequence with ``text``."""
    size = np.zeros((len(template) + 1, len(text) + 1), np.int64)
    for i, word in enumerate(template):
        step = np.where(text == word, size[i, :-1] + 1, 0)
        size[i + 1, 1:] = np.maximum.accumulate(np.maximum(size[i, 1:], step))
    places, i, j = [], len(template), len(text)
    while i and j:
        if size[i, j] == size[i - 1, j]:
            i -= 1
        elif size[i, j] == size[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            places.append(i)
    return np.array(places[::-1], np.int64)


def align(template: np.ndarray, text: np.ndarray, begin: int) -> tuple[int, int, int]:
    """Matched words and the span of the best alignment near ``begin``.

    The longest common subsequence of the template and the text, along the diagonals within
    BAND of the one that starts at ``begin``; of equally long ones the shortest span.
    """
    low = max(0, begin - BAND)
    high = min(len(text), begin + len(template) + BAND)
    none = (0, 0, 0)
    # Best (matches, -first, -last) over the template so far, per text position; in the band.
    before: dict[int, tuple[int, int, int]] = {}
    for i, word in enumerate(template.tolist()):
        now: dict[int, tuple[int, int, int]] = {}
        for j in range(max(low, begin + i - BAND), min(high, begin + i + BAND + 1)):
            options = [before.get(j, none), now.get(j - 1, none)]
            if int(text[j]) == word:
                n, first, _ = before.get(j - 1, none)
                options.append((n + 1, first if n else -j, -j))
            now[j] = max(options, key=_better)
        before = now
    n, first, last = max(before.values(), key=_better, default=none)
    return (n, -first, -last + 1) if n else none


def _better(state: tuple[int, int, int]) -> tuple[int, int, int]:
    """Order of alignment states (matches, -first, -last): long, then short span, then early."""
    n, first, last = state
    return (n, last - first, first) if n else (0, 0, 0)


def find_licenses(
    documents: DataFrame,
    templates: dict[str, list[str]] | None = None,
    min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """One row per notice found: doc_id, license, template, coverage, matched, start, end, excerpt.

    ``start`` and ``end`` count words of the whole text. A place is reported once, as the
    template with the most matched words there, then the highest coverage, then the first
    name; templates whose telling words are missing do not count. NULL, empty and unrelated texts give no row; rows that repeat an id are searched
    each. Nothing is shuffled; the index goes out with the tasks and holds the templates only.
    """
    index = Index(TEMPLATES if templates is None else templates)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                found = plain_words(piece.column("text"))
                rows = list(_notices(index, found, min_coverage))
                columns = [list(c) for c in zip(*rows)] if rows else [[]] * 8
                doc, *columns = columns
                types = [pa.string(), pa.int32(), pa.float64(), *[pa.int64()] * 3, pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").take(pa.array(doc, pa.int64()))]
                    + [pa.array(c, t) for c, t in zip(columns, types)],
                    names=["doc_id", *[f.split()[0] for f in _FOUND.split(", ")]],
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(search, f"doc_id {kind}, {_FOUND}")


def _notices(index: Index, found: Words, min_coverage: float):
    hashes = found.hashes()
    by_doc: dict[int, list[tuple]] = {}
    for doc, template, begin in index.candidates(hashes, found):
        words = index.words[template]
        text = hashes[found.first[doc] : found.first[doc + 1]]
        n, start, end = align(words, text, begin)
        if n and n >= min_coverage * len(words) and index.told_apart(template, text, begin, n):
            name, number = index.names[template]
            by_doc.setdefault(doc, []).append((-n, -n / len(words), name, number, start, end))
    for doc, notices in sorted(by_doc.items()):
        taken: list[tuple[int, int]] = []
        for n, cover, name, number, start, end in sorted(notices):
            if all(end <= a or start >= b for a, b in taken):
                taken.append((start, end))
                a = found.first[doc]
                excerpt = found.data[found.start[a + start] : found.end[a + end - 1]].tobytes()
                yield doc, name, number, -cover, -n, start, end, excerpt.decode("utf-8", "replace")
