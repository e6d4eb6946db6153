"""Licence texts and notices in documents, by patience alignment.

A text and a template are aligned by anchors: words that occur once in both. The longest increasing
subsequence of the anchors' places is kept, and the gaps between them are aligned in the same way, in
which further words have become unique. Coverage is the share of the template's words that are aligned.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")

#: Notices and licence texts as their stewards publish them, without names and years.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-text": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-text": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC0-1.0-short": "Licensed under CC0 1.0.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-text": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version. This library is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE."
    ),
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-text": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE."
    ),
    # Of four words or fewer all have to be there, so these are not taken for each other.
    "BSD": "under the BSD License.",
    "BSD-clause": "under the BSD 3-Clause License.",
    "ISC": "under the ISC License.",
    "All-rights-reserved": "All rights reserved.",
}


def words_of(text: str) -> tuple[list[str], list[int], list[int]]:
    """Words of a text in lower case, the place of their first character and the one after their last."""
    found = list(WORD.finditer(text))
    return [m.group() for m in found], [m.start() for m in found], [m.end() for m in found]


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence."""
    piles: list[int] = []
    tops: list[int] = []
    before = [-1] * len(values)
    for i, value in enumerate(values):
        at = bisect_left(tops, value)
        before[i] = piles[at - 1] if at else -1
        if at == len(piles):
            piles.append(i)
            tops.append(value)
        else:
            piles[at], tops[at] = i, value
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned places (in the text, in the template), ascending in both."""
    out = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        once = {w for w, n in Counter(template[c:d]).items() if n == 1}
        counts = Counter(w for w in text[a:b] if w in once)
        place = {w: i for i, w in enumerate(text[a:b], a) if counts.get(w) == 1}
        pairs = [(place[w], j) for j, w in enumerate(template[c:d], c) if w in place]
        anchors = [pairs[i] for i in increasing([p for p, _ in pairs])]
        if not anchors:
            continue
        out += anchors
        x, y = a, c
        for p, q in [*anchors, (b, d)]:
            todo.append((x, p, y, q))
            x, y = p + 1, q + 1
    return sorted(out)


class Scanner:
    """Finds templates in one text after another."""

    def __init__(self, templates: Mapping[str, str], coverage: float):
        self.coverage = coverage
        self.templates = {name: words_of(text.lower())[0] for name, text in templates.items()}
        self.spare, self.places, self.needed = {}, {}, {}
        for name, words in self.templates.items():
            # With more words missing than these coverage is out of reach.
            self.spare[name] = spare = len(words) - ceil(coverage * len(words))
            self.places[name] = places = {}
            for i, w in enumerate(words):
                places.setdefault(w, []).append(i)
            # So of any words that fill more places than that, one is in the text; long ones are rare.
            self.needed[name], filled = [], 0
            for w in sorted(places, key=lambda w: (-len(w), w)):
                if filled <= spare:
                    self.needed[name].append(w.encode())
                    filled += len(places[w])

    def _starts(self, name: str, at: dict[str, list[int]]) -> list[tuple[int, int]]:
        """Where the template can begin, from every place of its words that are rarest in the text."""
        places, spare = self.places[name], self.spare[name]
        if sum(len(places[w]) for w in places if w in at) < len(self.templates[name]) - spare:
            return []
        filled, starts = 0, set()
        for w in sorted(places, key=lambda w: (len(at.get(w, ())), w)):
            starts |= {p - o for p in at.get(w, ()) for o in places[w]}
            filled += len(places[w])
            if filled > spare:
                break
        merged: list[list[int]] = []
        near = len(self.templates[name]) // 4 + 1
        for start in sorted(starts):
            if merged and start - merged[-1][1] <= near:
                merged[-1][1] = start
            else:
                merged.append([start, start])
        return [(a, b) for a, b in merged]

    def _found(self, name: str, words: list[str], low: int, high: int) -> tuple[int, int, int] | None:
        """Aligned words, first and last word of the template beginning about ``low`` to ``high``: first
        without room around it, which keeps a neighbouring copy out, then with room for further words."""
        template = self.templates[name]
        for room in (0, ceil(len(template) * (1 / self.coverage - 1)) + 1):
            a = max(0, low - room)
            pairs = align(words[a : high + len(template) + room], template)
            if pairs and len(pairs) >= self.coverage * max(len(template), pairs[-1][0] - pairs[0][0] + 1):
                return len(pairs), a + pairs[0][0], a + pairs[-1][0]
        return None

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """(template, first character, character after the last, coverage), in the text's order. Of
        templates that claim the same words the one with most of them aligned stays."""
        low = text.encode().lower()  # A-Z only, so places stay
        names = [name for name, needed in self.needed.items() if any(w in low for w in needed)]
        if not names:
            return []
        words, start, stop = words_of(low.decode())
        wanted = set().union(*(self.templates[name] for name in names))
        at: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in wanted:
                at.setdefault(w, []).append(i)
        found = []
        for name in names:
            for a, b in self._starts(name, at):
                if (hit := self._found(name, words, a, b)) is not None:
                    n, first, last = hit
                    found.append((n * n / (last - first + 1), n / len(self.templates[name]), name, first, last))
        out: list[tuple[str, int, int, float]] = []
        taken: list[tuple[int, int]] = []  # stretches apart from each other, in order
        for _, share, name, first, last in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[3])):
            i = bisect_left(taken, (first, last))
            if (i == 0 or taken[i - 1][1] < first) and (i == len(taken) or taken[i][0] > last):
                taken.insert(i, (first, last))
                out.append((name, start[first], stop[last], share))
        return sorted(out, key=lambda f: (f[1], f[0]))


def scan_licenses(
    docs: DataFrame,
    templates: Mapping[str, str] | None = None,
    coverage: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: id, ``licenses`` (name, start, end, coverage of each occurrence), in the text's order.

    A template is found where at least ``coverage`` of its words are aligned and the aligned words fill
    at least that share of the stretch they span. Null, empty and wordless texts hold none. Rows are
    independent: repeated rows and ids come back as often as they came, an empty table gives no rows,
    other columns are not read. No shuffle; the templates are a parameter of bounded size.
    """
    wanted = dict(TEMPLATES if templates is None else templates)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hit = pa.struct([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])
    schema = T.StructType(
        [
            rows.schema["id"],
            T.StructField(
                "licenses",
                T.ArrayType(
                    T.StructType(
                        [T.StructField("name", T.StringType()), T.StructField("start", T.LongType())]
                        + [T.StructField("end", T.LongType()), T.StructField("coverage", T.DoubleType())]
                    )
                ),
            ),
        ]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(wanted, coverage)
        for batch in batches:
            found = [
                [dict(zip(("name", "start", "end", "coverage"), f)) for f in scanner.scan(t.as_py())]
                for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(hit))], schema.names)

    return rows.mapInArrow(scan, schema).withColumnRenamed("id", id_col)
