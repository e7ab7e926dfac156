"""License scans: Dice coefficient over word bigrams between runs of lines and licence templates.

Text and templates are normalised (A-Z in lower case, words of letters and digits). A
match is a run of consecutive lines whose set of word bigrams has
``2 * common >= dice * (own + template's)``. Size bounds prune: a template of m bigrams
needs between ``dice * m / (2 - dice)`` and ``(2 - dice) * m / dice``; and a running count
of positions that hold one of its bigrams bounds what a run can have in common.

All matches of a document are returned that do not overlap: the best run of lines first (highest coefficient,
then the earlier, the shorter, the licence named first), then the best that shares no line with it, and so on.
Notices inside longer lines: windows of words over the whole text, outside the runs found, are compared and chosen in
the same way; a window begins and ends with a bigram of the template, and holds its first bigram once. Documents are
independent: nothing is shuffled.

Defined results: null, empty or wordless text: no match. Lines without words add
nothing to a run and do not break it, but no run begins or ends with one. Repeated rows keep
their rows. Empty table: no rows. Other columns are ignored.
"""

import heapq
import itertools
from bisect import bisect_right, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from volpanel.llm.common import LOWER, binaries, per_batch

_WORD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in LOWER)
#: Notices by licence (fixed values).
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "MIT": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def words(b: bytes) -> list[bytes]:
    return b.translate(_WORD).split()


class Templates:
    """Templates as sets of bigram codes over word numbers (0: a word of no template)."""

    def __init__(self, texts: dict[str, list[str]], dice: float):
        self.number: dict[bytes, int] = {}
        self.names, sets = [], []
        listed = [(name, [self.number.setdefault(w, len(self.number) + 1) for w in words(t.encode())]) for name, ts in texts.items() for t in ts]
        self.base = len(self.number) + 1
        for name, n in listed:
            self.names.append(name)
            sets.append(np.unique(np.array(n[:-1], np.int64) * self.base + np.array(n[1:], np.int64)))
        self.sets, self.dice = sets, dice
        self.all = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
        # least and most distinct bigrams of a matching run
        self.low = [int(np.ceil(dice * len(s) / (2 - dice) - 1e-9)) for s in sets]
        self.high = [int((2 - dice) * len(s) / dice + 1e-9) for s in sets]

    def scan(self, b: bytes) -> list[tuple[str, float, int, int]]:
        """(licence, coefficient, first line, last line) of every match; lines from 0."""
        lines = [(k, w) for k, line in enumerate(b.split(b"\n")) if (w := words(line))]
        if not lines:
            return []
        flat = [x for _, w in lines for x in w]
        get = self.number.get
        n = np.fromiter((get(x, 0) for x in flat), np.int64, len(flat))
        code = n[:-1] * self.base + n[1:]
        known = (n[:-1] > 0) & (n[1:] > 0)
        hits = np.flatnonzero(known)
        hits = hits[np.isin(code[hits], self.all)]
        if not len(hits):
            return []
        stop = np.cumsum([len(w) for _, w in lines])
        start = stop - [len(w) for _, w in lines]
        ids = None
        found: list[tuple] = []
        for name, s, low, high in zip(self.names, self.sets, self.low, self.high, strict=True):
            at = hits[np.isin(code[hits], s)]
            if len(np.unique(code[at])) < self.dice * (len(s) + low) / 2:
                continue
            count = np.searchsorted(at, np.arange(len(flat) + 1))
            if ids is None:  # unknown words differ from all others, but equal ones are equal
                _, ids = np.unique(np.array(flat, dtype=object), return_inverse=True)
            for i in range(len(lines)):
                for j in range(i, len(lines)):
                    a, z = start[i], stop[j]
                    common = count[max(z - 1, a)] - count[a]
                    if z - a - 1 < low or 2 * common < self.dice * (len(s) + low):
                        if len(at) and a > at[-1]:
                            break
                        if z - a - 1 < low:
                            continue
                    own = len(np.unique(ids[a:z - 1].astype(np.int64) * len(flat) + ids[a + 1:z]))
                    if own > high:
                        break  # longer runs have no fewer bigrams
                    if own < low or 2 * common < self.dice * (len(s) + own):
                        continue
                    value = 2 * len(np.unique(code[at[(at >= a) & (at < z - 1)]])) / (len(s) + own)
                    if value >= self.dice:
                        found.append((-value, i, j, name))
        out, taken = [], []
        for v, i, j, name in sorted(found):  # lines that match several times count for the best
            a, z = int(start[i]), int(stop[j])
            if _free(taken, a, z):
                insort(taken, (a, z))
                out.append((name, -v, lines[i][0], lines[j][0]))
        if ids is None:
            return out
        line_of = np.repeat([k for k, _ in lines], stop - start)
        own = (ids[:-1].astype(np.int64) * len(flat) + ids[1:]).tolist()
        heap = []
        for name, s, low, high in zip(self.names, self.sets, self.low, self.high, strict=True):
            at = hits[np.isin(code[hits], s)]
            need = self.dice * (len(s) + low) / 2
            if len(np.unique(code[at])) < need:
                continue
            inside = set(at.tolist())
            for p in at.tolist():
                if w := self.window(p, own, inside, len(s), high, taken):
                    heap.append((*w, name, inside, len(s), high))
        order = itertools.count()  # never compare the sets
        heap = [(*x[:4], next(order), x) for x in heap]
        heapq.heapify(heap)
        while heap:
            v, a, z, name, _, x = heapq.heappop(heap)
            if _free(taken, a, z):
                insort(taken, (a, z))
                out.append((name, -v, int(line_of[a]), int(line_of[z - 1])))
            elif w := self.window(a, own, *x[4:], taken):  # what is left of it scores less
                heapq.heappush(heap, (*w, name, next(order), (*w, name, *x[4:])))
        return sorted(out)

    def window(self, p: int, own: list[int], inside: set[int], size: int, high: int, taken: list[tuple[int, int]]) -> tuple | None:
        """(-coefficient, first word, end) of the best window of words from bigram ``p`` on that shares no word
        with ``taken``, for a template of ``size`` bigrams, which lie at ``inside``."""
        k = bisect_right(taken, (p, len(own) + 2))
        if k and taken[k - 1][1] > p:
            return None
        end = (taken[k][0] if k < len(taken) else len(own) + 1) - 1  # the last bigram ends before the next run
        best, seen, common = None, set(), 0
        for q in range(p, end):
            if q > p and own[q] == own[p]:
                break
            if own[q] not in seen:
                seen.add(own[q])
                if len(seen) > high:
                    break
                if q in inside:
                    common += 1
                    value = 2 * common / (size + len(seen))
                    if value >= self.dice:
                        new = (-value, p, q + 2)
                        best = min(best or new, new)
        return best


def _free(taken: list[tuple[int, int]], a: int, z: int) -> bool:
    """Whether [a, z) shares nothing with the sorted, disjoint ranges ``taken``."""
    k = bisect_right(taken, (a, z))
    return (not k or taken[k - 1][1] <= a) and (k == len(taken) or taken[k][0] >= z)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, list[str]] = TEMPLATES, dice: float = 0.8) -> DataFrame:
    """One row per match, as a document may hold a licence several times: ``key``, ``license``, ``dice``, ``first_line``, ``last_line``."""
    found = docs.sparkSession.sparkContext.broadcast(Templates(templates, dice))  # as large as the template parameter
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("license", T.StringType()), T.StructField("dice", T.DoubleType()),
                           T.StructField("first_line", T.LongType()), T.StructField("last_line", T.LongType())])

    def run(batch):
        rows = [(k, *m) for k, b in zip(batch.column(0).to_pylist(), binaries(batch.column(1)), strict=True) for m in found.value.scan(b or b"")]
        if rows:
            yield dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True))

    return per_batch(docs.select(key, text), run, schema)
