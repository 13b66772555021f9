"""License scans: MinHash bands retrieve templates, exact containment verifies.

Every text is cut into overlapping windows of word shingles, one window size
for each size class of the templates. A window's band values are minima of
independent shingle hashes; a template is retrieved when one band agrees, and
reported when the window really holds at least ``containment`` of the
template's shingles.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetlens.llm.common import WordHashes, chunks, map_batches, mixed, texts_of, window_hashes

#: What the notices of BSD-2-Clause and BSD-3-Clause have in common.
BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
       "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
       "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
       "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
       "other materials provided with the distribution.")
#: Notices by license (fixed values, public standard wording).
TEMPLATES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the "
                   "License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the "
                "License, or (at your option) any later version"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Proprietary", "All rights reserved"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the "
                "License, or (at your option) any later version"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License version 2 as published by the Free Software Foundation"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of "
                 "the License, or (at your option) any later version"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation, either version 3 of "
                 "the License, or (at your option) any later version"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Affero General Public License as published by the Free Software Foundation, either version 3 of "
                 "the License, or (at your option) any later version"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSD-2-Clause", BSD),
    ("BSD-3-Clause", BSD + " Neither the name of the copyright holder nor the names of its contributors may be used "
                     "to endorse or promote products derived from this software without specific prior written "
                     "permission"),
    ("BSD-3-Clause", "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
                     "endorse or promote products derived from this software without specific prior written "
                     "permission"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
             "hereby granted"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
                "License v1.0 which accompanies this distribution"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
                "License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
                  "modify, publish, use, compile, sell, or distribute this software, either in source code form or "
                  "as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at "
                "http://mozilla.org/MPL/2.0/"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors "
             "be held liable for any damages arising from the use of this software"),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and "
                "neighboring rights to this software to the public domain worldwide"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 "
                        "International License"),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
)
#: SPDX tags: the identifiers of the notices above; of the GNU licenses the
#: short form, with which the longer ones begin.
TEMPLATES += tuple((name, f"SPDX-License-Identifier: {name}")
                   for name in dict.fromkeys(name for name, _ in TEMPLATES) if name != "Proprietary")
#: A-Z to a-z; ASCII punctuation and controls to blanks; everything else stays.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def folded_words(text: str) -> list[bytes]:
    return fold(text.encode("utf-8", "surrogatepass")).split()


def fold(raw: bytes) -> bytes:
    return raw.translate(FOLD)


class Class:
    """Templates of one size class and their band tables. ``m``: most shingles
    of a template; a window starts every ``stride`` shingles and spans
    ``m + stride - 1``, so that any run of m shingles lies whole in one."""

    def __init__(self, k: int, words: int, items: list[tuple[int, np.ndarray]], containment: float, miss: float):
        self.words, self.m = words, 1 << k
        self.stride = max(1, self.m // 2)
        self.span = self.m + self.stride - 1
        self.items = items
        least = min(len(t) for _, t in items)
        shared = math.ceil(containment * least)
        jaccard = shared / (self.span + least - shared)
        # Bands of one row: a window that holds `shared` shingles is missed
        # with probability (1 - jaccard) ** bands <= miss.
        self.bands = 1 if jaccard >= 1 else math.ceil(math.log(miss) / math.log(1 - jaccard))
        self.tables = []
        for b in range(self.bands):
            v = np.array([permuted(t, b).min() for _, t in items], dtype=np.uint64)
            order = np.argsort(v, kind="stable")
            self.tables.append((v[order], order))


def permuted(h: np.ndarray, band: int) -> np.ndarray:
    return mixed(h ^ np.uint64(0xA0761D6478BD642F * (band + 1) & (2 ** 64 - 1)))


def classes(templates, shingle: int, containment: float, miss: float) -> list[Class]:
    """Size classes: templates shorter than a shingle by their word count, the
    rest by powers of two of their shingle counts."""
    cache, groups = WordHashes(), {}
    for i, (_, text) in enumerate(templates):
        h, _ = cache.of_bytes(fold(text.encode()))
        if len(h):
            width = min(shingle, len(h))
            t = np.unique(window_hashes(h, width))
            k = max(0, math.ceil(math.log2(len(h) - width + 1)))
            groups.setdefault((width, k), []).append((i, t))
    return [Class(k, w, items, containment, miss) for (w, k), items in sorted(groups.items())]


def retrieve(group: list[Class], s: np.ndarray):
    """(class, window start, item) of the windows of which a band agrees;
    ``group``: classes of one shingle width, ``s``: all shingles."""
    n = len(s)
    found: set[tuple[int, int, int]] = set()
    if not n:
        return found
    for b in range(max(c.bands for c in group)):
        p = permuted(s, b)
        for k, cls in enumerate(group):
            if b >= cls.bands:
                continue
            block = np.minimum.reduceat(p, np.arange(0, n, cls.stride)) if cls.stride > 1 else p
            low = block.copy()
            for j in range(1, min(-(-cls.span // cls.stride), len(block))):
                np.minimum(low[:-j], block[j:], out=low[:-j])
            values, order = cls.tables[b]
            at = np.minimum(np.searchsorted(values, low), len(values) - 1)
            for w in np.nonzero(values[at] == low)[0].tolist():
                j = int(at[w])
                while j < len(values) and values[j] == low[w]:
                    found.add((k, w * cls.stride, int(order[j])))
                    j += 1
    return found


def find(h: np.ndarray, starts: np.ndarray, table: list[Class], containment: float):
    """(text, template, first word, end word, containment), for every run of
    overlapping windows the best one. ``h``: word hashes of several texts one
    after the other; ``starts``: where each begins, and the end. A window that
    reaches over several texts is verified in each of them."""
    runs: dict[tuple[int, int], list] = {}
    for width in sorted({c.words for c in table}):
        group = [c for c in table if c.words == width]
        s = window_hashes(h, width)
        for k, start, item in sorted(retrieve(group, s), key=lambda x: (x[1], x[0], x[2])):
            cls = group[k]
            i, t = cls.items[item]
            end = min(len(s), start + cls.span + cls.stride)
            d = int(np.searchsorted(starts, start, side="right")) - 1
            while d < len(starts) - 1 and starts[d] < end:
                a, b = max(start, int(starts[d])), min(end, int(starts[d + 1]) - width + 1)
                if b > a:
                    where = np.nonzero(np.isin(s[a:b], t))[0]
                    held = len(np.unique(s[a:b][where])) / len(t)
                    if held >= containment:
                        base = int(starts[d])
                        span = (a - base + int(where[0]), a - base + int(where[-1]) + width, held)
                        last = runs.setdefault((d, i), [])
                        if last and span[0] < last[-1][1]:
                            last[-1] = max(last[-1], span, key=lambda x: (x[2], -x[0]))
                        else:
                            last.append(span)
                d += 1
    return sorted((d, i, *span) for (d, i), spans in runs.items() for span in spans)


def clearest(hits: list[tuple], names: list[str], sizes: list[int]) -> list[tuple]:
    """The hits without those whose run of words another license's hit shares
    (half of the shorter run) while it holds more shingles of its template, or
    as many and with a higher containment."""
    out, begin = [], 0
    for k in range(1, len(hits) + 1):
        if k < len(hits) and hits[k][0] == hits[begin][0]:
            continue
        rank = [(round(held * sizes[i]), held, names[i], a, b) for _, i, a, b, held in hits[begin:k]]
        by_place = sorted(rank, key=lambda r: r[3])
        longest = max(r[4] - r[3] for r in rank)
        at = [r[3] for r in by_place]
        for hit, (n, held, name, a, b) in zip(hits[begin:k], rank, strict=True):
            beside = by_place[bisect_left(at, a - longest):bisect_left(at, b)]
            if not any((m, other) > (n, held) and who != name and 2 * (min(b, y) - max(a, x)) >= min(b - a, y - x)
                       for m, other, who, x, y in beside):
                out.append(hit)
        begin = k
    return out


def reserved_alone(hits: list[tuple], names: list[str], beside: int) -> list[tuple]:
    """The hits without a reservation of rights that has an open license at most
    ``beside`` words before or after it in its text: there it is part of a
    copyright line and grants or withholds nothing."""
    out, begin = [], 0
    for k in range(1, len(hits) + 1):
        if k < len(hits) and hits[k][0] == hits[begin][0]:
            continue
        open_spans = sorted((a, b) for _, i, a, b, _ in hits[begin:k] if names[i] != "Proprietary")
        starts = [a for a, _ in open_spans]
        longest = max((b - a for a, b in open_spans), default=0)
        for hit in hits[begin:k]:
            _, i, a, b, _ = hit
            near = open_spans[bisect_left(starts, a - beside - longest):bisect_left(starts, b + beside + 1)]
            if names[i] != "Proprietary" or not any(x - b <= beside and a - y <= beside for x, y in near):
                out.append(hit)
        begin = k
    return out


def scan(docs: DataFrame, templates=TEMPLATES, shingle: int = 5, containment: float = 0.8,
         miss: float = 1e-4, beside: int = 50) -> DataFrame:
    """One row per document and license found: (doc_id, license, n_hits,
    containment, first_word, end_word); the words of the best hit, counted over
    the folded text (letters and digits of ASCII, everything beyond ASCII).
    Of licenses that match the same run of words the clearest is reported. Rights
    reserved within ``beside`` words of an open license are not `Proprietary`.

    Defined cases: an empty table gives an empty result; a text of any length is
    scanned whole; null and empty texts have no rows; a null id stays null; a
    repeated row repeats its findings; templates without words are ignored;
    equally good hits: the first; other columns are not read.
    """
    table, names = classes(templates, shingle, containment, miss), [n for n, _ in templates]
    found = {i: len(t) for c in table for i, t in c.items}
    sizes = [found.get(i, 0) for i in range(len(names))]
    pick = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    columns = ("doc_id", "license", "n_hits", "containment", "first_word", "end_word")

    def run(batch):
        cache, rows = WordHashes(), []
        ids = batch.column("doc_id").to_pylist()
        for begin, texts in chunks(texts_of(batch), fold):
            h, starts = cache.of_texts(texts)
            best: dict[tuple[int, str], list] = {}
            clear = clearest(find(h, starts, table, containment), names, sizes)
            for d, i, a, b, held in reserved_alone(clear, names, beside):
                hit = best.setdefault((d, names[i]), [0, 0.0, 0, 0])
                hit[0] += 1
                if (held, -a) > (hit[1], -hit[2]):
                    hit[1:] = [held, a, b]
            rows += [(ids[begin + d], name, *hit) for (d, name), hit in sorted(best.items())]
        return dict(zip(columns, zip(*rows, strict=True) if rows else [()] * 6, strict=True))

    return map_batches(pick, run, "doc_id long, license string, n_hits long, containment double, "
                       "first_word long, end_word long")
