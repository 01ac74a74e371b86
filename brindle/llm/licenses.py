"""License scans: candidate blocks compressed with each template as a zstandard raw dictionary, confirmed by wording.

Words are runs of letters and digits (bytes from 128 on count as letters, general punctuation and no-break spaces do
not), A-Z lower-cased: so line breaks, comment marks, quotes and capitals make no difference. A template stands at a run
of words if it takes at most ``1 - threshold`` of the template's words, rounded down, to add, drop or change words of it
to get that run. With ``k`` such changes at least one run of the template's words is left unbroken, of a length that
follows from ``k``; places that share so many words in a row with a template are candidates, so none is missed.

Candidate places that touch are one block. A block is compressed with every template that it may hold as dictionary
(the others share no such run with it and cannot be confirmed), and templates are ranked by the size reduction
``1 - with / without``. All are confirmed or refuted by the exact differences in wording; of confirmed ones that overlap,
the one with the most words unchanged wins, then the fewest differences, then the greater reduction, then the name, then
the first place. So a block can hold several licenses, and a full text wins over its own opening. A template's places come
from one pass over the block, however often it stands there.

No rows, null and empty texts have no blocks. Repeated rows give repeated results. Offsets are code points, ends exclusive. Other
columns of the documents are not kept but for the doc_id. Whole texts of any length are read.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import common
from brindle.llm.contamination import shingle_hashes

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE'
_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_OPENING = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
_ISC_OPENING = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_APACHE_OPENING = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'


def _gnu(name: str, version: str, subject: str = "This program is free software: you") -> str:
    return f"{subject} can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


# Wordings of public licenses and of the short notices that name them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", _gnu("Affero General Public License", "3")),
    ("All-Rights-Reserved", "All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE_OPENING),
    (
        "Apache-2.0",
        _APACHE_OPENING + ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", f"{_BSD_OPENING}: 1. {_BSD_SOURCE} 2. {_BSD_BINARY} {_BSD_END}"),
    ("BSD-3-Clause", _BSD_OPENING),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", f"{_BSD_OPENING}: 1. {_BSD_SOURCE} 2. {_BSD_BINARY} 3. {_BSD_NAMES} {_BSD_END}"),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _gnu("General Public License", "2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _gnu("General Public License", "3")),
    ("ISC", _ISC_OPENING),
    (
        "ISC",
        _ISC_OPENING + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    ("LGPL-2.1", _gnu("Lesser General Public License", "2.1", "This library is free software; you")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _gnu("Lesser General Public License", "3")),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT_OPENING),
    (
        "MIT",
        _MIT_OPENING + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        + _AS_IS + " AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
)
#: Headings of the full texts, tags of source files, and notices by name.
HEADINGS = (
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
)
TAGGED = ("AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib")
NAMED = (("Apache-2.0", "Apache License, Version 2.0"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSL-1.0", "Boost Software License, Version 1.0"), ("GPL-2.0", "GNU General Public License v2.0"), ("GPL-3.0", "GNU General Public License v3.0"), ("ISC", "ISC License"), ("MIT", "MIT License"), ("MPL-2.0", "Mozilla Public License 2.0"))
TEMPLATES += HEADINGS
TEMPLATES += tuple((name, f"SPDX-License-Identifier: {name}") for name in TAGGED)
TEMPLATES += tuple((name, f"{how} under the {title}") for name, title in NAMED for how in ("Distributed", "Licensed") if (name, how) != ("Apache-2.0", "Licensed"))
#: Lengths of the word runs that candidates are found by; a template uses the longest that its unbroken run allows.
WIDTHS = (1, 3, 5, 8)
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Words:
    """All words of a column of texts: hashes, byte places, and each text's first word."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    cut: np.ndarray
    offsets: np.ndarray
    data: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        data, offsets = common.utf8(texts)
        apart = _APART[data]
        wide = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80))
        apart[wide] = apart[wide + 1] = apart[wide + 2] = True
        narrow = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] == 0xA0))
        apart[narrow] = apart[narrow + 1] = True
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(~apart & (np.r_[True, apart[:-1]] | edge[:-1])) if len(data) else np.zeros(0, np.int64)
        ends = np.flatnonzero(~apart & (np.r_[apart[1:], True] | edge[1:])) + 1 if len(data) else np.zeros(0, np.int64)
        hashes = common.span_hashes(common.LOWER[data], starts, ends) if len(starts) else np.zeros(0, np.uint64)
        return cls(hashes, starts, ends, np.searchsorted(starts, offsets), offsets, data)


@dataclass
class Template:
    """One wording: its words, how many may differ, and the width of its seeds."""

    name: str
    text: str
    words: list[int]
    allowed: int
    width: int
    masks: dict[int, int] = field(default_factory=dict)
    backward: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        for i, w in enumerate(self.words):
            self.masks[w] = self.masks.get(w, 0) | 1 << i
            self.backward[w] = self.backward.get(w, 0) | 1 << (len(self.words) - 1 - i)


def distances(masks: dict[int, int], size: int, words: list[int], anchored: bool) -> Iterator[int]:
    """The edit distance of a pattern of ``size`` words to the nearest run that ends at each word, or to the whole so far if anchored.

    One bit per word of the pattern: additions carry the differences between neighbouring cells (Myers 1999)."""
    whole, last, score = (1 << size) - 1, 1 << (size - 1), size
    up, down = whole, 0
    for w in words:
        equal = masks.get(w, 0)
        level = (((equal & up) + up) ^ up) | equal | down
        more, less = down | ~(level | up) & whole, level & up
        score += bool(more & last) - bool(less & last)
        more = (more << 1 | anchored) & whole
        up, down = (less << 1 | ~(level | more)) & whole, more & level
        yield score


def places(template: Template, words: list[int]) -> list[tuple[int, int, int]]:
    """``(first, past last, differences)`` of the template's confirmed runs, none overlapping; the nearest come first, then the earliest.

    One pass finds every end at which the template may stand. Ends are taken by differences, then place; one whose run would
    reach into a run taken before is measured anew from that run's end on, so its differences only grow, and it is
    given up when they are too many. Each end is looked back from over a template's length, however long the text is."""
    size, reach = len(template.words), len(template.words) + template.allowed
    waiting = [(d, i + 1, 0) for i, d in enumerate(distances(template.masks, size, words, False)) if d <= template.allowed]
    heapq.heapify(waiting)
    begins: list[int] = []
    ends: list[int] = []
    out = []
    while waiting:
        d, end, measured = heapq.heappop(waiting)
        at = bisect.bisect_left(begins, end)  # runs that begin before this end
        low = ends[at - 1] if at else 0
        if low >= end or end - low < size - template.allowed:
            continue
        back = list(distances(template.backward, size, words[max(low, end - reach) : end][::-1], True))
        if low > measured and min(back) > d:
            if min(back) <= template.allowed:
                heapq.heappush(waiting, (min(back), end, low))
            continue
        start = end - 1 - back.index(d)
        begins.insert(at, start)
        ends.insert(at, end)
        out.append((start, end, d))
    return sorted(out)


class Scanner:
    """The templates with their seeds and compressors; made once by each task."""

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float, level: int):
        cut = Words.of(pa.array([t for _, t in templates], pa.large_string()))
        self.templates: list[Template] = []
        seeds: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, (name, text) in enumerate(templates):
            hashes = cut.hashes[cut.cut[k] : cut.cut[k + 1]]
            allowed = int((1 - threshold) * len(hashes) + 1e-9)
            unbroken = -(-(len(hashes) - allowed) // (allowed + 1))
            width = max(w for w in WIDTHS if w <= max(1, unbroken))
            self.templates.append(Template(name, text, hashes.tolist(), allowed, width))
            for at, h in enumerate(shingle_hashes(hashes, width).tolist()):
                seeds.setdefault(width, {}).setdefault(h, []).append((k, at))
        self.seeds = seeds
        self.known = {width: np.array(sorted(s), np.uint64) for width, s in seeds.items()}
        plain = dict(level=level, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.plain = zstandard.ZstdCompressor(**plain)
        self.ready = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **plain) for _, t in templates]

    def candidates(self, words: Words) -> dict[int, list[tuple[int, int, int]]]:
        """For each text with seeds: ``(first word, past last, template)`` of where a template may stand, counted from all words."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        for width, known in self.known.items():
            hashes = shingle_hashes(words.hashes, width)
            at = np.searchsorted(known, hashes)
            hits = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == hashes)
            text = np.searchsorted(words.cut, hits, side="right") - 1
            inside = hits + width <= words.cut[text + 1]
            for i, d in zip(hits[inside].tolist(), text[inside].tolist()):
                for k, t in self.seeds[width][int(hashes[i])]:
                    T = self.templates[k]
                    low, high = max(i - t - T.allowed, int(words.cut[d])), min(i - t + len(T.words) + T.allowed, int(words.cut[d + 1]))
                    out.setdefault(d, []).append((low, high, k))
        return out

    def confirmed(self, words: Words, found: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, float]]:
        """``(first word, past last, template, differences, reduction)`` of what one text holds."""
        for block in touching(found):
            low, high = min(f[0] for f in block), max(f[1] for f in block)
            data = words.data[words.starts[low] : words.ends[high - 1]].tobytes().lower()
            size = len(self.plain.compress(data))
            possible = sorted({k for _, _, k in block})
            reduction = {k: 1 - len(self.ready[k].compress(data)) / size for k in possible}
            seen = []
            for k in sorted(possible, key=lambda k: (-reduction[k], self.templates[k].name, k)):
                T = self.templates[k]
                for place in touching([f for f in block if f[2] == k]):
                    first = min(f[0] for f in place)
                    for a, b, d in places(T, words.hashes[first : max(f[1] for f in place)].tolist()):
                        seen.append((d - len(T.words), d, -reduction[k], T.name, first + a, first + b, k))
            begins: list[int] = []
            ends: list[int] = []
            for _, d, gain, _, a, b, k in sorted(seen):
                at = bisect.bisect_left(begins, b)
                if not at or ends[at - 1] <= a:
                    begins.insert(at, a)
                    ends.insert(at, b)
                    yield a, b, k, d, -gain


def touching(found: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Groups of places that overlap or touch."""
    out: list[list[tuple[int, int, int]]] = []
    end = -1
    for f in sorted(set(found)):
        if f[0] > end:
            out.append([])
        out[-1].append(f)
        end = max(end, f[1])
    return out


def scan(docs: DataFrame, *, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.9, level: int = 12) -> DataFrame:
    """``(doc_id, license, start, end, reduction, differences, words)`` for each license found; ``words`` are the template's."""
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["license", "start", "end", "reduction", "differences", "words"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold, level)
        for part in common.pieces(batches, "text"):
            words = Words.of(part.column("text"))
            # Bytes that begin a code point, counted from the first text on.
            points = np.r_[0, np.cumsum((words.data & 0xC0) != 0x80)]
            rows, take = [], []
            for d, found in sorted(scanner.candidates(words).items()):
                for a, b, k, differ, gain in sorted(scanner.confirmed(words, found)):
                    start, end = (int(points[x] - points[words.offsets[d]]) for x in (words.starts[a], words.ends[b - 1]))
                    rows.append((scanner.templates[k].name, start, end, gain, differ, len(scanner.templates[k].words)))
                    take.append(d)
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(take, pa.int64())), *columns], ["doc_id", *names])

    return docs.mapInArrow(run, f"doc_id {id_type}, license string, start long, end long, reduction double, differences long, words long")


def by_document(docs: DataFrame) -> DataFrame:
    """One row per document with a license: their names and spans in order."""
    found = scan(docs).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "license", "reduction", "differences", "words"))).alias("found"))
    return found.select("doc_id", F.array_sort(F.array_distinct("found.license")).alias("licenses"), "found")
