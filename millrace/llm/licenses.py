"""License scans by conditional compression.

Around words that licences use, an index of words delimits the stretches where those
of a template stand together, across line breaks and comment signs; other lines with such
words are candidate blocks as well. Each is compressed alone and with every template as a zstandard
raw dictionary; the templates are ranked by the share of bytes that they save. The best few are then
compared with the block word by word, which confirms a wording and lists the words it lacks. In a
stretch the ranking is gone down, a few at a time, until a wording is confirmed.

A null or empty text has no blocks. Of wordings that overlap the one with the most
words found stays; ties go to the template that comes first by name. Repeated rows are scanned each on its own, a block being known by the
place of its first character. Other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import map_batches

#: Words that begin a candidate block, and the wordings of common licences.
CUES = r'(?i)licen[cs]e|copyright|permission is hereby|redistribution and use|without warranty|["“]as is["”]|public domain|spdx-|creative commons|cc[ -]by|cc0'
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        'to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF '
        "ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the "
        "copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has dedicated all copyright to the public domain worldwide."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files '
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
        "in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
}

#: Characters that a block reaches beyond a cue within its line, and between cues of one block.
REACH = 400
LEVEL = 9
#: Templates that are compared word by word at a time, and the share of their words that confirms one.
COMPARED, CONFIRMED = 4, 0.9
#: Words; a hyphen may end a line, and comment signs may begin the next one.
SIGNS = r"[ \t]*\r?\n[\s#*/;%>|!-]*"
WORD = re.compile(rf"[^\W_]+(?:(?:\.|-(?:{SIGNS})?)[^\W_]+)*")


def words_of(text: str) -> list[str]:
    return [re.sub(SIGNS, "", w).lower() for w in WORD.findall(text)]


def blocks(text: str) -> list[tuple[int, int]]:
    """Stretches of ``text`` around its cues: their lines, cut at ``REACH``; stretches that meet are one."""
    found: list[tuple[int, int]] = []
    for cue in re.finditer(CUES, text):
        line = text.rfind("\n", 0, cue.start()) + 1
        stop = text.find("\n", cue.end())
        stop = len(text) if stop < 0 else stop
        start, stop = max(line, cue.start() - REACH), min(stop, cue.end() + REACH)
        if found and start <= found[-1][1] + 1:
            found[-1] = (found[-1][0], max(stop, found[-1][1]))
        else:
            found.append((start, stop))
    return found


def surroundings(text: str, reach: int) -> list[tuple[int, int]]:
    """Stretches of ``reach`` characters around the cues of ``text``, across lines; stretches that meet are one."""
    found: list[tuple[int, int]] = []
    for cue in re.finditer(CUES, text):
        start, stop = max(0, cue.start() - reach), min(len(text), cue.end() + reach)
        if found and start <= found[-1][1]:
            found[-1] = (found[-1][0], stop)
        else:
            found.append((start, stop))
    return found


class Scanner:
    def __init__(self, templates: dict[str, list[str]]):
        self.templates = []
        for name, wordings in sorted(templates.items()):
            for wording in wordings:
                book = zstandard.ZstdCompressionDict(wording.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                press = zstandard.ZstdCompressor(level=LEVEL, dict_data=book, write_content_size=False, write_dict_id=False)
                words = words_of(wording)
                self.templates.append((name, words, press, len(wording)))
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        # Line breaks, indents and comment signs may double what a wording takes.
        self.reach = 2 * max(size for *_, size in self.templates)
        self.places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, words, _, _) in enumerate(self.templates):
            for i, w in enumerate(words):
                self.places.setdefault(w, []).append((n, i))
        self.tallies = [Counter(words) for _, words, _, _ in self.templates]

    def confirmed(self, text: str) -> list[tuple]:
        """(start, stop, template, share, lacks) of the wordings in ``text``, in order, without overlap."""
        found = set()
        for low, high in surroundings(text, self.reach):
            spots = [m.span() for m in WORD.finditer(text, low, high)]
            words = [re.sub(SIGNS, "", text[a:b]).lower() for a, b in spots]
            shifts: dict[int, list[int]] = {}
            for at, w in enumerate(words):
                for n, i in self.places.get(w, ()):
                    shifts.setdefault(n, []).append(at - i)
            ranks: dict[tuple[int, int], list[int]] = {}
            for n, moved in shifts.items():
                for first, last in self._delimited(n, moved, words):
                    found |= self._named(n, first, last, words, spots, text, ranks)
        chosen: list[tuple] = []
        for f in sorted(found, key=lambda f: (-f[5], f[2], f[0])):
            if all(f[1] <= c[0] or f[0] >= c[1] for c in chosen):
                chosen.append(f)
        return [(*c[:4], list(c[4])) for c in sorted(chosen)]

    def _delimited(self, n: int, moved: list[int], words: list[str]) -> Iterator[tuple[int, int]]:
        """Stretches of words where those of template ``n`` stand together, given how far they are moved in the text."""
        size, step = len(self.templates[n][1]), self._step(n)
        bins: dict[int, int] = {}
        for m in moved:
            bins[m // step] = bins.get(m // step, 0) + 1
        # Words that were put in move the rest on, so a wording may fill several bins.
        for b, count in bins.items():
            if sum(bins.get(b + k, 0) for k in range(3)) < 0.7 * size or bins.get(b - 1, 0) + bins.get(b - 2, 0) + count < 0.2 * size:
                continue
            yield max(0, b * step), min(len(words), (b + 3) * step + size)

    def _step(self, n: int) -> int:
        return max(2, len(self.templates[n][1]) // 8)

    def _named(
        self, n: int, low: int, high: int, words: list[str], spots: list[tuple[int, int]], text: str, ranks: dict[tuple[int, int], list[int]]
    ) -> set[tuple]:
        """The wordings of a stretch in which the words of template ``n`` stand: its best ranked templates, confirmed word by word.

        The ranking is gone down until one is confirmed. If that is not ``n``, what is left and right of it is ranked by itself.
        """
        if not self._may_hold(n, words[low:high]):
            return set()
        if (low, high) not in ranks:
            ranks[low, high] = self.ranked(text[spots[low][0] : spots[high - 1][1]].encode())
        order = ranks[low, high]
        for at in range(0, len(order), COMPARED):
            sure = [w for m in order[at : at + COMPARED] if (w := self._compared(m, low, high, words))]
            if not sure:
                continue
            first, last, m, share, lacks, kept = min(sure, key=lambda w: (-w[5], w[2]))
            made = {(spots[first][0], spots[last - 1][1], m, share, lacks, kept)}
            if m != n:
                for a, b in ((low, first), (last, high)):
                    made |= self._named(n, a, b, words, spots, text, ranks)
            return made
        return set()

    def _may_hold(self, n: int, words: list[str]) -> bool:
        """Whether so many words of template ``n`` are there, in any order, that it may be confirmed."""
        wanted = self.tallies[n]
        there = Counter(w for w in words if w in wanted)
        return (wanted & there).total() >= CONFIRMED * wanted.total()

    def _compared(self, n: int, low: int, high: int, words: list[str]) -> tuple | None:
        """(first, last, template, share, lacks, words found) of template ``n`` in a stretch, if its wording is there."""
        wanted = self.templates[n][1]
        size = len(wanted)
        if not self._may_hold(n, words[low:high]):
            return None
        pairs = SequenceMatcher(None, wanted, words[low:high], autojunk=False).get_matching_blocks()[:-1]
        kept = {i for a, _, length in pairs for i in range(a, a + length)}
        if len(kept) < CONFIRMED * size:
            return None
        first, last = low + pairs[0].b, low + pairs[-1].b + pairs[-1].size
        if last - first > size + 2 * self._step(n):
            return None
        return first, last, n, len(kept) / size, tuple(w for i, w in enumerate(wanted) if i not in kept), len(kept)

    def ranked(self, data: bytes) -> list[int]:
        """All templates by the share of bytes that they save as a dictionary of ``data``, best first."""
        return [n for _, n in self.savings(data)]

    def savings(self, data: bytes) -> list[tuple[float, int]]:
        alone = len(self.alone.compress(data))
        found = [(1 - len(press.compress(data)) / alone, n) for n, (_, _, press, _) in enumerate(self.templates)]
        return sorted(found, key=lambda s: (-s[0], s[1]))

    def blocks(self, text: str) -> list[tuple]:
        """(start, length, license, nearest, saving, share, lacks) of each block of a text."""
        sure, lines = self.confirmed(text), blocks(text)
        made = []
        for a, b, n, share, lacks in sure:
            # A block is whole lines if no other wording is on them.
            touched = [line for line in lines if line[0] < b and a < line[1]]
            low, high = min([a, *(x for x, _ in touched)]), max([b, *(y for _, y in touched)])
            if any(low < y and x < high for x, y, *_ in sure if (x, y) != (a, b)):
                low, high = a, b
            data = text[low:high].encode()
            name, _, press, _ = self.templates[n]
            saving = 1 - len(press.compress(data)) / len(self.alone.compress(data))
            made.append((low, high - low, name, name, saving, share, lacks))
        for a, b in lines:
            for low, high in self._rest(text, a, b, sure):
                made.append((low, high - low, *self.judge(text[low:high])))
        return sorted(made, key=lambda m: m[:2])

    def _rest(self, text: str, a: int, b: int, sure: list[tuple]) -> list[tuple[int, int]]:
        """The lines from ``a`` to ``b``; if wordings are confirmed on them, the parts with cues of their own."""
        inside = [(x, y) for x, y, *_ in sure if x < b and a < y]
        if len(inside) < 2:  # those lines belong to the block of the one wording
            return [] if inside else [(a, b)]
        edges = [a, *(e for x, y in inside for e in (max(a, x), min(b, y))), b]
        return [(x, y) for x, y in zip(edges[::2], edges[1::2]) if x < y and re.search(CUES, text[x:y])]

    def judge(self, block: str) -> tuple:
        """License or None, its saving, the share of its words found, and the words it lacks."""
        ranked = self.savings(block.encode())[:COMPARED]
        words = words_of(block)
        judged = []
        for saving, n in ranked:
            name, wanted, _, _ = self.templates[n]
            pairs = SequenceMatcher(None, wanted, words, autojunk=False).get_matching_blocks()
            kept = {i for a, _, size in pairs for i in range(a, a + size)}
            share = len(kept) / len(wanted)
            judged.append((share >= CONFIRMED, share * len(wanted) if share >= CONFIRMED else share, saving, -n, name, share, [w for i, w in enumerate(wanted) if i not in kept]))
        sure, _, saving, _, name, share, lacks = max(judged)
        return (name if sure else None), name, saving, share, lacks


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(TEMPLATES)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, license, nearest, saving, wording, lacks) for each candidate block.

    ``license`` is null where the wording does not confirm the ``nearest`` one.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = (
        f"`{id_col}` {kind}, start long, length long, license string, nearest string, saving double, wording double, lacks array<string>"
    )

    def work(batch: pa.RecordBatch) -> dict:
        tool, rows, out = scanner(), [], []
        for at, text in enumerate(batch.column(1)):
            text = text.as_py()
            for block in tool.blocks(text):
                rows.append(at)
                out.append(block)
        names = ("start", "length", "license", "nearest", "saving", "wording", "lacks")
        columns = dict(zip(names, map(list, zip(*out)))) if out else {n: [] for n in names}
        return {id_col: batch.column(0).take(pa.array(rows, pa.int64())), **columns}

    return map_batches(df.select(id_col, text_col).where(F.col(text_col).rlike(CUES)), work, schema)
