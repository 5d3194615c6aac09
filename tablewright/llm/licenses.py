"""License scan by conditional compression.

A candidate block is compressed by zstandard alone and once with each template as raw
dictionary; templates are ranked by how much smaller the block becomes.  The winner is
confirmed by the exact differences in wording: few of its words may be missing, and none
that changes what it grants (versions, numbers, ``no``, ``non``, ...), on either side.
Licenses that share their sentences (MIT and MIT-0, ISC and 0BSD, BSD of two and of three
clauses) are whole texts; they differ by more words than a notice may lack or add.

Candidates come in two ways.  By wording: a template of n words that may lack and add
d = n / 10 of them, ``MOST_DIFFERENT`` at most, is cut in 2 d + 1 pieces, of which a notice that can be confirmed holds one word
for word, whatever line ends and comment marks are between the words.  Around each piece
found, the stretch of the template's words is a block; of those that overlap and are
confirmed the one of the longest template stays.  By cue (``license``, ``copyright``, ...):
a text is cut in units, lines and sentences, and a run of units with a cue, with up to two
without one between, is a block where no confirmed notice lies in it.

Cases: a null or empty text has no block; a block of any length is compressed whole; ties
in size go to the template of fewer differing words, then the first by name; a block
that equals no template is reported as not confirmed with its nearest; a text with many
notices gives a row for each, also next to one another; of an SPDX expression the first
license is named; repeated rows and ids stay separate; null ids stay null; ids may be numbers
or texts; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_type

MISSING_SHARE, MOST_DIFFERENT, LEVEL = 0.1, 8, 3
CUE = r"licen[sc]|lizen[sz]|copyright|all rights reserved|creative commons|public domain|permission is hereby|redistribution and use|warrant(?:y|ies)|spdx|permission to use|free software|free and unencumbered"
#: A line may end after a hyphen within a word; ``v.`` ends no sentence.
_CUE, _UNIT, _WORD = re.compile(CUE, re.I), re.compile(r"\n+|(?<=[.!?;])(?<!\b[vV]\.)\s+"), re.compile(r"[^\W_]+(?:(?:[.']|-(?:[^\S\n]*\n[^\S\n]*(?:[*#;/%|>]+[^\S\n]+)?)?)[^\W_]+)*")
_BROKEN = re.compile(r"-\s[^\w]*")
_GRANTS = re.compile(r"\d|^(?:no|non|not|without|by|sa|nc|nd|by-.*|noncommercial|sharealike|noderivatives|lesser|affero|mit|apache|bsd|gnu|gpl|mozilla|isc|unlicense|cc0?|commons)$")

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MIT_END = "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
_ZLIB = "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."
_SPDX = ("MIT", "MIT-0", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-only", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "0BSD", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0")

TEMPLATES = {
    "MIT/text": f"{_MIT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_MIT_END}",
    "MIT-0/text": f"{_MIT}. {_MIT_END}",
    "ISC/text": f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}",
    "0BSD/text": f"{_ISC}. {_ISC_END}",
    "BSD-2-Clause/text": f"{_BSD} {_BSD_END}",
    "BSD-3-Clause/text": f"{_BSD} {_BSD_NAMES} {_BSD_END}",
    "Zlib/text": _ZLIB,
    "MIT/notice": "Released under the MIT License.",
    "MIT/licensed": "Licensed under the MIT License.",
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/you-may-not": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0/notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0/or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    "LGPL-3.0/notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0/notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause/notice": "Licensed under the BSD 3-Clause License.",
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense/notice": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0/notice": "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0/short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0/notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0/short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0/notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-4.0/short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0/short": "Licensed under CC BY-ND 4.0.",
    "Proprietary/reserved": "All rights reserved.",
}
TEMPLATES |= {f"{x}/spdx": f"SPDX-License-Identifier: {x}" for x in _SPDX}


def blocks(text: str) -> Iterator[tuple[int, str]]:
    """Start and text of each candidate block."""
    if not _CUE.search(text):
        return
    units, at = [], 0
    for m in _UNIT.finditer(text):
        units.append((at, m.start()))
        at = m.end()
    units.append((at, len(text)))
    run: list[int] | None = None
    gap = 0
    for a, b in units:
        if _CUE.search(text, a, b):
            run, gap = ([a, b] if run is None else [run[0], b]), 0
        elif run is not None:
            gap += 1
            if gap > 2:
                yield run[0], text[run[0] : run[1]]
                run = None
    if run is not None:
        yield run[0], text[run[0] : run[1]]


def words_of(text: str) -> list[str]:
    return [_BROKEN.sub("-", w) for w in _WORD.findall(text.lower())]


def slack(words: list[str]) -> int:
    """How many words a notice may lack, and how many add."""
    return min(int(MISSING_SHARE * len(words)), MOST_DIFFERENT)


def telling(words: list[str], want: list[str]) -> bool:
    """Whether words change a grant.  Whole texts number their clauses or not."""
    return any(_GRANTS.search(w) and not (len(want) > 60 and len(w) == 1) for w in words)


def pieces(words: list[str]) -> list[tuple[int, list[str]]]:
    """Place and words of the pieces of a template; each difference harms one at most."""
    n = len(words)
    count = 2 * slack(words) + 1
    cuts = [n * i // count for i in range(count + 1)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:])]


def longest_part(words: list[str]) -> str:
    """A run of letters or digits that each text with these words holds."""
    return max((x for w in words for x in re.split(r"[.\-']", w)), key=lambda x: (x not in ("this", "under"), len(x)))


def may_hold(text: Column, templates: dict[str, str]) -> Column:
    """Holds for each text with a candidate block.  Pieces with a cue are left to the cues."""
    parts = sorted({longest_part(p) for t in templates.values() for _, p in pieces(words_of(t)) if not any(_CUE.search(w) for w in p)})
    out, low = text.rlike(f"(?i){CUE}"), F.lower(text)
    for part in parts:
        out = out | low.contains(part)
    return out


class Scanner:
    def __init__(self, templates: dict[str, str]) -> None:
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        self.with_template, self.words = {}, {}
        for name in sorted(templates):
            text = templates[name]
            shared = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.with_template[name] = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.words[name] = words_of(text)
        # by the part to look for first: the pieces that hold it
        self.seeds: dict[str, list[tuple[str, int, list[str]]]] = {}
        for name, words in self.words.items():
            for at, piece in pieces(words):
                self.seeds.setdefault(longest_part(piece), []).append((name, at, piece))

    def differences(self, name: str, words: list[str]) -> tuple[list[str], list[str]]:
        """Words of the template that the block lacks, and words between that it adds."""
        want = self.words[name]
        same = [m for m in SequenceMatcher(None, want, words, autojunk=False).get_matching_blocks() if m.size]
        if not same:
            return want, words
        got = {i for m in same for i in range(m.a, m.a + m.size)}
        used = {i for m in same for i in range(m.b, m.b + m.size)}
        low, high = same[0].b, same[-1].b + same[-1].size
        return [w for i, w in enumerate(want) if i not in got], [words[i] for i in range(low, high) if i not in used]

    def scan(self, block: str) -> tuple[str, int, int, str, str, bool]:
        """Template, size alone, size with it, missing words, added words, confirmed."""
        low = block.lower()
        raw, words = low.encode("utf-8", "surrogatepass"), words_of(block)
        alone = len(self.plain.compress(raw))
        sizes = {name: len(c.compress(raw)) for name, c in self.with_template.items()}
        least = min(sizes.values())
        # templates that save nearly as much are told apart by their wording
        tied = [(name, *self.differences(name, words)) for name, n in sizes.items() if n <= least + max(3, (alone - least) // 5)]
        name, missing, added = min(tied, key=lambda x: (len(x[1]) + len(x[2]), sizes[x[0]], x[0]))
        few = max(len(missing), len(added)) <= slack(self.words[name])
        same = sizes[name] < alone and few and not telling([*missing, *added], self.words[name])
        return name, alone, sizes[name], " ".join(missing), " ".join(added), same

    def stretches(self, text: str) -> Iterator[tuple[int, int, str]]:
        """Start, end and template of each stretch that has a template's wording."""
        low = text.lower()
        parts = [seeds for part, seeds in self.seeds.items() if part in low]
        if not parts:
            return
        spans = [m.span() for m in _WORD.finditer(text)]
        words = [_BROKEN.sub("-", text[a:b].lower()) for a, b in spans]
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            places.setdefault(w, []).append(i)
        seen = set()
        for name, at, piece in (x for seeds in parts for x in seeds):
            rare = min(range(len(piece)), key=lambda k: len(places.get(piece[k], ())))
            n = len(self.words[name])
            most = slack(self.words[name])
            for i in places.get(piece[rare], ()):
                first = i - rare
                if first < 0 or words[first : first + len(piece)] != piece or (name, first - at) in seen:
                    continue
                seen.add((name, first - at))
                for wide in sorted({0, most}):
                    a, b = max(0, first - at - wide), min(len(words), first - at + n + wide)
                    missing, added = self.differences(name, words[a:b])
                    if max(len(missing), len(added)) <= most and not telling([*missing, *added], self.words[name]):
                        same = [m for m in SequenceMatcher(None, self.words[name], words[a:b], autojunk=False).get_matching_blocks() if m.size]
                        end = spans[a + same[-1].b + same[-1].size - 1][1]
                        yield spans[a + same[0].b][0], end + (text[end : end + 1] in (".", "!", "?", ";")), name
                        break

    def candidates(self, text: str) -> Iterator[tuple[int, tuple[str, int, int, str, str, bool]]]:
        """Start of each block of a text, and what ``scan`` says of it."""
        taken: list[tuple[int, int, tuple]] = []
        for a, b, _ in sorted(set(self.stretches(text)), key=lambda x: (-len(self.words[x[2]]), x[0], x[1], x[2])):
            if all(b <= c or d <= a for c, d, _ in taken):
                got = self.scan(text[a:b])
                if got[-1]:
                    taken.append((a, b, got))
        runs = [(a, a + len(block), self.scan(block)) for a, block in blocks(text) if all(a + len(block) <= c or d <= a for c, d, _ in taken)]
        for a, _, got in sorted(taken + runs):
            yield a, got


@lru_cache(maxsize=4)
def scanner_of(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(dict(templates))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``doc_id, start, license, template, plain_bytes, conditional_bytes, missing, added,
    confirmed`` of each candidate block; ``start`` counts characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = scanner_of(tuple(templates.items()))
        names = ["doc_id", "start", "license", "template", "plain_bytes", "conditional_bytes", "missing", "added", "confirmed"]
        for pdf in batches:
            rows = []
            for d, text in zip(pdf["doc_id"], pdf["text"]):
                for start, (name, alone, size, missing, added, same) in scanner.candidates(text):
                    rows.append((d, start, name.split("/")[0], name, alone, size, missing, added, same))
            yield pd.DataFrame(rows, columns=names)

    kind = id_type(docs, id_col)
    cued = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(may_hold(F.col("text"), templates))
    found = cued.mapInPandas(run, "doc_id string, start long, license string, template string, plain_bytes long, conditional_bytes long, missing string, added string, confirmed boolean")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))
