"""License scans by conditional compression.

A word that licences use is a cue and opens a candidate block: its line and the lines beside it, at most ``NEAR`` words to
either side, merged with those it touches. What no such block confirms is looked for once more in wide blocks, which reach
as many words to both sides of a cue as the longest template has, whatever the lines: notices may be wrapped at any width.
A wide block is read in overlapping windows, each of which holds any wording it could hold a part of. Each
block is compressed with zstandard once alone and once with each template as a raw-content dictionary; what a
dictionary saves says how much of the block's wording the template already holds. Templates are
ranked by the saving, and confirmed in order by the exact differences of wording: the
template's words are aligned with the block's, and few enough may be missing or changed, none of them a key word
(names and versions that tell licences apart). Nor may a word be added within or offered as a choice behind it that tells another licence: a
version, "or later", a further clause; what names another licence and so belongs to that one (as in dual licences) doesn't count. A wording that a word before it in the
sentence denies ("not released under") is none. Of two licences confirmed in one place, the one of which more is there stays, unless the other's key words are no
part of its wording: then both are offered.

Every block that holds some template's key words is ranked against all templates. Templates are a parameter: (license_id, text, key words). The defaults are whole
short licences, the notices by which the long ones are applied, the openings of the long ones' full texts, and SPDX lines.

Defined cases: null, empty and cue-less texts give no finding. A document gives a finding for each licence
confirmed in each block, so rows repeat a doc_id; equal savings rank the shorter template first, then the earlier one. Long texts
are read whole. Rows that share a doc_id are documents of their own. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.blocks import tidied
from corpusloom.session import prepare

RESULT_SCHEMA = "doc_id long, first_line int, last_line int, license_id string, rank int, saved_bytes int, template_words int, matched_words int, differences string"
#: Share of a template's words that have to be there.
SHARE = 0.8
#: Words to either side of a cue that a narrow block takes at most.
NEAR = 64
#: The words of a cue may stand on two lines, with a comment's marks between.
_CUE = re.compile(r"licen[cs]e|copyright|warrant|redistribut|permission[\W_]{1,80}is[\W_]{1,80}hereby|spdx|creative[\W_]{1,80}commons|\bgnu\b|public[\W_]{1,80}domain", re.I)
_WORD = re.compile(r"[A-Za-z0-9]+(?:[.\-+][A-Za-z0-9]+)*\+?")
#: Words that tell another licence where they are added to a template's wording; versions do too.
_TELLING = frozenset("later only lesser affero neither endorse nc sa nd by-nc by-sa by-nd by-nc-sa by-nc-nd appear misrepresented".split())
_VERSION = re.compile(r"v?\d{1,2}(\.\d+)*\Z")
#: Words that deny what follows them, within ``DENIED`` words.
_DENIAL = frozenset("not never no cannot neither nor without t".split())
DENIED = 6
#: Words that name a licence, alone or before a hyphen.
_NAMES = frozenset("mit x11 apache gnu gpl lgpl agpl mozilla mpl cc cc0 bsd 0bsd isc zlib unlicense boost eclipse epl artistic".split())


class Template(NamedTuple):
    license_id: str
    text: str
    keys: tuple[str, ...]


# Licences and the notices by which works are commonly put under one.
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'
_MIT_END = ', and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
_APACHE_END = ' You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_FREE = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_X11 = " Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium."
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_APACHE_FULL = 'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.'
_MPL_FULL = 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.'
_SPDX = {
    "MIT": ("MIT",),
    "X11": ("X11",),
    "Apache-2.0": ("Apache-2.0",),
    "GPL-2.0": ("GPL-2.0-only", "GPL-2.0"),
    "GPL-2.0-or-later": ("GPL-2.0-or-later", "GPL-2.0+"),
    "GPL-3.0": ("GPL-3.0-only", "GPL-3.0"),
    "GPL-3.0-or-later": ("GPL-3.0-or-later", "GPL-3.0+"),
    "LGPL-2.1": ("LGPL-2.1-only", "LGPL-2.1"),
    "LGPL-2.1-or-later": ("LGPL-2.1-or-later", "LGPL-2.1+"),
    "LGPL-3.0": ("LGPL-3.0-only", "LGPL-3.0"),
    "LGPL-3.0-or-later": ("LGPL-3.0-or-later", "LGPL-3.0+"),
    "AGPL-3.0": ("AGPL-3.0-only", "AGPL-3.0"),
    "AGPL-3.0-or-later": ("AGPL-3.0-or-later", "AGPL-3.0+"),
    "BSD-2-Clause": ("BSD-2-Clause",),
    "BSD-3-Clause": ("BSD-3-Clause",),
    "ISC": ("ISC",),
    "0BSD": ("0BSD",),
    "Zlib": ("Zlib",),
    "MPL-2.0": ("MPL-2.0",),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0-1.0",),
    "CC-BY-4.0": ("CC-BY-4.0",),
    "CC-BY-SA-4.0": ("CC-BY-SA-4.0",),
    "CC-BY-NC-4.0": ("CC-BY-NC-4.0",),
    "CC-BY-NC-SA-4.0": ("CC-BY-NC-SA-4.0",),
}
TEMPLATES = (
    *(Template(name, f"SPDX-License-Identifier: {x}", ("spdx-license-identifier", x.lower())) for name, known in _SPDX.items() for x in known),
    Template("GPL-2.0", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. {_VERBATIM}", ("gnu", "general", "2", "1991", "verbatim")),
    Template("GPL-3.0", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM}", ("gnu", "general", "3", "2007", "verbatim")),
    Template("LGPL-2.1", f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. {_VERBATIM}", ("gnu", "lesser", "2.1", "1999", "verbatim")),
    Template("LGPL-3.0", f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM}", ("gnu", "lesser", "3", "2007", "verbatim")),
    Template("AGPL-3.0", f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM}", ("gnu", "affero", "3", "2007", "verbatim")),
    Template("Apache-2.0", _APACHE_FULL, ("apache", "2.0", "definitions", "sections")),
    Template("MPL-2.0", _MPL_FULL, ("mozilla", "2.0", "definitions", "contributor")),
    Template("MIT", "Released under the MIT License.", ("mit",)),
    Template("MIT", "Licensed under the MIT license.", ("mit",)),
    Template("MIT", _MIT, ("permission", "sublicense")),
    Template("MIT", _MIT + _MIT_END, ("permission", "sublicense", "noninfringement")),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache", "2.0")),
    Template("Apache-2.0", _APACHE, ("apache", "2.0", "compliance")),
    Template("Apache-2.0", _APACHE + _APACHE_END, ("apache", "2.0", "compliance", "governing")),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu", "general", "public", "3")),
    Template("GPL-3.0-or-later", "This work is licensed under the GNU General Public License, version 3 or later.", ("gnu", "general", "public", "3", "later")),
    Template("GPL-3.0-or-later", _FREE.format("program", "General Public", "3"), ("gnu", "general", "public", "3", "later")),
    Template("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu", "general", "public", "2")),
    Template("GPL-2.0-or-later", "This work is licensed under the GNU General Public License, version 2 or later.", ("gnu", "general", "public", "2", "later")),
    Template("GPL-2.0-or-later", _FREE.format("program", "General Public", "2"), ("gnu", "general", "public", "2", "later")),
    Template("LGPL-2.1-or-later", _FREE.format("library", "Lesser General Public", "2.1"), ("gnu", "lesser", "2.1", "later")),
    Template("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", ("gnu", "lesser", "3")),
    Template("LGPL-3.0-or-later", _FREE.format("library", "Lesser General Public", "3"), ("gnu", "lesser", "3", "later")),
    Template("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", ("gnu", "affero", "3")),
    Template("AGPL-3.0-or-later", _FREE.format("program", "Affero General Public", "3"), ("gnu", "affero", "3", "later")),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0.", ("cc", "by", "4.0")),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ("cc", "by-sa", "4.0")),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("cc", "by-nc", "4.0")),
    Template("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", ("cc", "by-nc-sa", "4.0")),
    Template("CC0-1.0", "To the extent possible under law, all copyright and related rights to this work have been waived under CC0 1.0.", ("cc0", "1.0")),
    Template("BSD-2-Clause", f"{_BSD} {_BSD_END}", ("redistributions", "source", "binary", "disclaimer")),
    Template("BSD-3-Clause", f"{_BSD} {_BSD_THIRD} {_BSD_END}", ("redistributions", "source", "binary", "disclaimer", "neither", "endorse")),
    Template("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.{_ISC_END}", ("permission", "fee", "provided", "appear")),
    Template("0BSD", f"{_ISC}.{_ISC_END}", ("permission", "fee")),
    Template("Zlib", _ZLIB, ("misrepresented", "altered", "origin")),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla", "2.0")),
    Template("Unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered", "domain")),
    Template("X11", _MIT + _MIT_END + _X11, ("permission", "sublicense", "noninfringement", "except", "advertising")),
)


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


class _Text:
    """A text's words with their places, its cues and lines."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.cues = [m.span() for m in _CUE.finditer(text)]
        if not self.cues:
            return
        found = [m.span() for m in _WORD.finditer(text)]
        self.start, self.end = [a for a, _ in found], [b for _, b in found]
        self.words = [text[a:b].lower() for a, b in found]
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(self, at: int) -> int:
        """From 1."""
        return bisect_right(self.lines, at)

    def _cue_words(self) -> Iterator[tuple[int, int, int, int]]:
        """Words i..j and lines of each cue."""
        for a, b in self.cues:
            i = min(bisect_right(self.end, a), len(self.words) - 1)
            yield i, max(i + 1, bisect_left(self.start, b)), self.line(a), self.line(b - 1)

    def near(self) -> list[tuple[int, int, int, int]]:
        """Narrow blocks: words i..j, first and last line."""
        out: list[list[int]] = []
        for i, j, first, last in self._cue_words():
            first, last = max(1, first - 1), min(len(self.lines), last + 1)
            stop = self.lines[last] if last < len(self.lines) else len(self.text) + 1
            i, j = max(i - NEAR, bisect_left(self.start, self.lines[first - 1])), min(j + NEAR, bisect_left(self.start, stop))
            if out and first <= out[-1][3] + 1 and i <= out[-1][1]:
                out[-1][1], out[-1][3] = max(out[-1][1], j), max(out[-1][3], last)
            else:
                out.append([i, j, first, last])
        return [tuple(x) for x in out]

    def wide(self, reach: int) -> list[tuple[int, int, int, int]]:
        """Wide blocks, in windows of four times ``reach`` that overlap by more than half."""
        spans: list[list[int]] = []
        for i, j, _, _ in self._cue_words():
            i, j = max(0, i - reach), min(len(self.words), j + reach)
            if spans and i <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], j)
            else:
                spans.append([i, j])
        size, step = 4 * reach + 8, 2 * reach
        cut = [(k, min(k + size, j)) for i, j in spans for k in range(i, max(i + 1, j - size + step), step)]
        return [(i, j, self.line(self.start[i]), self.line(self.end[j - 1] - 1)) for i, j in cut]


class _Found(NamedTuple):
    license_id: str
    rank: int
    saved: int
    words: int
    matched: int
    differences: str
    begin: int
    end: int
    places: frozenset[int]
    keys: frozenset[int]

    def holds(self, other: _Found) -> bool:
        """Whether ``other`` is the same licence in the same place, or its key words are part of this one's wording."""
        return self.begin < other.end and other.begin < self.end and (self.license_id == other.license_id or other.keys <= self.places)


class Scanner:
    """Ranks and confirms templates for blocks, in one worker."""

    def __init__(self, templates: tuple[Template, ...], share: float) -> None:
        self.templates, self.share = templates, share
        self.words = [words(t.text) for t in templates]
        self.known = [frozenset(w) for w in self.words]
        self.reach = max(map(len, self.words), default=0)
        self.plain = zstandard.ZstdCompressor(level=9, write_content_size=False, write_checksum=False)
        self.primed = [zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(t.text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for t in templates]

    def rank(self, block: str, among: list[int] | None = None) -> list[tuple[int, int]]:
        """(bytes saved, template) of those that save any, the best first; per template byte where savings are equal."""
        raw = block.encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(raw))
        saved = [(alone - len(self.primed[k].compress(raw)), k) for k in (range(len(self.templates)) if among is None else among)]
        return sorted(((s, k) for s, k in saved if s > 0), key=lambda x: (-x[0], len(self.templates[x[1]].text), x[1]))

    def tells(self, added: list[str], k: int, denials: frozenset[str] = frozenset()) -> bool:
        """Whether words that a block adds to a template's wording tell another licence, or are among ``denials``."""
        return any((w in _TELLING or w in denials or _VERSION.match(w)) and w not in self.known[k] for w in added)

    def own(self, added: list[str], k: int, again: bool = False) -> list[str]:
        """``added`` without what belongs to another licence that it names: from the name up to the last "or" or "and" behind it, or to the end. ``again``: a name that the template has too is another's."""
        first = next((i for i, w in enumerate(added) if w.split("-")[0] in _NAMES and (again or w not in self.known[k])), None)
        if first is None:
            return added
        last = max((i for i, w in enumerate(added) if i > first and w in ("or", "and")), default=len(added))
        return added[:first] + added[last + 1 :]

    def confirm(self, block_words: list[str], k: int, behind: list[str]) -> tuple[int, str, int, int, frozenset[int], frozenset[int]] | None:
        """(words matched, differences, from, to, places matched, places of key words) if the template's wording is there. ``behind``: the words after the block."""
        placed = self._placed(block_words, k, behind)
        return placed and placed[2]

    def _placed(self, block_words: list[str], k: int, behind: list[str]) -> tuple[int, int, tuple | None] | None:
        """(from, to, what ``confirm`` gives) of the place whose words are most like the template's; None if none are enough like them."""
        template, own = self.templates[k], self.words[k]
        if not set(template.keys) <= set(block_words):
            return None
        matcher = SequenceMatcher(None, own, block_words, autojunk=False)
        parts = self._nearest([m for m in matcher.get_matching_blocks() if m.size], len(own) * 2 + 5)
        matched = sum(m.size for m in parts)
        if matched < self.share * len(own):
            return None
        at = {m.b + i: own[m.a + i] for m in parts for i in range(m.size)}
        # What lies between the first and the last match is the block's wording of the template.
        begin, end = parts[0].b, parts[-1].b + parts[-1].size
        if not set(template.keys) <= set(at.values()):
            return begin, end, None
        changes = [(own[a:b], block_words[c:d]) for op, a, b, c, d in matcher.get_opcodes() if op != "equal" and c >= begin and d <= end]
        after = (block_words[end : end + 8] + behind)[:8]
        if any(self.tells(self.own(new, k), k, _DENIAL) for _, new in changes) or (after[:1] == ["or"] and self.tells(self.own(after, k, again=True), k)):
            return begin, end, None
        differences = "; ".join(f"-{' '.join(old)}+{' '.join(new)}" for old, new in changes)
        return begin, end, (matched, differences, begin, end, frozenset(at), frozenset(i for i, w in at.items() if w in template.keys))

    def _places(self, block_words: list[str], k: int, behind: list[str]) -> Iterator[tuple[int, tuple]]:
        """(offset, what ``confirm`` gives) of every place of a template's wording: before and behind one there may be others."""
        waiting = [(0, len(block_words))]
        while waiting:
            i, j = waiting.pop()
            placed = self._placed(block_words[i:j], k, (block_words[j : j + 8] + behind)[:8])
            if placed is not None:
                if placed[2]:
                    yield i, placed[2]
                waiting += [(i, i + placed[0]), (i + placed[1], j)]

    @staticmethod
    def _nearest(parts: list, length: int) -> list:
        """The matches in a row that lie within ``length`` words and hold most; words that happen to match far away are no wording of the template."""
        best, most, i, held = (0, 0), 0, 0, 0
        for j, m in enumerate(parts):
            held += m.size
            while m.b + m.size - parts[i].b > length:
                held -= parts[i].size
                i += 1
            if held > most:
                best, most = (i, j + 1), held
        return parts[best[0] : best[1]]

    @staticmethod
    def denied(t: _Text, at: int) -> bool:
        """Whether a word shortly before word ``at``, in its sentence, denies what follows."""
        for i in range(at - 1, max(-1, at - 1 - DENIED), -1):
            if re.search(r"[.;:!?]\s|\n\s*\n", t.text[t.end[i] : t.start[i + 1]]):
                return False
            if t.words[i] in _DENIAL:
                return t.words[i] != "t" or t.text[t.end[i - 1] : t.start[i]] in ("'", "’")
        return False

    def licences(self, t: _Text, i: int, j: int) -> list[_Found]:
        """The licences confirmed in words i..j of a text."""
        own = t.words[i:j]
        have = set(own)
        among = {k for k, x in enumerate(self.templates) if set(x.keys) <= have}
        if not among:
            return []
        found = []
        for rank, (saved, k) in enumerate(self.rank(t.text[t.start[i] : t.end[j - 1]]), 1):
            for at, good in self._places(own, k, t.words[j : j + 8]) if k in among else ():
                at += i
                if not self.denied(t, at + good[2]):
                    found.append(_Found(self.templates[k].license_id, rank, saved, len(self.words[k]), *good[:2], at + good[2], at + good[3], frozenset(at + x for x in good[4]), frozenset(at + x for x in good[5])))
        # Of one licence in one place the wording of which most is there, of such the first by rank.
        return [x for x in found if not any(y.holds(x) and (y.matched > x.matched or (y.matched == x.matched and y.license_id == x.license_id and (y.rank, y.begin) < (x.rank, x.begin))) for y in found)]

    def scan(self, text: str) -> Iterator[tuple]:
        """(first line, last line, license_id, rank, saved, template's words, matched, differences)."""
        t = _Text(text)
        if not t.cues or not t.words:
            return
        found: list[tuple[int, int, _Found]] = []
        for blocks in (t.near(), t.wide(self.reach)):
            for i, j, first, last in blocks:
                for r in self.licences(t, i, j):
                    # What stands in the same place is the same finding, or less of it.
                    if not any(f.matched >= r.matched and f.holds(r) for _, _, f in found):
                        found.append((first, last, r))
        for first, last, f in found:
            if not any(g.matched > f.matched and g.holds(f) for _, _, g in found):
                yield first, last, *f[:6]


class LicenseScan:
    """``scan(docs)``: one row per licence found in a block of a document; see the module."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES, share: float = SHARE) -> None:
        self.templates, self.share = tuple(templates), share

    def scan(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        prepare(docs.sparkSession)
        templates, share = self.templates, self.share

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(templates, share)
            for batch in batches:
                rows = [(d, *r) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for r in scanner.scan(t)]
                if rows:
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                    names = ["doc_id", "first_line", "last_line", "license_id", "rank", "saved_bytes", "template_words", "matched_words", "differences"]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(run), RESULT_SCHEMA)
