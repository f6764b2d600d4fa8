"""License scans by conditional compression.

Candidate blocks stand around the stems that license wording has: the sentence
of a stem of short wordings, and as much text on either side of a stem of long
ones as the longest template has.  A block is compressed alone and with each
template as a raw zstandard dictionary; templates are ranked by the share of
the size that they take off.  A winner is confirmed by its exact wording
differences: the least word edits (missing, inserted and changed words) between
the template and any run of the block's words, found by dynamic programming.
At most ``EDITS`` of the template's words may differ, and its key words (names
and version numbers) not at all.  What stands before and after a confirmed
winner is searched again until nothing more is confirmed; a block of more than
``WINDOW`` characters is searched in overlapping windows.

Cases: a null or empty text has no blocks; repeated rows are scanned each; of
templates with equal reductions the first by name is tried first; of equally
good places the first counts; very long texts are searched whole, only the
blocks are compressed; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.wordhash import tidy

_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_MIT_END = ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."

#: License wordings: name, key words that must be unchanged, text. Fixed values.
TEMPLATES = (
    ("all-rights-reserved", "reserved", "All rights reserved."),
    ("apache-2.0-notice", "apache 2.0", _APACHE),
    ("agpl-3.0-notice", "gnu affero 3", _FREE.format("Affero ", 3)),
    ("bsd-2-clause-text", "redistributions binary disclaimer", _BSD + _BSD_END),
    ("bsd-3-clause-text", "redistributions binary neither endorse", _BSD + _BSD_NAMES + _BSD_END),
    ("cc0-1.0", "cc0 1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("gpl-2.0", "gnu general 2", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0-notice", "gnu general 2", _FREE.format("", 2)),
    ("gpl-3.0", "gnu general 3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-notice", "gnu general 3", _FREE.format("", 3)),
    ("lgpl-3.0", "gnu lesser 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl-3.0-notice", "gnu lesser 3", _FREE.format("Lesser ", 3)),
    ("agpl-3.0", "gnu affero 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("isc-text", "fee granted", _ISC),
    ("mit-notice", "permission sublicense", _MIT),
    ("mit-text", "permission sublicense merchantability", _MIT + _MIT_END),
    ("mpl-2.0", "mozilla 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ogl-3.0", "government 3.0", "Contains public sector information licensed under the Open Government Licence v3.0."),
    ("unlicense-text", "unencumbered", _UNLICENSE),
)
#: Names of licenses as sentences give them: name, key words, how it is called, SPDX tag. Fixed values.
NAMED = (
    ("agpl-3.0", "gnu affero 3", "GNU Affero General Public License, version 3", "AGPL-3.0"),
    ("apache-2.0", "apache 2.0", "Apache License, Version 2.0", "Apache-2.0"),
    ("bsd-2-clause", "bsd 2-clause", "BSD 2-Clause License", "BSD-2-Clause"),
    ("bsd-3-clause", "bsd 3-clause", "BSD 3-Clause License", "BSD-3-Clause"),
    ("cc-by-4.0", "cc by 4.0", "CC BY 4.0", "CC-BY-4.0"),
    ("cc-by-nc-4.0", "cc by-nc 4.0", "CC BY-NC 4.0", "CC-BY-NC-4.0"),
    ("cc-by-nc-sa-4.0", "cc by-nc-sa 4.0", "CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"),
    ("cc-by-nd-4.0", "cc by-nd 4.0", "CC BY-ND 4.0", "CC-BY-ND-4.0"),
    ("cc-by-sa-4.0", "cc by-sa 4.0", "CC BY-SA 4.0", "CC-BY-SA-4.0"),
    ("cc0-1.0", "cc0 1.0", "CC0 1.0 Universal", "CC0-1.0"),
    ("gpl-2.0", "gnu general 2", "GNU General Public License, version 2", "GPL-2.0"),
    ("gpl-3.0", "gnu general 3", "GNU General Public License, version 3", "GPL-3.0"),
    ("isc", "isc", "ISC License", "ISC"),
    ("lgpl-3.0", "gnu lesser 3", "GNU Lesser General Public License, version 3", "LGPL-3.0"),
    ("mit", "mit", "MIT License", "MIT"),
    ("mpl-2.0", "mozilla 2.0", "Mozilla Public License, version 2.0", "MPL-2.0"),
    ("ogl-3.0", "government 3.0", "Open Government Licence v3.0", "OGL-UK-3.0"),
)
#: What stands before a license's name. Fixed values.
SAID = ("Licensed under {0}.", "Licensed under the {0}.", "Released under {0}.", "Released under the {0}.", "Distributed under the {0}.", "Available under the {0}.")
#: Long forms of Creative Commons names: tag, words. Fixed values.
LONG_NAMES = (
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International"),
    ("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("cc-by-nc-sa-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International"),
    ("cc-by-nd-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International"),
    ("cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
)
#: Stems of short wordings, and of those of several sentences, in lower case. Fixed values.
STEMS = ("license", "licence", "rights reserved", "public domain", "released under", "distributed under", "available under", "creative commons", "free software")
LONG_STEMS = ("permission is hereby", "permission to use", "compliance with the license", "redistribution and use", "unencumbered software")
#: Of a template's words at most this share may be missing, changed or have others put between.
EDITS = 0.15
#: Characters of a block that are compared at once.
WINDOW = 12_000
#: Characters on either side of a stem that its sentence may have.
SENTENCE = 600

_WORD = re.compile(r"[a-z0-9]+(?:[-.][a-z0-9]+)*")
_END = re.compile(r"(?<!\bv)[.!?][)\"']?\s|\n\s*\n")
_NEVER = 1 << 20


def wording(text: str) -> list[tuple[str, int, int]]:
    """Words in lower case with their places."""
    out = []
    for m in _WORD.finditer(text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text)):
        w = m[0].replace("licence", "license")
        if w.startswith("v") and w[1:2].isdigit():
            out += [("v", m.start(), m.start() + 1), (w[1:], m.start() + 1, m.end())]
        else:
            out.append(("v" if w == "version" else w, m.start(), m.end()))
    return out


@dataclass
class Template:
    name: str
    words: list[str]
    keys: set[str]
    code: zstandard.ZstdCompressor


def wordings() -> list[tuple[str, str, str]]:
    """All templates: name, key words, text."""
    out = list(TEMPLATES)
    for name, keys, called, tag in NAMED:
        out += [(name, keys, form.format(called)) for form in SAID]
        out.append((name, tag.lower(), f"SPDX-License-Identifier: {tag}"))
    for name, called in LONG_NAMES:
        out.append((name, called.lower(), f"Licensed under a {called} License."))
        out.append((name, called.lower(), called))
    return out


def compiled() -> list[Template]:
    out = []
    for name, keys, text in wordings():
        d = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append(Template(name, [w for w, _, _ in wording(text)], set(keys.split()), zstandard.ZstdCompressor(level=3, dict_data=d)))
    return out


_LONGEST = max(len(t) for _, _, t in TEMPLATES)


def blocks(text: str) -> list[tuple[int, int]]:
    """Candidate blocks, joined where they overlap."""
    low = text.lower()
    if len(low) != len(text):  # a few letters change length
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    own = []
    for stems, reach in ((STEMS, SENTENCE), (LONG_STEMS, 2 * _LONGEST)):
        for stem in stems:
            i = low.find(stem)
            while i >= 0:
                lo, hi = max(0, i - reach), min(len(text), i + reach)
                if stems is STEMS:
                    before = [m.end() for m in _END.finditer(text, lo, i)]
                    after = _END.search(text, i, hi)
                    lo, hi = before[-1] if before else lo, after.end() if after else hi
                own.append((lo, hi))
                i = low.find(stem, i + len(stem))
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(own):
        if out and lo < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


@dataclass
class Place:
    start: int
    end: int
    missing: list[str]
    inserted: list[str]


def confirm(words: list[tuple[str, int, int]], template: Template) -> Place | None:
    """The run of words nearest to the template and how it differs; None if by too much or in a key word."""
    want, allowed = template.words, int(EDITS * len(template.words))
    here = {w for w, _, _ in words}
    if sum(w not in here for w in want) > allowed or any(k not in here for k in template.keys):
        return None
    codes = {w: i for i, w in enumerate(here)}
    text = np.array([codes[w] for w, _, _ in words])
    at = np.arange(len(words) + 1)
    cost = np.zeros((len(want) + 1, len(words) + 1), np.int32)  # edits of the template's first i words against a run that ends before j
    for i, w in enumerate(want):
        lost = _NEVER if w in template.keys else 1
        step = cost[i] + lost
        step[1:] = np.minimum(step[1:], cost[i, :-1] + np.where(text == codes.get(w, -1), 0, lost))
        cost[i + 1] = np.minimum.accumulate(step - at) + at
    j = int(cost[-1].argmin())
    if cost[-1, j] > allowed:
        return None
    i, last, missing, inserted = len(want), j, [], []
    while i:
        lost = _NEVER if want[i - 1] in template.keys else 1
        if j and cost[i, j] == cost[i - 1, j - 1] + (0 if words[j - 1][0] == want[i - 1] else lost):
            if words[j - 1][0] != want[i - 1]:
                missing.append(want[i - 1])
                inserted.append(words[j - 1][0])
            i, j = i - 1, j - 1
        elif cost[i, j] == cost[i - 1, j] + lost:
            missing.append(want[i - 1])
            i -= 1
        else:
            inserted.append(words[j - 1][0])
            j -= 1
    return Place(words[j][1], words[last - 1][2], missing[::-1], inserted[::-1]) if last > j else None


def _search(text: str, lo: int, hi: int, templates: list[Template], plain: zstandard.ZstdCompressor) -> list[tuple[int, int, str, Place]]:
    """All confirmed licenses of one window."""
    found, todo = [], [(lo, hi)]
    while todo:
        lo, hi = todo.pop()
        words = wording(text[lo:hi])
        if not words:
            continue
        block = text[lo:hi].lower().encode("utf-8", "replace")
        alone = len(plain.compress(block))
        ranked = sorted((-(alone - len(t.code.compress(block))) / alone, t.name, i) for i, t in enumerate(templates))
        for _, _, i in ranked:  # in a long block a short wording may take off nothing
            if place := confirm(words, templates[i]):
                place = Place(lo + place.start, lo + place.end, place.missing, place.inserted)
                found.append((place.start, place.end, templates[i].name, place))
                # what stands before or after the winner may hold another
                todo += [(lo, place.start), (place.end, hi)]
                break
    return sorted(found, key=lambda g: g[:3])


def scan(text: str, templates: list[Template], plain: zstandard.ZstdCompressor) -> tuple[int, list[tuple[int, int, str, Place]]]:
    """The number of candidate blocks and the confirmed licenses (start, end, name, differences) in code points.

    A long block is searched in windows that overlap by more than any template has.
    """
    found = []
    cuts = blocks(text)
    for at, hi in cuts:
        while at < hi:
            to = min(at + WINDOW, hi)
            sure = to if to == hi else to - 2 * _LONGEST
            got = [g for g in _search(text, at, to, templates, plain) if g[0] < sure]
            found += got
            at = max([sure, *(g[1] for g in got)])
    return len(cuts), found


@tidy
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    templates, plain = compiled(), zstandard.ZstdCompressor(level=3)
    for batch in batches:
        n, names, spans, count, differ = [], [], [], [], []
        for text in batch.column("text"):
            blocks_seen, got = scan(text.as_py() or "", templates, plain)
            n.append(blocks_seen)
            count.append(len(got))
            names.append(",".join(sorted({g[2] for g in got})))
            spans.append(",".join(f"{k}:{a}:{b}" for a, b, k, _ in got))
            differ.append(",".join(" ".join([f"-{w}" for w in p.missing] + [f"+{w}" for w in p.inserted]) for _, _, _, p in got))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(count, pa.int64()), *(pa.array(x, pa.string()) for x in (names, spans, differ))],
            names=["doc_id", "n_blocks", "n_licenses", "licenses", "spans", "differences"],
        )


def scan_licenses(documents: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_blocks, n_licenses, licenses (names, sorted), spans (name:start:end), differences.

    ``differences`` has, for each span, the template's words that are missing
    (``-word``) and those put in (``+word``); it is empty for exact wording.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scan, "doc_id long, n_blocks long, n_licenses long, licenses string, spans string, differences string")
