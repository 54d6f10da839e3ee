"""License scans by conditional compression.

Wherever a piece of a license template stands unchanged in a text, a window of the template's length is compared
with it: by the exact differences of wording, which also tell a changed license from an unchanged one, and by how
much smaller the window gets with the template as a raw zstandard dictionary, against the size of what it shares at
best.  Every template is compared, and what stands around a window does not count.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm.common import SLICE_ROWS, columns_of, text_slices, to_batch

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
_BSD_BODY = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""

_BSD_THIRD = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_ZLIB_BODY = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
The origin of this software must not be misrepresented; you must not claim that you wrote the original software."""
_BSL_BODY = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""
_MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"""
_EPL_NOTICE = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"""
_WTFPL_BODY = """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION You just DO WHAT THE FUCK YOU WANT TO."""


def _gnu_notice(kind: str, version: str) -> str:
    """The notice of another license of the GNU family, from that of the GPL."""
    return _GPL_NOTICE.replace("General Public License", f"{kind} General Public License".strip()).replace("version 3 ", f"version {version} ")


def _cc_notice(kind: str) -> str:
    return f"This work is licensed under a Creative Commons {kind} 4.0 International License."


# Identifiers of licenses that a line "SPDX-License-Identifier" may name.
_IDENTIFIERS = (
    "MIT", "MIT-0", "ISC", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "Apache-2.0", "MPL-2.0", "EPL-2.0", "Zlib", "BSL-1.0", "Unlicense", "WTFPL", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0",
    "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later",
    "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0",
)


def _family(identifier: str) -> str:
    """The license of an identifier, whether or not later versions may be chosen."""
    return identifier.removesuffix("-only").removesuffix("-or-later")


# Wording of public license notices, (license, template).
TEMPLATES = (
    ("MIT", _MIT_BODY),
    ("MIT", "Released under the MIT License."),
    ("ISC", _ISC_BODY),
    ("BSD-2-Clause", _BSD_BODY),
    ("BSD-3-Clause", f"{_BSD_BODY}\n{_BSD_THIRD}"),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", _GPL_NOTICE),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", _gnu_notice("", "2")),
    ("LGPL-2.1", _gnu_notice("Lesser", "2.1")),
    ("LGPL-3.0", _gnu_notice("Lesser", "3")),
    ("AGPL-3.0", _gnu_notice("Affero", "3")),
    ("MPL-2.0", _MPL_NOTICE),
    ("EPL-2.0", _EPL_NOTICE),
    ("Zlib", _ZLIB_BODY),
    ("BSL-1.0", _BSL_BODY),
    ("WTFPL", _WTFPL_BODY),
    ("CC-BY-4.0", _cc_notice("Attribution")),
    ("CC-BY-SA-4.0", _cc_notice("Attribution-ShareAlike")),
    ("CC-BY-NC-4.0", _cc_notice("Attribution-NonCommercial")),
    ("CC-BY-ND-4.0", _cc_notice("Attribution-NoDerivatives")),
    ("CC-BY-NC-SA-4.0", _cc_notice("Attribution-NonCommercial-ShareAlike")),
    ("CC-BY-NC-ND-4.0", _cc_notice("Attribution-NonCommercial-NoDerivatives")),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    *((_family(x), f"SPDX-License-Identifier: {x}") for x in _IDENTIFIERS),
)
_TELLING = re.compile(
    r"licen[cs]e|copyright|\(c\)|©|rights\W+reserved|permission|warrant|liabilit|liable|redistribut|public\W+domain|creative\W+commons|\bcc[\s-]?(by|0)|conditions|spdx", re.IGNORECASE
)
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Words in lower case; what white space, other signs and capitals do is no difference of wording."""
    return _WORD.findall(text.lower())


def _telling_runs(text: str | None, gap: int) -> list[list[int]]:
    """First and last line of each run of telling lines with no more than ``gap`` other lines between two of them."""
    out: list[list[int]] = []
    line = at = 0
    for m in _TELLING.finditer(text or ""):
        line, at = line + text.count("\n", at, m.start()), m.start()
        last = line + m[0].count("\n")  # line breaks and signs part the words of a phrase as spaces do
        if out and line - out[-1][1] <= gap + 1:
            out[-1][1] = last
        else:
            out.append([line, last])
    return out


class _Template:
    """A template's words, the most that may differ, and how much smaller its own words become with it as the dictionary."""

    def __init__(self, name: str, wanted: list[str], most: int, level: int):
        import zstandard as zstd

        self.name, self.wanted, self.most = name, wanted, most
        data = " ".join(wanted).encode("utf-8", "surrogatepass")

        def compressor(raw):
            raw = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            return zstd.ZstdCompressor(level=level, dict_data=raw, write_content_size=False, write_dict_id=False)

        # The other dictionary is as long and has the same letters, but no word of the template.
        self._with, self._other = compressor(data), compressor(data[::-1])
        self.own, self.rate = 1.0, 1.0
        self.own, self.rate = self.reduction(wanted)

    def reduction(self, words) -> tuple[float, float]:
        """Bytes that the template as dictionary saves on words, more than an unrelated one of its length does, and their share
        of all; both over what they are for the template's own words."""
        data = " ".join(words).encode("utf-8", "surrogatepass")
        size = len(self._other.compress(data))
        saved = max(0, size - len(self._with.compress(data)))
        return saved / max(self.own, 1e-9), saved / size / max(self.rate, 1e-9)


@lru_cache(maxsize=4)
def _compressors(templates: tuple[tuple[str, str], ...], most_changed: float, level: int = 3):
    """The templates with their dictionaries, and their pieces.

    A template of which at most k words differ, cut into k + 1 pieces, has a piece without a difference.  Pieces are
    kept by how many first words they are known by, three at most, and by these.
    """
    if not 0 <= most_changed < 1:
        raise ValueError("most_changed must be at least 0 and below 1")
    out, pieces = [], []
    for name, body in templates:
        if wanted := words_of(body):
            most = int(most_changed * len(wanted))
            cuts = [len(wanted) * i // (most + 1) for i in range(most + 2)]
            pieces += [(len(out), a, wanted[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            out.append(_Template(name, wanted, most, level))
    by_start: dict[int, dict[tuple[str, ...], list]] = {}
    for piece in pieces:
        width = min(3, len(piece[2]))
        by_start.setdefault(width, {}).setdefault(tuple(piece[2][:width]), []).append(piece)
    return out, by_start


def _fit(template: list[str], block: list[str]) -> tuple[int, int]:
    """Least number of words to add, drop or change to turn the template into some run of the block's words, and the end of that run."""
    code: dict[str, int] = {}
    wanted = [code.setdefault(w, len(code)) for w in template]
    b = np.array([code.get(w, -1) for w in block], dtype=np.int64)
    place = np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, dtype=np.int64)  # a run may begin anywhere
    for i, t in enumerate(wanted, 1):
        new = np.minimum(row + 1, np.concatenate([[i], row[:-1] + (b != t)]))
        row = np.minimum.accumulate(new - place) + place
    end = int(row.argmin())
    return int(row[end]), end


def wording_differences(template: list[str], block: list[str]) -> int:
    """Least number of words to add, drop or change to turn the template into some run of the block's words."""
    return _fit(template, block)[0]


def candidates(words: list[str], known: list[_Template], by_start: dict) -> list[tuple[float, int, int, int]]:
    """(share, template, begin, end) of windows of a template's length where a piece of it stands unchanged, by falling share.

    The share is the window's reduction over that of the template's own words, in bytes or in bytes a byte, whichever is less: 1
    where it stands word by word, less where words are missing or other words lie between.  Of equal shares the longer template comes first, then the one that is listed first.
    """
    begins: dict[int, set[int]] = {}
    here = set(words)
    for width, starts in by_start.items():
        if any(here.issuperset(start) for start in starts):
            for i, start in enumerate(zip(*(words[n:] for n in range(width)), strict=False)):
                for k, at, piece in starts.get(start, ()):
                    if words[i : i + len(piece)] == piece:
                        begins.setdefault(k, set()).add(i - at)
    out, saved = [], {}
    for k, found in begins.items():
        t = known[k]
        near: list[list[int]] = []  # beginnings of one copy lie within 2 * most words
        for begin in sorted(found):
            if near and begin - near[-1][0] <= 2 * t.most:
                near[-1][1] = begin
            else:
                near.append([begin, begin])
        for begin, end in near:
            window = tuple(words[max(0, begin) : end + len(t.wanted)])
            if (k, window) not in saved:  # the same words again have the same result
                saved[k, window] = min(t.reduction(window))
            out.append((saved[k, window], k, begin, end))
    return sorted(out, key=lambda c: (-c[0], -len(known[c[1]].wanted), c[1], c[2]))


def scan(blocks: list[str], templates=TEMPLATES, least_saved: float = 0.25, most_changed: float = 0.15) -> list[tuple[str, float, int, int]]:
    """(license, share saved, differing words, words of the template) of each license found in blocks.

    Windows of a template's length are taken wherever a piece of it stands unchanged, which no run of words with up
    to ``most_changed`` of the template's words differing can escape, however long its line and whatever stands
    around it.  They are compressed with the template as dictionary and ranked by the reduction (:func:`candidates`); those of at
    least ``least_saved`` are confirmed word by word in that order, and a confirmed one owns its words: a later one of which over half the
    words are owned by other licenses is left out.  One entry a license, the one with the fewest differences.
    """
    known, by_start = _compressors(tuple(templates), most_changed)
    best: dict[str, tuple] = {}
    for block in blocks:
        words, owner = words_of(block), {}  # the license that a word belongs to
        fits: dict[tuple, tuple[int, int]] = {}
        for share, k, begin, end in candidates(words, known, by_start):
            if share < least_saved:
                break
            t = known[k]
            begin, end = max(0, begin - t.most), end + len(t.wanted) + t.most
            window = (k, tuple(words[begin:end]))
            if window not in fits:
                fits[window] = _fit(t.wanted, list(window[1]))
            off, last = fits[window]
            if off > t.most:
                continue
            run = range(begin + max(0, last - len(t.wanted)), begin + last)
            if 2 * sum(owner.get(i, t.name) != t.name for i in run) <= len(run):
                for i in run:
                    owner.setdefault(i, t.name)
                entry = (off / len(t.wanted), -share, t.name, off, len(t.wanted))
                best[t.name] = min(best.get(t.name, entry), entry)
    return [(name, -b[1], b[3], b[4]) for name, b in sorted(best.items())]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_blocks, licenses, exact_licenses, n_differences, found.

    n_blocks: runs of lines that speak of licensing; licenses: names of confirmed licenses in order, joined by
    commas; exact_licenses: those without any differing word; n_differences: differing words of all; found: a struct
    for each with its measures.  Whole texts are scanned, not only their blocks.  A null or empty text has no blocks; null ids and repeated rows have their rows; an empty table gives
    an empty result; other columns are not read.
    """
    item = pa.struct([("license", pa.string()), ("saved", pa.float64()), ("differences", pa.int64()), ("template_words", pa.int64())])
    schema = pa.schema([("id", pa.int64()), ("n_blocks", pa.int64()), ("licenses", pa.string()), ("exact_licenses", pa.string()), ("n_differences", pa.int64()), ("found", pa.list_(item))])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 1, rows=SLICE_ROWS):
                texts = part.column(1).to_pylist()
                found = [scan([t] if t else [], templates) for t in texts]
                yield to_batch(
                    schema,
                    id=part.column(0),
                    n_blocks=[len(_telling_runs(t, 2)) for t in texts],
                    licenses=[",".join(x[0] for x in f) for f in found],
                    exact_licenses=[",".join(x[0] for x in f if x[2] == 0) for f in found],
                    n_differences=[sum(x[2] for x in f) for f in found],
                    found=[[dict(zip(("license", "saved", "differences", "template_words"), x, strict=True)) for x in f] for f in found],
                )

    fields = "id long, n_blocks long, licenses string, exact_licenses string, n_differences long, found array<struct<license:string,saved:double,differences:long,template_words:long>>"
    return columns_of(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, fields).withColumnRenamed("id", id_col)
