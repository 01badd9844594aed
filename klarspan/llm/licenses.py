"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Units of a document are its lines, its sentences (up to `.`, `!` or `?` before white space), runs of up to RUN
neighbouring paragraphs (between blank lines; those without words do not count) and its whole text, so that a licence of
several paragraphs is found between code or prose. A unit and a template have
sets of bigrams of normalised words (A-Z lower-cased, runs of ASCII letters, digits and non-ASCII characters). At
threshold t, a template of a bigrams can only match units of t/(2-t)*a to (2-t)/t*a bigrams; units outside every
template's bounds, or with too few bigrams that any template has, are never compared.

Null or empty text, and units or templates of fewer than two words, match nothing. Ties go to the template whose name
sorts first. Repeated rows each give a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from klarspan.llm import common as C

THRESHOLD = 0.8
#: Neighbouring paragraphs that are compared as one unit, at most.
RUN = 6

# Wordings of public licences and of the notices that refer to them.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THREE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
TEMPLATES = (
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", f"{_BSD_TWO} {_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"{_BSD_TWO} {_BSD_THREE} {_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", _GPL.format(2)),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", _GPL.format(3)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", _ISC),
    ("MIT", f"{_MIT_GRANT} {_MIT_DISCLAIMER}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

_SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_NEXT = np.uint64(0x9E3779B97F4A7C15)


def _bigrams(raw: np.ndarray, offsets: np.ndarray):
    """Hashes of the pairs of neighbouring words, where each pair starts and ends, and its document."""
    raw = _LOWER[raw]
    starts, ends, doc = C.word_spans(raw, offsets, _SEPARATOR)
    words = C.word_hashes(raw, starts, ends)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    return C.mix(words[pair] * _NEXT + words[pair + 1]), starts[pair], starts[pair + 1], doc[pair]


def _template_sets(templates) -> list[tuple[str, np.ndarray]]:
    found = [(name, np.unique(_bigrams(*C.buffer_of(pa.array([text])))[0])) for name, text in templates]
    return [(name, grams) for name, grams in found if len(grams)]


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license (of the best match; null if none), dice (its coefficient), n_units (units with a match) and
    licenses (all that match, sorted, comma-joined)."""
    docs = docs.select("doc_id", "text")
    sets = _template_sets(templates)
    known = np.unique(np.concatenate([g for _, g in sets])) if sets else np.zeros(0, np.uint64)
    # a little less than the bound, so that rounding never refuses a tie; the exact Dice decides
    ratio = threshold / (2 - threshold) * (1 - 1e-9)
    least = min((ratio * len(g) for _, g in sets), default=np.inf)  # hits that any match must have

    def matches(grams: np.ndarray):
        n = len(grams)
        for name, of in sets:
            if ratio * len(of) <= n <= len(of) / ratio:
                dice = 2.0 * int(np.isin(grams, of, assume_unique=True).sum()) / (n + len(of))
                if dice >= threshold:
                    yield name, dice

    def scan(raw: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        grams, begin, second, doc = _bigrams(raw, offsets)
        hit = np.isin(grams, known)
        total = np.concatenate([[0], np.cumsum(hit)])
        newline = np.flatnonzero(raw == 10)
        line = lambda at: np.searchsorted(newline, at)
        doc = doc.astype(np.int64)
        first_line, second_line = line(begin), line(second)
        # a line break followed by white space up to another one ends a paragraph
        text = np.flatnonzero(~C.SPACE[raw])
        between = np.searchsorted(text, newline)
        blank = newline[1:][between[1:] == between[:-1]] if len(newline) > 1 else newline[:0]
        stop = np.flatnonzero(_STOP[raw[:-1]] & C.SPACE[raw[1:]]) if len(raw) else newline
        found: list[dict] = [{} for _ in range(len(offsets) - 1)]
        units = [0] * (len(offsets) - 1)

        def runs():
            """Units as the first and last place of their bigrams."""
            whole = doc << 32
            kinds = ((whole | first_line, whole | second_line, 1), (whole | np.searchsorted(stop, begin), whole | np.searchsorted(stop, second), 1), (whole | np.searchsorted(blank, begin), whole | np.searchsorted(blank, second), RUN), (whole, whole, 1))
            for a, b, most in kinds:
                parts = np.unique(np.concatenate([a, b]))  # those with words, numbered in order
                a, b, of = np.searchsorted(parts, a), np.searchsorted(parts, b), parts >> 32
                for n in range(1, min(most, len(of)) + 1):
                    first = np.flatnonzero(of[n - 1 :] == of[: len(of) - n + 1])
                    lo, hi = np.searchsorted(a, first), np.searchsorted(b, first + n - 1, "right")
                    likely = np.flatnonzero((hi > lo) & (total[hi] - total[lo] >= least))
                    yield from zip(lo[likely].tolist(), hi[likely].tolist())

        for lo, hi in runs():
            own = np.unique(grams[lo:hi])
            if total[hi] - total[lo] < ratio * len(own):
                continue
            d, any_match = int(doc[lo]), False
            for name, dice in matches(own):
                any_match = True
                found[d][name] = max(dice, found[d].get(name, 0.0))
            units[d] += any_match
        out = []
        for names, n in zip(found, units):
            best = min(names, key=lambda x: (-names[x], x), default=None)
            out.append((best, names.get(best), n, ",".join(sorted(names))))
        return out

    kinds = (("license", "string", pa.string()), ("dice", "double", pa.float64()), ("n_units", "long", pa.int64()), ("licenses", "string", pa.string()))

    def run(batches):
        for b in batches:
            raw, offsets = C.buffer_of(b["text"])
            rows = [r for lo, hi in C.chunks(offsets) for r in scan(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array([r[i] for r in rows], t) for i, (_, _, t) in enumerate(kinds))], ["doc_id", *(n for n, _, _ in kinds)])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t, _ in kinds))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WORDS = r"list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
ORACLE = f"""
WITH template(name, body) AS (VALUES {", ".join(f"({_sql_text(n)}, {_sql_text(t)})" for n, t in TEMPLATES)}),
twords AS (SELECT row_number() OVER () AS t, name, {_WORDS.format("body")} AS w FROM template),
tgram AS (SELECT DISTINCT t, name, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM twords),
tsize AS (SELECT t, count(*) AS a FROM tgram GROUP BY t),
doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
para AS (SELECT r, list_filter(regexp_split_to_array(text, '\\n[\\x20\\x09-\\x0D]*\\n'), lambda x: regexp_matches(x, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]')) AS p FROM doc),
unit AS (SELECT row_number() OVER () AS u, r, body FROM (
  SELECT r, unnest(string_split(text, chr(10))) AS body FROM doc
  UNION ALL SELECT r, unnest(regexp_split_to_array(text, '[.!?][\\x20\\x09-\\x0D]+')) AS body FROM doc
  UNION ALL SELECT r, array_to_string(p[i:i + n - 1], ' ') AS body FROM para, range(1, {RUN + 1}) AS s(n), unnest(range(1, len(p) - n + 2)) AS t(i)
  UNION ALL SELECT r, text AS body FROM doc)),
uwords AS (SELECT u, r, {_WORDS.format("body")} AS w FROM unit),
ugram AS (SELECT DISTINCT u, r, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM uwords),
usize AS (SELECT u, count(*) AS b FROM ugram GROUP BY u),
shared AS (SELECT u, r, t, name, count(*) AS n FROM ugram JOIN tgram USING (g) GROUP BY ALL),
hit AS (SELECT r, u, name, 2.0::DOUBLE * n / (a + b) AS dice FROM shared JOIN tsize USING (t) JOIN usize USING (u) WHERE 2.0::DOUBLE * n / (a + b) >= {THRESHOLD}),
named AS (SELECT r, name, max(dice) AS dice FROM hit GROUP BY ALL),
best AS (SELECT r, first(name ORDER BY dice DESC, name) AS license, max(dice) AS dice, string_agg(name, ',' ORDER BY name) AS licenses FROM named GROUP BY r),
units AS (SELECT r, count(DISTINCT u) AS n_units FROM hit GROUP BY r)
SELECT doc_id, license, dice, coalesce(n_units, 0) AS n_units, coalesce(licenses, '') AS licenses FROM doc LEFT JOIN best USING (r) LEFT JOIN units USING (r)
"""
