"""License scans: winnowed fingerprints, then banded alignment.

Templates are word sequences: whole licenses and the notices that stand for one.  Hashes of every three words are winnowed (the smaller of each two
neighbours), and the inverted index from these fingerprints to (template, place) picks candidates:
any four words that a document shares with a template have a fingerprint in common.  Templates of one or two words are indexed whole.
Every diagonal with a hit is aligned with the template inside a band by
dynamic programming, which may begin or end inside the template where the document does.  Of alignments that overlap in the document
the one with the most matched words stands, whichever template it is of.  Reported: matched words / template words, and the span in words and
characters of the document.

The index is a constant of the template list (some thousand entries) and is shipped with the task;
documents run in one narrow pass, without a shuffle.

Defined cases: null or empty text matches nothing; texts of any length are scanned whole; repeated rows are reported each; a template met
twice in a document is reported for each place; of overlapping matches with equally many words the template first by name, then the first in the text, is reported;
columns other than doc_id and text are not read, so none can clash; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewright.llm.common import PLAIN, byte_slices, gram_hashes, id_text, plain_words, word_hashes

GRAM, WINDOW, BAND, COVERAGE = 3, 2, 8, 0.8

#: Public license texts and notices.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit-notice": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "unlicense-notice": "This is free and unencumbered software released into the public domain.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the winnowed values: the rightmost smallest of every window."""
    if len(h) <= window:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))]) if len(h) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(axis=1))


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first text word, end) of the best alignment of the template inside ``text``.

    Only cells within ``band`` of the diagonal ``text place = template place + shift`` are filled;
    a match gains 2, a gap or substitution costs 1, and text before and after is free.  Where the text begins
    inside the template, the template words before it are gaps.
    """
    n, m = len(template), len(text)
    template, text = template.tolist(), text.tolist()
    # cell: (score, matches, first matched text word, end of the last)
    fresh = (0, 0, -1, -1)
    before = {j: fresh for j in range(max(0, shift - band), min(m, shift + band) + 1)}
    best = fresh
    for i in range(1, n + 1):
        now: dict[int, tuple[int, int, int, int]] = {}
        for j in range(max(0, i + shift - band), min(m, i + shift + band) + 1):
            cell = (-i, 0, -1, -1)
            if j in before:
                s, k, first, last = before[j]
                cell = max(cell, (s - 1, k, first, last))
            if j and (j - 1) in before:
                s, k, first, last = before[j - 1]
                hit = template[i - 1] == text[j - 1]
                cell = max(cell, (s + 2, k + 1, j - 1 if first < 0 else first, j) if hit else (s - 1, k, first, last))
            if (j - 1) in now:
                s, k, first, last = now[j - 1]
                cell = max(cell, (s - 1, k, first, last))
            now[j] = cell
        before = now
        if now:
            best = max(best, max(now.values()))
    return best[1], best[2], best[3]


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.names = sorted(templates)
        self.words = [word_hashes(plain_words(templates[n])) for n in self.names]
        #: by words in a fingerprint: sorted fingerprints, and (template, place) of each
        self.index: dict[int, tuple[np.ndarray, dict[int, list[tuple[int, int]]]]] = {}
        for gram in sorted({min(GRAM, len(h)) for h in self.words if len(h)}):
            found: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for t, h in enumerate(self.words):
                if min(GRAM, len(h)) == gram:
                    grams = gram_hashes(h, gram)
                    for p in self._chosen(grams, gram).tolist():
                        found[int(grams[p])].append((t, p))
            self.index[gram] = np.array(sorted(found), dtype=np.uint64), found

    @staticmethod
    def _chosen(grams: np.ndarray, gram: int) -> np.ndarray:
        return winnow(grams) if gram == GRAM else np.arange(len(grams))

    def _hits(self, h: np.ndarray) -> dict[int, set[int]]:
        """Diagonals (text place less template place) on which each template has a fingerprint."""
        hits: dict[int, set[int]] = defaultdict(set)
        for gram, (keys, found) in self.index.items():
            grams = gram_hashes(h, gram)
            if not len(grams):
                continue
            at = self._chosen(grams, gram)
            k = np.minimum(np.searchsorted(keys, grams[at]), len(keys) - 1)
            for p in at[keys[k] == grams[at]].tolist():
                for t, q in found[int(grams[p])]:
                    hits[t].add(p - q)
        return hits

    def scan(self, text: str, coverage: float = COVERAGE) -> list[tuple]:
        """(template, template words, matched words, coverage, first word, end word, first character, end character)."""
        low = text.lower()
        if len(low) != len(text):
            # letters whose lower case is longer stay, so that places are those of the text
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        h = word_hashes(PLAIN.findall(low))
        out = set()
        for t, shifts in self._hits(h).items():
            own = self.words[t]
            band = min(BAND, max(1, len(own) // 2))
            for shift in sorted(shifts):
                start = max(0, shift - band)
                region = h[start : max(start, shift + len(own) + band)]
                matched, first, end = align(own, region, shift - start, band)
                if matched and matched >= coverage * len(own):
                    out.add((t, matched, first + start, end + start))
        if not out:
            return []
        spans = [m.span() for m in PLAIN.finditer(low)]
        stays: list[tuple] = []
        for t, matched, first, end in sorted(out, key=lambda x: (-x[1], self.names[x[0]], x[2], x[3])):
            if all(end <= y[4] or y[5] <= first for y in stays):
                n = len(self.words[t])
                stays.append((self.names[t], n, matched, matched / n, first, end, spans[first][0], spans[end - 1][1]))
        return sorted(stays, key=lambda x: (x[4], x[0]))


ROWS = "doc_id long, license string, template_words int, matched_words int, coverage double, first_word int, end_word int, first_char int, end_char int"


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """A row for each place of each document where a template is covered to ``coverage``."""

    def go(batches):
        scanner = Scanner(templates)
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        names = [x.split(" ")[0] for x in ROWS.split(", ")]
        for ids, texts in byte_slices(batches):
            found = [(d, *x) for d, t in zip(ids, texts) for x in scanner.scan(t, coverage)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

    return id_text(docs).mapInArrow(go, ROWS)
