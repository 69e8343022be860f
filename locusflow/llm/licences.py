"""Licence notices in texts.

Text and templates are normalised to words of lower-case letters and digits. A passage matches a template when the
Dice coefficient of their sets of word bigrams reaches a threshold. A passage of n bigrams can only match templates
whose size lies within fixed ratios of n and of which it holds enough bigrams, so most templates and nearly all
passages are pruned by counting.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, mix, prepare

#: Least Dice coefficient.
THRESHOLD = 0.85

# Published notices and the usual short statements that name a licence.
TEMPLATES: dict[str, str] = {
    "MIT statement": "Released under the MIT License.",
    "Apache-2.0 statement": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 statement": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 statement": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        'of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
        "or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public "
        "License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        'the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS '
        "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
        "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
        "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT "
        'HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
        "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor "
        "the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
        'permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO "
        "EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
        "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public "
        "License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA "
        "02110-1301 USA."
    ),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser "
        "General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, "
        "Boston, MA 02110-1301 USA"
    ),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero "
        "General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/"
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the "
        "public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain "
        "Dedication along with this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
        "the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
        'software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"
    ),
    "BSL-1.0 statement": "Distributed under the Boost Software License, Version 1.0.",
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not "
        "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
        "the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must "
        "not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
}

_WORD = re.compile(r"[a-z0-9]+")

# Every byte but ASCII letters and digits separates words.
_GAP = np.ones(256, dtype=bool)
_GAP[48:58] = _GAP[97:123] = False


def normal(text: str) -> list[str]:
    """Words of lower-case ASCII letters and digits."""
    return _WORD.findall(_lower(text))


def _lower(text: str) -> str:
    return text.translate(_ASCII_LOWER)


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def _bigram_hashes(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * np.uint64(3) + words[1:]) if len(words) > 1 else words[:0]


class Matcher:
    """Templates as sets of bigrams, with the size bounds that prune them."""

    def __init__(self, templates: dict[str, str], threshold: float) -> None:
        self.threshold = threshold
        sized = []
        for name, text in templates.items():
            words = normal(text)
            grams = set(zip(words, words[1:]))
            if grams:
                sized.append((len(grams), name, grams))
        self.templates = sorted(sized, key=lambda x: (x[0], x[1]))
        self.grams = set().union(*(g for _, _, g in self.templates)) if self.templates else set()
        hashes = [_bigram_hashes(hash_words([t], _GAP)[0]) for t in templates.values()]
        self.hashes = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)
        ratio = threshold / (2 - threshold)
        self.bounds = [(n * ratio, n / ratio) for n, _, _ in self.templates]
        self.longest = max((high for _, high in self.bounds), default=0)
        # The same bounds for bigrams counted as often as they stand: a passage that repeats itself ends there.
        words = [len(normal(text)) for text in templates.values()]
        self.widest = int(max((n - 1) / ratio for n in words)) if words else 0

    def hit_texts(self, texts: list[str | None]) -> np.ndarray:
        """True for texts that hold any bigram of a template; hashes of a batch at once."""
        words, at = hash_words(texts, _GAP)
        out = np.zeros(len(texts), dtype=bool)
        if len(words) > 1 and len(self.hashes):
            grams = _bigram_hashes(words)
            place = np.minimum(np.searchsorted(self.hashes, grams), len(self.hashes) - 1)
            found = np.flatnonzero(self.hashes[place] == grams)
            out[np.searchsorted(at, found, side="right") - 1] = True
        return out

    def passages(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """Best matches that do not overlap: (template, start, end, Dice), by place; offsets in characters.

        Passages begin and end with a template's bigram, which loses nothing: without an outer bigram of no template
        the coefficient only grows. They are no longer than the size bounds allow, also where bigrams repeat. Of
        overlapping matches the higher coefficient wins, then the longer, then the earlier passage, then the template's
        name. Each start holds its best match only, and looks for the next best one when that overlaps a winner.
        """
        if not text:
            return []
        spots = [(m.start(), m.end()) for m in _WORD.finditer(_lower(text))]
        words = [text[a:b].lower() for a, b in spots]
        grams = list(zip(words, words[1:]))
        hits = [k for k, g in enumerate(grams) if g in self.grams]
        heap = [best for i in range(len(hits)) if (best := self._best(grams, hits, i, len(words)))]
        heapq.heapify(heap)
        out: list[tuple[str, int, int, float]] = []
        taken: list[tuple[int, int]] = []
        while heap:
            score, _, first, name, last, i = heapq.heappop(heap)
            at = bisect_right(taken, (first, len(words)))
            if at and taken[at - 1][1] >= first:
                continue
            free = taken[at][0] if at < len(taken) else len(words)
            if free > last + 1:
                taken.insert(at, (first, last + 1))
                out.append((name, spots[first][0], spots[last + 1][1], -score))
            elif best := self._best(grams, hits, i, free):
                heapq.heappush(heap, best)
        return sorted(out, key=lambda x: x[1])

    def _best(self, grams: list[tuple[str, str]], hits: list[int], i: int, free: int) -> tuple | None:
        """Best match that starts at hit ``i`` and ends before the word ``free``: (-Dice, -length, start, template, end, i)."""
        first = reach = hits[i]
        seen: set = set()
        best = None
        for j in range(i, len(hits)):
            last = hits[j]
            if last + 1 >= free or last - first >= self.widest:
                break
            seen.update(grams[reach : last + 1])
            reach = last + 1
            size = len(seen)
            if size > self.longest:
                break
            held = j - i + 1
            for (n, name, template), (low, high) in zip(self.templates, self.bounds):
                if low > size:
                    break
                if size <= high and 2 * held >= self.threshold * (size + n):
                    dice = 2 * len(seen & template) / (size + n)
                    if dice >= self.threshold:
                        found = (-dice, first - last, first, name, last, i)
                        best = found if best is None else min(best, found)
        return best


_HITS = "array<struct<template:string,start:int,end:int,dice:double>>"


def find_licences(
    docs: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD, as_column: str = "licences"
) -> DataFrame:
    """All rows and columns of ``docs`` plus ``as_column``: matches (template, start, end, dice) in order of place.

    A null or empty text, or one that holds no template's bigram, has an empty list. Texts are scanned whole, row by row;
    repeated rows, null ids and further columns pass unchanged. Templates are a bounded parameter and travel with the
    code; those with fewer than two words match nothing.
    """
    spark = docs.sparkSession
    prepare(spark)
    chosen = TEMPLATES if templates is None else templates

    @F.pandas_udf(_HITS)
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(chosen, threshold)
        for texts in batches:
            texts = texts.tolist()
            out = [
                [{"template": n, "start": a, "end": b, "dice": d} for n, a, b, d in matcher.passages(t)] if hit else []
                for t, hit in zip(texts, matcher.hit_texts(texts))
            ]
            yield pd.Series(out, dtype=object)

    return docs.withColumn(as_column, look(F.col(text_col).cast("string")))
