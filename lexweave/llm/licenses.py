"""License scan: MinHash bands over overlapping text windows, then exact shingle containment.

Templates fall into classes by the number of their shingles (powers of two); a class's windows are
as many shingles long as its longest templates can be, and start at every eighth part of that
length. Each window gets one min-hash for each band. The number of bands is set so that a window that
overlaps a passage holding the wanted part of a template collides with it in some band with a
chance of at least `chance`; what collides is compared exactly: the template's shingles that
occur in the window and its surroundings of one step. Words are compared without case and punctuation.

Templates of fewer than five words are one shingle of all their words and match exactly.

Defined results: a null text is as the empty one and matches nothing. A template that occurs several
times in a document is reported once, at the best and then first place. Very long texts are scanned whole. Repeated rows are reported
each. An empty table gives no rows. Nothing but key and text is read, whatever other columns are called.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import SIMILARITY, WORDS_IN_SHINGLE, WordHashes, mixed, rowwise, words_of

#: License notices as they are commonly written, and whole texts of the shorter licenses. Fixed values.
TEMPLATES = {
    "0BSD-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": "Released under the MIT License.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense-text": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    "all-rights-reserved": "All rights reserved.",
}
CHANCE = 0.999
#: One min-hash function for each band; classes share them.
SEEDS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


class PlainWords(WordHashes):
    """Hashes of words in lower case, with letters and digits only."""

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        plain = "".join(c for c in word.lower() if c.isalnum())
        self[word] = h = xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass"))
        return h


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, np.uint64(size))
    for i in range(size):
        h = mixed(h * np.uint64(0x165667B19E3779F9) + words[i : n + i])
    return h


class Class:
    """Templates with like numbers of shingles."""

    def __init__(self, size: int, window: int, templates: list[tuple[str, np.ndarray]], least: float, chance: float):
        self.size, self.window, self.step = size, window, max(1, window // 8)
        self.templates = [(name, np.unique(h)) for name, h in templates]
        # The worst case: the smallest template, of which `least` is there, in a window that starts up to a step off.
        m = min(len(h) for _, h in self.templates)
        there = max(1.0, least * m - (self.step - 1))
        j = there / (m + window - there)
        self.bands = max(1, math.ceil(math.log(1 - chance) / math.log(1 - j))) if j < 1 else 1
        if self.bands > len(SEEDS):
            raise ValueError("so low a containment needs too many bands")
        # Band values of the templates: a table of bits finds the few windows worth a look.
        self.keys = np.stack([band_values(h, SEEDS[: self.bands]) for _, h in self.templates])
        self.bits = np.zeros((self.bands, 1 << 16), bool)
        for b in range(self.bands):
            self.bits[b, (self.keys[:, b] >> np.uint64(48)).astype(np.int64)] = True


def scrambled(h: np.ndarray, seed: np.uint64) -> np.ndarray:
    x = (h ^ seed) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def band_values(h: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    return np.array([scrambled(h, s).min() for s in seeds], np.uint64)


def window_minima(x: np.ndarray, window: int, step: int) -> np.ndarray:
    """Minimum of x over the windows that start at every step-th place; the last may be shorter."""
    n = len(x)
    most = np.uint64(2**64 - 1)
    blocks = -(-n // step)
    y = np.append(x, np.full(blocks * step - n, most)).reshape(blocks, step).min(axis=1) if step > 1 else x
    # Doubling: after k rounds y holds the minima over 2**k blocks.
    wide, want = 1, max(1, window // step)
    while wide < want:
        shift = min(wide, want - wide)
        y = np.minimum(y, np.append(y[shift:], np.full(min(shift, len(y)), most)))
        wide += shift
    return y


def classes(templates: dict[str, str], least: float, chance: float) -> list[Class]:
    found: dict = {}
    for name, text in sorted(templates.items()):
        words = hashed(words_of(text), PlainWords())
        if not len(words):
            raise ValueError(f"the template {name} has no words")
        size = min(WORDS_IN_SHINGLE, len(words))
        h = runs(words, size)
        found.setdefault((size, 1 << math.ceil(math.log2(len(h)))), []).append((name, h))
    return [Class(size, window, ts, least, chance) for (size, window), ts in sorted(found.items())]


def hashed(words: list[str], hashes: WordHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def matches(docs: list[np.ndarray], found: list[Class], least: float) -> list[list[tuple[str, float, int, int]]]:
    """For each document, given as word hashes: (template, containment, first word, end word).

    The documents are laid end to end, as a window across two of them costs a comparison at most; what is compared exactly
    never leaves a document."""
    words = np.concatenate(docs) if docs else np.empty(0, np.uint64)
    edges = np.cumsum([0, *map(len, docs)])
    out: list[dict] = [{} for _ in docs]
    for size in sorted({c.size for c in found}):
        h = runs(words, size)
        if not len(h):
            continue
        some_classes = [c for c in found if c.size == size]
        hits: dict[int, set] = {i: set() for i in range(len(some_classes))}
        for b in range(max(c.bands for c in some_classes)):
            x = scrambled(h, SEEDS[b])
            for i, c in enumerate(some_classes):
                if b >= c.bands:
                    continue
                low = window_minima(x, c.window, c.step)
                at = np.flatnonzero(c.bits[b][(low >> np.uint64(48)).astype(np.int64)])
                if len(at):
                    hits[i].update((int(at[w]), int(t)) for w, t in zip(*np.nonzero(low[at, None] == c.keys[None, :, b])))
        for i, c in enumerate(some_classes):
            for w, t in sorted(hits[i]):
                name, template = c.templates[t]
                lo, hi = max(0, (w - 1) * c.step), (w + 1) * c.step + c.window
                for d in range(int(np.searchsorted(edges, lo, "right")) - 1, len(docs)):
                    if edges[d] >= hi:
                        break
                    start, end = max(lo, int(edges[d])), min(hi, int(edges[d + 1]) - size + 1)
                    if start >= end:
                        continue
                    inside = np.flatnonzero(np.isin(h[start:end], template))
                    share = len(np.unique(h[start:end][inside])) / len(template)
                    if share >= least and share > out[d].get(name, (0,))[0]:
                        first = start - int(edges[d])
                        out[d][name] = (share, first + int(inside[0]), first + int(inside[-1]) + size)
    return [[(name, *o[name]) for name in sorted(o)] for o in out]


def slabs(docs: list[np.ndarray], most: int = 150_000) -> list[list[np.ndarray]]:
    """The documents in order, as many at a time as have about so many words."""
    out, n = [[]], 0
    for d in docs:
        if n + len(d) > most and out[-1]:
            out.append([])
            n = 0
        out[-1].append(d)
        n += len(d)
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", least: float = SIMILARITY, chance: float = CHANCE) -> DataFrame:
    """key, license, containment, start_word, end_word for each template that a document holds.

    The templates, a small table, go to the executors with the code (they are refused beyond 8 MB); each text is
    read once, without a shuffle."""
    templates = TEMPLATES if templates is None else templates
    if sum(map(len, templates.values())) > 8_000_000:
        raise ValueError("the templates are too large to be sent to every executor")
    found = classes(templates, least, chance)

    def start():
        hashes = PlainWords()

        def run(texts: list) -> list:
            names = ("license", "containment", "start_word", "end_word")
            return [[[dict(zip(names, m)) for m in ms] for s in slabs([hashed(words_of(t), hashes) for t in texts]) for ms in matches(s, found, least)]]

        return run

    rows = rowwise(docs, key, text, "found array<struct<license: string, containment: double, start_word: int, end_word: int>>", start)
    return rows.select(f"`{key}`", F.inline("found"))
