"""Licence scans: Dice coefficient over word bigrams between normalised text and licence templates."""

from __future__ import annotations

from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, encoded, joined, mix, prefix_sums, slices, stretch_hashes, words

# Texts of public licences and of the notices by which documents refer to them.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE
COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You
should have received a copy of the GNU General Public License along with this program. If not, see
https://www.gnu.org/licenses/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions.""",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT notice": "Released under the MIT License.",
}
#: Licences whose whole texts lie in licence_texts.
FULL = ["Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"]


def templates_known() -> dict[str, str]:
    """The texts above and the full texts; read where a scan is planned, and sent to the tasks with it."""
    return TEMPLATES | {n: (resources.files(__package__) / "licence_texts" / f"{n}.txt").read_text("utf-8") for n in FULL}


#: Words too common to lead to a template.
COMMON = "a an and any are as at be by for from in is it not of on or that the this to with you".split()
DICE = 0.8

#: Bytes other than ASCII letters, digits and the bytes of other characters count as white space; capitals as small.
NORMAL = np.where([chr(b).isalnum() or b >= 128 for b in range(256)], LOWER, 32).astype(np.uint8)


def bigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, hashes of the bigrams that begin at them, and each word's text."""
    data, starts, ends = joined(texts)
    data = NORMAL[data]
    s, e = words(data)
    row = np.searchsorted(ends, s, "right")
    h = stretch_hashes(prefix_sums(data), s, e)
    pair = mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) else h
    pair = np.append(pair, np.uint64(0))[: len(h)]
    return h, pair, row


class Bigrams:
    """The bigrams of one text, in order, with the last place before each where the same one is met (-1: none)."""

    def __init__(self, pair: np.ndarray):
        self.pair, self.before = pair, np.full(len(pair), -1)
        order = np.argsort(pair, kind="stable")
        again = pair[order[1:]] == pair[order[:-1]]
        self.before[order[1:][again]] = order[:-1][again]

    def among(self, known: np.ndarray) -> np.ndarray:
        return known[np.minimum(np.searchsorted(known, self.pair), len(known) - 1)] == self.pair

    def distinct(self, width: int, which: np.ndarray | None = None) -> np.ndarray:
        """For each place, how many different bigrams (of `which`) the next `width` hold: each counts for the starts after its last equal one."""
        last = np.arange(len(self.pair)) if which is None else np.flatnonzero(which)
        first = np.maximum(self.before[last] + 1, np.maximum(0, last - width + 1))
        ends = len(self.pair) + 1
        return np.cumsum(np.bincount(first, minlength=ends) - np.bincount(last + 1, minlength=ends))[:-1]


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, dice: float = DICE):
        templates = templates_known() if templates is None else templates
        self.names, self.dice = sorted(templates), dice
        common = set(bigrams([" ".join(COMMON).encode()])[0].tolist())
        self.sets, self.lengths, leads = [], [], {}
        for k, name in enumerate(self.names):
            h, pair, _ = bigrams([templates[name].encode()])
            self.lengths.append(len(h))
            self.sets.append(np.unique(pair[:-1]))
            for j in range(len(h) - 1):
                if not (int(h[j]) in common and int(h[j + 1]) in common):
                    leads.setdefault(int(pair[j]), []).append((k, j))
        self.leads = leads
        self.keys = np.array(sorted(leads), np.uint64)
        sizes = [len(s) for s in self.sets]
        #: Bigrams of each template that lead nowhere.
        self.common = [sum(int(p) not in leads for p in s.tolist()) for s in self.sets]
        #: A set outside these sizes can't reach the coefficient.
        self.bounds = [(n * dice / (2 - dice) - 1e-9, n * (2 - dice) / dice + 1e-9) for n in sizes]

    def windows(self, k: int, own: Bigrams, match: np.ndarray, begins: np.ndarray, width: int) -> Iterator[tuple[float, int]]:
        """(coefficient, first word) of the windows of `width` bigrams from these places whose sets the size bounds allow."""
        (low, high), n = self.bounds[k], len(self.sets[k])
        size, both = own.distinct(width)[begins], own.distinct(width, match)[begins]
        fits = (low <= size) & (size <= high)
        yield from zip((2.0 * both[fits] / (size[fits] + n)).tolist(), begins[fits].tolist())

    def span(self, k: int, own: Bigrams, match: np.ndarray) -> tuple[float, int] | None:
        """(coefficient, first word) of the best span of a text's bigrams, the first of equal ones, if it reaches the coefficient.

        Both ends of a span are matching bigrams, as it is no better for one that doesn't match. The template's bigrams within the words
        that the size bounds allow after a start bound what its spans can reach; starts are tried from the largest bound down, until
        none can be better. A bound is a difference of running counts, so starts that can't reach the coefficient cost no comparison.
        """
        at, n, (low, high) = np.flatnonzero(match), len(self.sets[k]), self.bounds[k]
        width = int(self.lengths[k] * (2 - self.dice) / self.dice) + 1
        most = own.distinct(width, match)[at]
        bound, best = 2.0 * most / (most + n), (self.dice, -len(match))
        some = np.flatnonzero(bound >= self.dice)
        for i in some[np.argsort(-bound[some], kind="stable")].tolist():
            a = int(at[i])
            if bound[i] < best[0]:
                break
            if bound[i] == best[0] and -a < best[1]:
                continue
            new = own.before[a : a + width] < a
            size, both = np.cumsum(new), np.cumsum(new & match[a : a + width])
            ends = at[i : np.searchsorted(at, a + len(new))] - a
            ends = ends[(size[ends] >= low) & (size[ends] <= high)]
            if len(ends):
                best = max(best, (float((2.0 * both[ends] / (size[ends] + n)).max()), -a))
        return (best[0], -best[1]) if best[1] > -len(match) else None

    def text(self, pair: np.ndarray, hits: np.ndarray) -> list[tuple[int, float, int]]:
        """(template, coefficient, first word) of each template that the whole text, a window of the template's length, or a span between two matching bigrams reaches."""
        best: dict[int, tuple[float, int]] = {}
        windows: dict[int, set[int]] = {}
        begun: dict[int, list[int]] = {}
        for at in hits.tolist():
            for k, j in self.leads[int(pair[at])]:
                windows.setdefault(k, set()).add(max(0, at - j))
                begun.setdefault(k, []).append(at)
        own = None
        for k, starts in begun.items():
            # A set that reaches the coefficient shares at least dice / (2 - dice) of the template; leads are all but its common bigrams.
            if len(np.unique(pair[starts])) + self.common[k] < self.bounds[k][0]:
                continue
            own = own or Bigrams(pair[:-1])
            match = own.among(self.sets[k])
            found = [*self.windows(k, own, match, np.array([0]), len(match)), *self.windows(k, own, match, np.array(sorted(windows[k])), self.lengths[k] - 1)]
            for c, a in [*found, *filter(None, [self.span(k, own, match)])]:
                if c >= self.dice and (c, -a) > best.get(k, (0.0, 0)):
                    best[k] = (c, -a)
        return sorted(((k, c, -a) for k, (c, a) in best.items()), key=lambda x: (-x[1], -self.lengths[x[0]], x[0]))

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, float, int]]]:
        out: list[list[tuple[int, float, int]]] = [[] for _ in texts]
        _, pair, row = bigrams(texts)
        if not len(pair):
            return out
        place = np.searchsorted(self.keys, pair)
        hit = self.keys[np.minimum(place, len(self.keys) - 1)] == pair
        hit[:-1] &= row[1:] == row[:-1]
        hit[-1] = False
        at = np.flatnonzero(hit)
        for r in np.unique(row[at]).tolist():
            a, b = np.searchsorted(row, [r, r + 1])
            out[r] = self.text(pair[a:b], at[(at >= a) & (at < b)] - a)
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, dice: float = DICE, keep: str = "doc_id") -> DataFrame:
    """`keep`, licence string, dice double, first_word int, matches array<string> of every row of docs; other columns go.

    The normalised text (small letters, punctuation as white space) is compared whole, window by window where a
    template's bigram leads to it, and from each of its bigrams in spans of all sizes that can reach the coefficient; templates whose set size can't reach the coefficient are pruned. The licence is the one
    with the largest coefficient, ties to the longer template, then by name; matches are all that reach it. Null, empty and
    one-word texts, and texts without a match, have a null licence, dice 0, first_word null and no matches. Whole texts of
    any length are scanned; repeated rows give repeated results.
    """
    kind, templates = docs.schema[keep].dataType.simpleString(), templates_known() if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, dice)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                found = scanner.scan(encoded(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([scanner.names[x[0][0]] if x else None for x in found], pa.string()),
                        pa.array([x[0][1] if x else 0.0 for x in found], pa.float64()),
                        pa.array([x[0][2] if x else None for x in found], pa.int32()),
                        pa.array([[scanner.names[k] for k, _, _ in x] for x in found], pa.list_(pa.string())),
                    ],
                    ["keep", "licence", "dice", "first_word", "matches"],
                )

    out = docs.select(F.col(keep).alias("keep"), F.col("text")).mapInArrow(run, f"keep {kind}, licence string, dice double, first_word int, matches array<string>")
    return out.withColumnRenamed("keep", keep)
