"""Licence scans: normalised text units against licence templates by the Dice coefficient over word bigrams.

Units of a document are its lines, the whole text, and every window of words as long as a template, over line ends too; so a notice is found
alone, as the whole file, wrapped over lines or among other words. Templates are one-sentence notices, file headers and whole licence texts (of
the Creative Commons licences notices and headers only). Windows that match are taken by shared bigrams, then by coefficient, start and name; one
that overlaps a line or window taken before is left out if that has the same name or a coefficient as high, and so is one that has the name of
the whole text's match.

A unit and a template with a and b bigrams can only reach a coefficient d if d / (2 - d) <= a / b <= (2 - d) / d, and then they share at least
d b / (2 - d) bigrams; so one of any b - d b / (2 - d) + 1 of a template's bigrams must be in the unit. Those with the longest words are its
keys: only lines with a key and templates whose key is in the text are compared. Bigrams are multisets: a repeated bigram counts as often as
both sides have it. Normalised: lower case, words of letters and digits, the rest dropped; a unit of one word has that word as its only bigram.

Defined results: null and empty texts, and texts without words, have no match; ties between templates go to the first name; a document with
several matches lists all of them by line (0 is the whole text, a window has its first word's line); repeated rows give the same; an empty table
gives no rows; a column with a result's name is replaced.
"""
from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .licence_texts import TEXTS
from .staging import appended

# Public licence notices, headers and texts.
_GNU = """This program is free software{mark} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation{comma} either version {n} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU General Public License for more details."""
_CC = "This work is licensed under the Creative Commons {} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License."""],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", _CC.format("Attribution", "by")],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", _CC.format("Attribution-NonCommercial", "by-nc")],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", _CC.format("Attribution-ShareAlike", "by-sa")],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2.",
                _GNU.format(mark=";", comma=";", n=2), _GNU.format(mark=";", comma=";", n=2).split("\nThis program is distributed")[0]],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3.",
                _GNU.format(mark=":", comma=",", n=3), _GNU.format(mark=":", comma=",", n=3).split("\nThis program is distributed")[0]],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
            TEXTS["MIT"].split("\n\n")[0]],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}
TEMPLATES = {name: [*NOTICES.get(name, []), *([TEXTS[name]] if name in TEXTS else [])] for name in sorted({*NOTICES, *TEXTS})}
DICE = 0.85
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def words_of(unit: bytes) -> list[bytes]:
    """Normalised words, ASCII in lower case."""
    return _WORD.findall(unit.lower())


def bigrams(words: list[bytes]) -> Counter:
    """Word bigrams of a normalised unit; one word alone is a bigram."""
    return Counter(zip(words, words[1:])) if len(words) != 1 else Counter([(words[0], b"")])


def least_common(least: float, b: int) -> int:
    """The bigrams that a window of a template's length must share with it."""
    return next((c for c in range(max(1, int(least * b) - 1), b + 1) if c / b >= least), b + 1)


class Scanner:
    def __init__(self, templates: dict[str, list[str]], least: float):
        self.least = least
        self.sizes: list[int] = []
        self.names: list[str] = []
        self.grams: list[Counter] = []
        self.lengths: list[int] = []
        self.needs: list[int] = []
        self.index: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
        self.keys: dict[tuple[bytes, bytes], list[int]] = {}
        ratio = least / (2 - least)
        for name in sorted(templates):
            for text in templates[name]:
                words = words_of(text.encode())
                if not words:
                    continue
                grams = bigrams(words)
                k, b = len(self.names), sum(grams.values())
                self.lengths.append(len(words))
                for gram, n in grams.items():
                    self.index.setdefault(gram, []).append((k, n))
                # a unit that reaches the coefficient shares at least ratio * b bigrams, so it holds one of any b - ratio * b + 1 (one more for rounding)
                left = b - int(ratio * b) + 1
                for gram in sorted(grams, key=lambda g: (-len(g[0]) - len(g[1]), g)):
                    if left > 0:
                        self.keys.setdefault(gram, []).append(k)
                        left -= grams[gram]
                self.names.append(name)
                self.sizes.append(b)
                self.grams.append(grams)
                self.needs.append(least_common(least, b))
        self.first = {gram[0] for gram in self.keys}
        self.low = min(self.sizes, default=0) * ratio
        self.high = max(self.sizes, default=0) / ratio

    def match(self, words: list[bytes]) -> tuple[str, float] | None:
        """The best template of a unit, if it reaches the coefficient."""
        if not self.low <= max(1, len(words) - 1) <= self.high or not words:
            return None
        grams = bigrams(words)
        a = sum(grams.values())
        common: dict[int, int] = {}
        for gram, n in grams.items():
            for k, m in self.index.get(gram, ()):
                b = self.sizes[k]
                if self.least * max(a, b) <= (2 - self.least) * min(a, b):
                    common[k] = common.get(k, 0) + min(n, m)
        scored = [(2 * c / (a + self.sizes[k]), -k) for k, c in common.items()]
        best = max(scored, default=(0.0, 0))
        return (self.names[-best[1]], best[0]) if best[0] >= self.least else None

    def windows(self, words: list[bytes], k: int) -> list[tuple[int, int]]:
        """(start, common bigrams) of every window of a template's length that reaches the coefficient."""
        grams, b, need = self.grams[k], self.sizes[k], self.needs[k]
        if self.lengths[k] == 1:
            return [(i, 1) for i, word in enumerate(words) if (word, b"") in grams]
        at = [i for i, gram in enumerate(zip(words, words[1:])) if gram in grams]
        if len(at) < need:
            return []
        out, held, common, come, gone = [], Counter(), 0, 0, 0
        last = len(words) - 1 - b
        start = max(0, at[need - 1] - b + 1)
        while start <= last:
            while come < len(at) and at[come] < start + b:
                gram = (words[at[come]], words[at[come] + 1])
                held[gram] += 1
                common += held[gram] <= grams[gram]
                come += 1
            while gone < come and at[gone] < start:
                gram = (words[at[gone]], words[at[gone] + 1])
                common -= held[gram] <= grams[gram]
                held[gram] -= 1
                gone += 1
            if common >= need:
                out.append((start, common))
            if gone + need > len(at):
                break
            # the next start that can hold enough: the window must reach the need-th hit from its first one
            start = max(start + 1, at[gone + need - 1] - b + 1)
        return out

    def scan(self, text: bytes) -> list[tuple[int, str, float]]:
        """(line, template, coefficient) of every unit and window that matches, in order of place; a text of one line is that line only."""
        lines = [_WORD.findall(line) for line in text.lower().split(b"\n")]
        words = [word for line in lines for word in line] if len(lines) > 1 else lines[0]
        first, keys = self.first, self.keys
        at = [i for i, word in enumerate(words) if word in first]
        hits = [i for i in at if (words[i], words[i + 1] if i + 1 < len(words) else b"") in keys or (words[i], b"") in keys]
        alone = [n for n, line in enumerate(lines) if len(line) == 1 and (line[0], b"") in keys]
        if not hits and not alone:
            return []
        ends = list(accumulate(map(len, lines)))
        held = sorted({*(bisect_right(ends, i) for i in hits), *alone})
        found = [(n + 1, ends[n] - len(lines[n]), ends[n], *m) for n in held if (m := self.match(lines[n]))]
        whole = self.match(words) if len(lines) > 1 else None
        wanted = sorted({k for i in hits for gram in ((words[i], words[i + 1] if i + 1 < len(words) else b""), (words[i], b"")) for k in keys.get(gram, ())})
        pool = [(-c, k, start) for k in wanted for start, c in self.windows(words, k)]
        if pool:
            best, own = np.zeros(len(words)), {}
            for _, start, end, name, dice in found:
                best[start:end] = dice
                own.setdefault(name, np.zeros(len(words), bool))[start:end] = True
            for c, k, start in sorted(pool, key=lambda x: (x[0], self.sizes[x[1]], x[2], x[1])):
                name, b = self.names[k], self.sizes[k]
                end, dice = start + self.lengths[k], -c / b
                mine = own.setdefault(name, np.zeros(len(words), bool))
                if mine[start:end].any() or best[start:end].max() >= dice:
                    continue
                mine[start:end] = True
                best[start:end] = np.maximum(best[start:end], dice)
                if whole is None or whole[0] != name:
                    found.append((bisect_right(ends, start) + 1, start, end, name, dice))
        found.sort(key=lambda f: (f[0], f[1], f[2], f[3]))
        return ([(0, *whole)] if whole else []) + [(n, name, dice) for n, _, _, name, dice in found]


def scan(docs: DataFrame, text: str = "text", templates: dict[str, list[str]] | None = None, least: float = DICE) -> DataFrame:
    """Adds licenses (sorted distinct names), lines, names and coefficients of all matches in order of line."""
    held = TEMPLATES if templates is None else templates
    fields = [T.StructField("licenses", T.ArrayType(T.StringType())), T.StructField("match_lines", T.ArrayType(T.LongType())),
              T.StructField("match_names", T.ArrayType(T.StringType())), T.StructField("match_dice", T.ArrayType(T.DoubleType()))]

    def start() -> Callable[[list], list[list]]:
        scanner = Scanner(held, least)

        def work(texts: list) -> list[list]:
            found = [scanner.scan(t) if t else [] for t in texts]
            return [[sorted({m[1] for m in f}) for f in found], [[m[0] for m in f] for f in found], [[m[1] for m in f] for f in found], [[m[2] for m in f] for f in found]]

        return work

    return appended(docs, text, fields, start)
