"""Operator 9: licence scans by a trained paragraph classifier. The main path uses DataFrame functions only.

Comment marks are taken off the starts of lines. Paragraphs end at
blank lines; their lines are joined, so wrapped headers are whole again, and
cut into sentences, long ones into windows that overlap by half. Each such
unit is classified by a sparse logistic regression over word n-grams, and a
family is believed if its calibrated probability is high enough and one single
template of it (a sentence of its texts, or one of its names) stands in the unit.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.runtime import materialize

#: Paragraphs of the standard texts and headers, by family.
TEXTS = {
    "agpl": [
        'This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.',
        'You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.',
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
    ],
    "apache": [
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to you under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ],
    "boost": [
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
        'Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)',
    ],
    "bsd": [
        'Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
        'Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.',
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:',
        'Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.',
        'Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.',
    ],
    "cc-by": [
        'This work is licensed under a Creative Commons Attribution 4.0 International License.',
        'This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.',
    ],
    "cc-by-nc": [
        'This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.',
        'This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.',
        'You may not use the material for commercial purposes under the Creative Commons Attribution-NonCommercial license.',
    ],
    "cc-by-sa": [
        'This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.',
        'Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.',
    ],
    "cc0": [
        'To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.',
        'The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.',
    ],
    "epl": [
        'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/',
    ],
    "gpl": [
        'This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.',
        'You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.',
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.',
        'You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.',
    ],
    "isc": [
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.',
    ],
    "lgpl": [
        'This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.',
        'You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>.',
        'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.',
    ],
    "mit": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ],
    "mpl": [
        'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.',
        'If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.',
    ],
    "proprietary": [
        'No part of this publication may be reproduced, stored in a retrieval system, or transmitted in any form or by any means without the prior written permission of the publisher.',
        'This file is confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited.',
        'Copyright (c) 2020 The Company. All rights reserved.',
    ],
    "unlicense": [
        'Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.',
        'In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.',
        'This is free and unencumbered software released into the public domain.',
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        'The origin of this software must not be misrepresented; you must not claim that you wrote the original software.',
    ],
}
#: Names under which the licences of a family are cited.
NAMES = {
    "agpl": ["GNU Affero General Public License", "GNU AGPL", "AGPLv3", "AGPL-3.0-only", "AGPL-3.0-or-later", "AGPL version 3"],
    "apache": ["Apache License, Version 2.0", "Apache License", "Apache 2.0 License", "Apache-2.0", "Apache Software License", "Apache 2 licence"],
    "boost": ["Boost Software License, Version 1.0", "Boost Software License", "BSL-1.0", "Boost license"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD License", "BSD-3-Clause", "BSD-2-Clause", "BSD-style license", "New BSD License", "BSD licence"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 4.0", "CC-BY-4.0", "CC BY 3.0"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA 3.0"],
    "cc0": ["CC0 1.0 Universal Public Domain Dedication", "CC0 1.0 Universal", "CC0-1.0", "CC0 1.0", "CC0 license"],
    "epl": ["Eclipse Public License 2.0", "Eclipse Public License", "EPL-2.0", "Eclipse Public License, version 1.0"],
    "gpl": ["GNU General Public License", "GNU General Public License, version 3", "GNU General Public License v2.0", "GNU GPL", "GPLv3", "GPLv2", "GPL-3.0-or-later", "GPL-2.0-only", "GPL version 2", "GPL license"],
    "isc": ["ISC License", "ISC licence", "ISC-style license"],
    "lgpl": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU Library General Public License", "GNU LGPL", "LGPLv3", "LGPL-2.1-only", "LGPL version 2.1"],
    "mit": ["MIT License", "MIT licence", "MIT/X11 License", "Expat License", "MIT-style license"],
    "mpl": ["Mozilla Public License, v. 2.0", "Mozilla Public License", "MPL-2.0", "MPL 2.0", "Mozilla Public License Version 1.1"],
    "proprietary": ["All rights reserved", "Unauthorized copying of this file", "confidential and proprietary"],
    "unlicense": ["The Unlicense", "Unlicense", "free and unencumbered software"],
    "zlib": ["zlib License", "zlib/libpng License", "zlib licence"],
}
#: Wordings in which a name stands; {} is its place.
WORDINGS = ["Licensed under the {}.", "Released under the {}.", "Licensed under {}.", "This project is licensed under the {} - see the LICENSE file for details.", "Released under the terms of the {}.", "This work is licensed under the {}.", "Code in this repository is {}.", "The software is distributed under the {}.", "License: {}", "Available under the {}; see COPYING.", "You can use this library under the terms of {}.", "SPDX-License-Identifier: {}", "This file is part of a program that is covered by the {}.", "Published under {} by its authors.", "Dual licensed, {} for open source use.", "The package uses the {}.", "{}"]
_RESERVED = ["Copyright (c) 2019 John Smith. {}.", "Copyright 2021 The Authors, {} worldwide.", "{}."]
#: Names that are of no family, and sentences that use licence words without stating a licence.
OTHER_NAMES = ["Acme License", "Contoso Community License", "Foo Company agreement", "Example Public License", "Sample Source License, Version 1.0", "Company Terms of Service", "standard user agreement", "Harbour Authority licence"]
NEGATIVES = ["The driver renewed her license at the office on Monday.", "He lost his fishing licence in the public park.", "Copyright law is debated in many countries.", "You need permission to enter the building after six.", "The warranty of the car ends next year.", "She asked for permission to leave early and it was granted.", "The general public was invited to the free concert.", "The apache helicopter landed near the village.", "The foundation published a report on software prices.", "A license plate was found on the road.", "The creative commons room of the school is open to the public.", "Version 2 of the plan was distributed to all members.", "They sell and distribute fruit with a trading licence.", "His copy of the book was licensed to the library for one year.", "The software industry grew in the last decade.", "This domain of science is public and open.", "We reserved all rooms; the rights of guests are respected.", "The mit students built a robot.", "The university granted a copyright prize without restriction of age.", "The notice on the door says that no dogs are permitted.", "The gnu grazed with the zebras near the river.", "Mozilla hired a new director for its public relations.", "An eclipse of the sun was visible to the public in 2017.", "A boost in software sales made the shareholders happy.", "The museum is licensed to sell software.", "A fishing license costs ten crowns.", "All guests reserved their seats, and all rights to the film were sold.", "The source code of the game was sold in a closed auction.", "Use the form to request a copy of your birth certificate.", "The conditions of the contract are listed in the appendix."]
#: Words that are no feature on their own.
STOP = frozenset("a an and any are as at be by can for from has in is it its may not of on or such that the this to was were which will with you your".split())
#: What notices are found by. Every template needs a word that holds one of the stems or is one of the words.
ANCHOR_STEMS = ("licen", "copyri", "warran", "softwa", "permis", "distri", "public", "rights", "gpl", "apache", "confid", "unauth")
ANCHOR_WORDS = ("gnu", "cc", "cc0", "mpl", "epl", "bsl", "bsd")
UNKNOWN = "unknown"
WINDOW = 160

# taken off the start of each line; written for Java's and Python's engine alike
_MARKS = r"(?m)^[ \t\r]*(?:/\*+/?|\*+/?|//+!?|#+|;+|-->|--+|%+|<!--|::)?[ \t]*"
_BLANK = r"\n(?:[ \t\r\f\x0b]*\n)+"
_SENTENCE = r"(?<=[.!?])[\"')\]]*[ \t\r\n\f\x0b]+(?=[A-Z\"'(\[<])"


def words_of(text: str) -> list[str]:
    """Lower-cased words of letters and digits; each run of digits counts as 0."""
    return [w for w in re.split("[^a-z0-9]+", re.sub("[0-9]+", "0", text.lower())) if w]


def paragraphs(text: str | None) -> list[str]:
    """The paragraphs of a text without comment marks; those without a word or sign are left out."""
    return [p for p in re.split(_BLANK, re.sub(_MARKS, "", text or "")) if re.search(r"[^ \t\r\n\f\x0b]", p)]


def units(paragraph: str) -> list[list[str]]:
    """The sentences of a paragraph as words, in windows of at most WINDOW words."""
    out = []
    for s in re.split(_SENTENCE, paragraph):
        w = words_of(s)
        out += [w[i : i + WINDOW] for i in range(0, max(1, len(w) - WINDOW // 2), WINDOW // 2)] if w else []
    return out


def pairs(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def grams(words: list[str]) -> set[str]:
    """The distinct words and word pairs of a unit."""
    return set(words) | pairs(words)


def _anchored(word: str) -> bool:
    return word in ANCHOR_WORDS or any(a in word for a in ANCHOR_STEMS)


def _feature(g: str) -> bool:
    return any(w not in STOP and w != "0" for w in g.split())


def sentences(shared: bool) -> list[tuple[str, list[str]]]:
    """(family, words) of the sentences of TEXTS, with those or without those that families share."""
    made = [(f, w) for f in sorted(TEXTS) for text in TEXTS[f] for w in units(text) if len(w) > 4]
    owners: dict[str, set[str]] = {}
    for f, w in made:
        owners.setdefault(" ".join(w), set()).add(f)
    return [(f, w) for f, w in made if shared or len(owners[" ".join(w)]) == 1]


def examples() -> list[tuple[list[str], str, int]]:
    """(words, family, fold) of all training material. Fold 0 calibrates, fold 1 is held out, the rest trains.

    Sentences of the texts and their first and last two thirds, all names in
    all wordings, negatives alone, in pairs and with a name of no family. A
    name always trains in one wording at least, but no wording of fold 0 or 1 trains with that name.
    """
    out = []
    for t, (f, w) in enumerate(sentences(shared=False)):
        out.append((w, f, 2))
        if len(w) > 12:
            out += [(w[: len(w) * 3 // 4], f, 2 + t % 2), (w[len(w) // 4 :], f, (t * 3) % 5)]
    for k, f in enumerate(sorted(NAMES)):
        for n, name in enumerate(NAMES[f]):
            for p, wording in enumerate(_RESERVED if f == "proprietary" else WORDINGS):
                out.append((words_of(wording.format(name)), f, (p * 3 + n * 2 + k) % 5 if len(words_of(wording)) > 1 else 2))
    for i, t in enumerate(NEGATIVES):
        out += [(words_of(t), UNKNOWN, i % 5), (words_of(f"{t} {NEGATIVES[(i + 7) % len(NEGATIVES)]}"), UNKNOWN, (i + 3) % 5 if i % 5 > 1 and (i + 7) % 5 > 1 else 0)]
    for n, name in enumerate(OTHER_NAMES):
        out += [(words_of(wording.format(name)), UNKNOWN, (p * 3 + n * 2) % 5) for p, wording in enumerate(WORDINGS)]
    return out


class LicenceModel:
    """Sparse multinomial logistic regression over word n-grams, with a calibrated unknown class."""

    def __init__(self, l1: float = 2e-5, steps: int = 300, rate: float = 2.0):
        self.families = [*sorted(TEXTS), UNKNOWN]
        made = examples()
        self.features = sorted({g for w, _, fold in made if fold > 1 for g in grams(w) if _feature(g)})
        self.at = {g: i for i, g in enumerate(self.features)}
        self.weights = np.zeros((len(self.features), len(self.families)))
        self.bias, self.heat = np.zeros(len(self.families)), 1.0
        train = self._matrix([(w, f) for w, f, fold in made if fold > 1])
        self._train(*train, l1, steps, rate)
        # calibration: the temperature and the bias of unknown under which held-out pieces are likeliest
        rows, cols, x, y, weight = self._matrix([(w, f) for w, f, fold in made if fold == 0])
        z = self._sums(rows, cols, x, len(y))
        at = np.arange(len(y)), y.argmax(axis=1)
        _, self.heat, self.bias[-1] = max((float((np.log(self._softmax((z + np.eye(len(self.bias))[-1] * b) / h)[at] + 1e-12) * weight).sum()), h, b) for h in np.geomspace(0.1, 4, 40) for b in np.linspace(-1, 6, 29))
        # templates (family, n-grams, whether a name): sentences of the texts, and names
        self.templates = [(f, pairs(w), False) for f, w in sentences(shared=True)]
        self.templates += [(f, grams(w) if len(w) == 1 else pairs(w), True) for f in sorted(NAMES) for name in NAMES[f] for w in (words_of(name),)]

    def _matrix(self, made):
        """Entries of the design matrix in order of rows; each known n-gram of a unit counts 1 / sqrt(their number)."""
        rows, cols, x = [], [], []
        y = np.zeros((len(made), len(self.families)))
        for r, (w, f) in enumerate(made):
            known = sorted(self.at[g] for g in grams(w) if g in self.at)
            rows += [r] * len(known)
            cols += known
            x += [1 / np.sqrt(len(known))] * len(known)
            y[r, self.families.index(f)] = 1
        weight = (1 / np.sqrt(np.maximum(y.sum(axis=0), 1)))[y.argmax(axis=1)]
        return np.array(rows), np.array(cols), np.array(x), y, weight / weight.sum()

    def _sums(self, rows, cols, x, n):
        out = np.zeros((n, self.weights.shape[1]))
        if len(rows):
            new = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            out[rows[new]] = np.add.reduceat(self.weights[cols] * x[:, None], new, axis=0)
        return out

    def _train(self, rows, cols, x, y, weight, l1, steps, rate):
        """Proximal gradient steps with momentum."""
        order = np.argsort(cols, kind="stable")
        r2, c2, x2 = rows[order], cols[order], x[order]
        new = np.flatnonzero(np.concatenate(([True], c2[1:] != c2[:-1])))
        before, t = self.weights.copy(), 1.0
        for _ in range(steps):
            p = self._softmax(self._sums(rows, cols, x, len(y)))
            d = (p - y) * weight[:, None]
            step = np.zeros_like(self.weights)
            step[c2[new]] = np.add.reduceat(d[r2] * x2[:, None], new, axis=0)
            w = self.weights - rate * len(self.families) * step
            w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
            u = (1 + np.sqrt(1 + 4 * t * t)) / 2
            self.weights, before, t = w + (t - 1) / u * (w - before), w, u
        self.weights = before

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def probabilities(self, words: list[str]) -> np.ndarray:
        known = [self.at[g] for g in grams(words) if g in self.at]
        z = self.weights[known].sum(axis=0) / np.sqrt(max(1, len(known))) + self.bias
        return self._softmax(z / self.heat)

    def needed(self, contained: float) -> list[int]:
        """How many n-grams of each template have to stand in a unit.

        All of a name; of a sentence a share of `contained`, or more where
        that many could be met without any anchored word. So a unit without an
        anchor meets no template, and the gate of scan changes no result.
        """
        bare = [sum(not any(map(_anchored, x.split())) for x in g) for _, g, _ in self.templates]
        return [len(g) if name else max(int(np.ceil(contained * len(g) - 1e-9)), b + 1) for (_, g, name), b in zip(self.templates, bare)]

    def classify(self, words: list[str], least: float, contained: float) -> tuple[str, float]:
        """(family or unknown, probability) of one unit in plain Python: what the DataFrame path gives too."""
        p = self.probabilities(words)
        k = int(p.argmax())
        if k == len(p) - 1 or p[k] < least:
            return UNKNOWN, float(p[-1])
        g = grams(words)
        met = [(f, name, len(t & g) / len(t)) for (f, t, name), n in zip(self.templates, self.needed(contained)) if len(t & g) >= n]
        named = any(name and f == self.families[k] for f, name, _ in met)
        share = {own: max((x for f, name, x in met if not name and (f == self.families[k]) == own), default=0.0) for own in (True, False)}
        return (self.families[k], float(p[k])) if named or share[True] > share[False] else (UNKNOWN, float(p[-1]))

    def families_of(self, text: str | None, least: float = 0.5, contained: float = 0.75) -> set[str]:
        return {self.classify(w, least, contained)[0] for p in paragraphs(text) for w in units(p)} - {UNKNOWN}

    def held_out(self, least: float = 0.5, contained: float = 0.75) -> dict[str, float]:
        """Recall, precision and number of the held-out examples."""
        made = [(f, self.classify(w, least, contained)[0]) for w, f, fold in examples() if fold == 1]
        said, there = [x for x in made if x[1] != UNKNOWN], [x for x in made if x[0] != UNKNOWN]
        right = sum(a == b for a, b in said)
        return {"recall": right / len(there), "precision": right / max(1, len(said)), "examples": len(made)}


_models: list[LicenceModel] = []


def model() -> LicenceModel:
    if not _models:
        _models.append(LicenceModel())
    return _models[0]


def scan(docs: DataFrame, least: float = 0.5, contained: float = 0.75) -> DataFrame:
    """One row per document: doc_id, n_paragraphs, n_licences (paragraphs with one), families (sorted, joined by commas), top_family, top_score.

    A unit (see the module) states a licence if the classifier's likeliest
    family has a probability of `least` or more, and `contained` of the word
    pairs of one single template of that family stand in the unit: of a name,
    or of a sentence of which no other family's sentence has as large a share
    there (families share sentences, or nearly so). Else it is unknown. Nulls and empty texts have no paragraphs. Very long paragraphs
    are read whole, window by window. Repeated rows are scanned one by one (a
    row number tells them apart); of units with equal scores the first in the
    text is the top one. Other columns are not read, so names cannot clash. An
    empty table gives an empty result.

    Only the model is broadcast: some thousand n-grams, a number that the
    fixed texts set. Sentences without any anchor cannot hold what a template
    needs, so they skip the classifier.
    """
    m = model()
    spark: SparkSession = docs.sparkSession

    def gate(low: Column) -> Column:
        word = "|".join(a.replace("0", "[0-9]+") for a in ANCHOR_WORDS)  # a digit is not a 0 in the text itself
        maybe = reduce(lambda a, b: a | b, [low.contains(a.rstrip("0")) for a in ANCHOR_WORDS if a != "cc0"])
        return reduce(lambda a, b: a | b, [low.contains(a) for a in ANCHOR_STEMS]) | (maybe & low.rlike(f"(?<![a-z0-9])(?:{word})(?![a-z0-9])"))

    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), _MARKS, "")
    base = docs.select(F.col("doc_id").cast("long"), text.alias("t"))
    whole = F.size(F.filter(F.split("t", _BLANK, -1), lambda p: p.rlike(r"[^ \t\r\n\f\x0b]"))).cast("long")
    base = base.select("doc_id", whole.alias("n_paragraphs"), "t", F.lower("t").alias("low"))
    base = base.select("doc_id", "n_paragraphs", F.when(gate(F.col("low")), F.col("t")).alias("t"))
    base = materialize(base.withColumn("row", F.monotonically_increasing_id()), "licence-texts")
    par = base.where("t IS NOT NULL").select("row", F.posexplode(F.split("t", _BLANK, -1)).alias("par", "p"))
    par = par.select("row", "par", F.posexplode(F.split("p", _SENTENCE, -1)).alias("sentence", "s")).where(gate(F.lower("s")))
    w = F.filter(F.split(F.regexp_replace(F.lower("s"), "[0-9]+", "0"), "[^a-z0-9]+", -1), lambda x: x != "")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), F.size("w") - WINDOW // 2) - 1, F.lit(WINDOW // 2))
    par = par.withColumn("w", w).where(F.size("w") > 0).select("row", "par", "sentence", "w", F.explode(starts).alias("at"))
    par = par.withColumn("w", F.slice("w", F.col("at") + 1, F.lit(WINDOW))).withColumn("unit", F.struct("par", "sentence", "at"))
    two = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))
    par = par.select("row", "unit", F.explode(F.array_distinct(F.when(F.size("w") > 1, F.concat("w", two)).otherwise(F.col("w")))).alias("gram"))
    k = len(m.families)
    of: dict[str, list[int]] = {}
    for i, (_, g, _) in enumerate(m.templates):
        for x in g:
            of.setdefault(x, []).append(i)
    table = [(g, [float(v) for v in m.weights[m.at[g]]] if g in m.at else None, of.get(g)) for g in sorted(set(m.features) | set(of))]
    hit = par.join(F.broadcast(spark.createDataFrame(table, "gram string, weights array<double>, ts array<int>")), "gram")
    sums = hit.where("weights IS NOT NULL").groupBy("row", "unit").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("weights")[i]).alias(f"z{i}") for i in range(k)])
    logits = F.array(*[(F.col(f"z{i}") / F.sqrt("n") + float(m.bias[i])) / float(m.heat) for i in range(k)])
    best = sums.select("row", "unit", logits.alias("z")).withColumn("top", F.array_max("z"))
    best = best.select("row", "unit", (1 / F.aggregate(F.transform("z", lambda z: F.exp(z - F.col("top"))), F.lit(0.0), lambda a, b: a + b)).alias("score"), (F.array_position("z", F.col("top")) - 1).cast("int").alias("f"))
    best = best.where((F.col("f") < k - 1) & (F.col("score") >= least))
    facts = [(i, m.families.index(f), n, len(g), name) for i, ((f, g, name), n) in enumerate(zip(m.templates, m.needed(contained)))]
    met = hit.where("ts IS NOT NULL").select("row", "unit", F.explode("ts").alias("t")).groupBy("row", "unit", "t").agg(F.count(F.lit(1)).alias("met"))
    met = met.join(F.broadcast(spark.createDataFrame(facts, "t int, f int, need int, size int, name boolean")), "t").where("met >= need")
    met = met.groupBy("row", "unit", "f").agg(F.max("name").alias("named"), F.max(F.when(~F.col("name"), F.col("met") / F.col("size"))).alias("share"))
    most = met.groupBy("row", "unit").agg(F.sort_array(F.collect_list(F.coalesce("share", F.lit(0.0))), asc=False).alias("shares"))  # one for each family
    alone = (F.col("share") == F.col("shares")[0]) & (F.coalesce(F.try_element_at("shares", F.lit(2)), F.lit(0.0)) < F.col("share"))
    met = met.join(most, ["row", "unit"]).where(F.col("named") | F.coalesce(alone, F.lit(False))).select("row", "unit", "f")
    sure = best.join(met, ["row", "unit", "f"]).withColumn("family", F.element_at(F.array(*map(F.lit, m.families)), F.col("f") + 1))
    first = F.max(F.struct(F.round("score", 6).alias("score"), F.struct(*[(-F.col(f"unit.{c}")).alias(c) for c in ("par", "sentence", "at")]).alias("place"), "family"))
    per_row = sure.groupBy("row").agg(F.count_distinct("unit.par").alias("n_licences"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), first.alias("b"))
    out = base.select("row", "doc_id", "n_paragraphs").join(per_row, "row", "left")
    return out.select("doc_id", "n_paragraphs", F.coalesce("n_licences", F.lit(0)).alias("n_licences"), F.coalesce("families", F.lit("")).alias("families"), F.col("b.family").alias("top_family"), F.col("b.score").alias("top_score"))
