"""Licence scans: sparse TF-IDF cosine to templates, then inheritance along directories.

Every line of every file, and every run of words that is aligned with a
template wherever its lines break, is compared with licence templates; a file is a
licence file if it is named so, is nothing but a licence text, or opens with the
title of a licence. Files without a
licence of their own inherit from the nearest directory above that has a
licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginlake.llm.common import by_batch, store

# SPDX identifiers, and what headers and licence files say.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved. No part of this work may be reproduced without permission.",),
}
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
    "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission. "
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_TEXT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
    "the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
    "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
    "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Whole licence texts.
TEXTS = {
    "MIT": _MIT_GRANT,
    "BSD-3-Clause": _BSD_HEAD + _BSD_NAMES + _BSD_TAIL,
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "ISC": _ISC_TEXT,
}
#: The titles that longer licences open with.
TITLES = {
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "Apache-2.0": "Apache License Version 2.0, January 2004",
    "MPL-2.0": "Mozilla Public License Version 2.0",
}
LICENSE_FILE = r"(?i)^(un)?licen[cs]e|^copying|^notice"

#: Least cosine of a line, of aligned words across lines, and of a whole text that is nothing but a licence.
LEAST_LINE, LEAST_ALIGNED, LEAST_FILE = 0.75, 0.85, 0.9
#: Share of a template's word pairs that must be in place for words to be aligned with it.
ALIGNED = 0.6
#: Lines of more terms are compared in overlapping pieces of so many.
PIECE = 48

_TERM = re.compile(r"[a-z0-9]+")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


class Vocabulary:
    """Words and word pairs of the templates."""

    def __init__(self):
        self.templates = [(name, t) for name, texts in TEMPLATES.items() for t in texts] + list(TEXTS.items())
        self.words = [terms(t) for _, t in self.templates]
        # Where each word pair stands in which template.
        self.places: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for k, own in enumerate(self.words):
            for j, pair in enumerate(zip(own, own[1:])):
                self.places.setdefault(pair, []).append((k, j))
        self.titles = [(name, terms(t)) for name, t in TITLES.items()]
        self.bags = [bag(terms(t)) for _, t in self.templates]
        self.known = frozenset(x for b in self.bags for x in b)
        self.pairs = frozenset(x for x in self.known if isinstance(x, tuple))

    def aligned(self, words: list[str]) -> list[tuple[int, int]]:
        """Template and first word of every run of words that has most of a template's pairs in their places."""
        votes: Counter = Counter()
        for i, pair in enumerate(zip(words, words[1:])):
            for k, j in self.places.get(pair, ()):
                votes[k, i - j] += 1
        return [at for at, n in votes.items() if n >= max(2, ALIGNED * (len(self.words[at[0]]) - 1))]

    def title(self, words: list[str]) -> str | None:
        """The licence whose title the text opens with, a few words (such as a heading's) before it at most."""
        for name, own in self.titles:
            if any(words[i : i + len(own)] == own for i in range(4)):
                return name
        return None

    def shares_pair(self, words: list[str]) -> bool:
        return not self.pairs.isdisjoint(zip(words, words[1:]))


def bag(words: list[str]) -> Counter:
    return Counter(words) + Counter(zip(words, words[1:]))


def document_counts(files: DataFrame) -> dict:
    """In how many files each template term occurs, over all files; and under None, how many files there are.

    The result is bounded by the vocabulary of the templates.
    """
    def make():
        vocabulary = Vocabulary()
        names = {t: " ".join(t) if isinstance(t, tuple) else t for t in vocabulary.known}

        def step(cols):
            seen: Counter = Counter()
            for text in cols["text"].to_pylist():
                words = terms(text or "")
                seen.update(vocabulary.known.intersection(words))
                seen.update(vocabulary.pairs.intersection(zip(words, words[1:])))
            return {"term": [names[t] for t in seen] + [None], "n": [*seen.values(), len(cols["text"])]}

        return step

    rows = by_batch(files.select("text"), make, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {(tuple(r["term"].split()) if r["term"] and " " in r["term"] else r["term"]): r["n"] for r in rows}


class Scorer:
    """Cosine of a bag of terms to each template, weights being count times inverse document frequency.

    In a line, words that no template has weigh least, 1: headers also name
    owners and years. In a whole text they weigh like words that no document
    has, so that only a text that is nothing but a licence comes near.
    """

    def __init__(self, counts: dict):
        self.vocabulary = Vocabulary()
        n = counts.get(None, 0)
        self.idf = {t: math.log((n + 1) / (counts.get(t, 0) + 1)) + 1 for t in self.vocabulary.known}
        self.unseen = math.log(n + 1) + 1
        self.index: dict = {}
        for k, b in enumerate(self.vocabulary.bags):
            norm = math.sqrt(sum((c * self.idf[t]) ** 2 for t, c in b.items()))
            for t, c in b.items():
                self.index.setdefault(t, []).append((k, c * self.idf[t] / norm))

    def best(self, words: list[str], other: float = 1.0) -> tuple[float, str | None]:
        """Highest cosine and its licence; of equal ones the first template."""
        own, dots = bag(words), np.zeros(len(self.vocabulary.templates))
        square = 0.0
        for t, c in own.items():
            w = c * self.idf.get(t, other if isinstance(t, str) else 0.0)
            square += w * w
            for k, v in self.index.get(t, ()):
                dots[k] += w * v
        k = int(dots.argmax())
        return (dots[k] / math.sqrt(square), self.vocabulary.templates[k][0]) if dots[k] > 0 else (0.0, None)

    def cosine(self, words: list[str], k: int) -> float:
        """Cosine of words to one template; words that no template has weigh least."""
        own, other = bag(words), self.vocabulary.bags[k]
        weigh = lambda b: {t: c * self.idf.get(t, 1.0 if isinstance(t, str) else 0.0) for t, c in b.items()}
        a, b = weigh(own), weigh(other)
        dot = sum(w * b.get(t, 0.0) for t, w in a.items())
        return dot / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values())) if dot else 0.0

    def across_lines(self, words: list[str]) -> tuple[float, str | None]:
        """Best cosine of words that are aligned with a template, in windows of the template's length; of equal ones the longest."""
        best: tuple[float, int, str | None] = (0.0, 0, None)
        for k, start in self.vocabulary.aligned(words):
            size = len(self.vocabulary.words[k])
            found = self.cosine(words[max(0, start) : start + size], k)
            if found >= LEAST_ALIGNED and (round(found, 12), size) > best[:2]:
                best = (round(found, 12), size, self.vocabulary.templates[k][0])
        return best[0], best[2]

    def scan(self, text: str | None) -> tuple[str | None, float, str | None, float]:
        """Licence and cosine of the best line or aligned words, and of the whole text.

        Lines that share no word pair with a template count as 0. A text that opens with
        a licence's title is that licence as a whole.
        """
        if not text:
            return None, 0.0, None, 0.0
        line_best: tuple[float, str | None] = (0.0, None)
        for line in text.split("\n"):
            words = terms(line)
            if self.vocabulary.shares_pair(words):
                for i in range(0, max(1, len(words) - PIECE // 2), PIECE // 2):
                    found = self.best(words[i : i + PIECE])
                    if found[0] > line_best[0]:
                        line_best = found
        words = terms(text)
        aligned = self.across_lines(words)
        if aligned[0] >= line_best[0]:
            line_best = aligned
        title = self.vocabulary.title(words)
        if title:
            return title, 1.0, title, 1.0
        file_best = self.best(words, self.unseen) if line_best[1] else (0.0, None)
        return line_best[1], line_best[0], file_best[1], file_best[0]


def own_licenses(files: DataFrame, counts: dict) -> DataFrame:
    """path, license, score, whole_license, whole_score of each file from its text."""

    def make():
        scorer = Scorer(counts)

        def step(cols):
            found = [scorer.scan(t) for t in cols["text"].to_pylist()]
            lists = list(zip(*found, strict=True))
            return cols | dict(zip(("license", "score", "whole_license", "whole_score"), lists, strict=True))

        return step

    keep = [f for f in files.schema.fields if f.name != "text"]
    schema = [*((f.name, f.dataType) for f in keep), ("license", "string"), ("score", "double"), ("whole_license", "string"), ("whole_score", "double")]
    return by_batch(files.select(*[f.name for f in keep], "text"), make, schema)


def scan(files: DataFrame) -> DataFrame:
    """path, license, how, score, from_path for each file (path, text).

    ``how``: header (a line of its own), file (a licence file), inherited, or
    none. ``from_path``: the licence file that an inherited licence comes from.
    Of several licence files in a directory the most similar counts, then the
    first by path. Null and empty texts have no licence of their own but
    inherit; null paths have no directory. Rows of one path are files of
    their own. Other columns of ``files`` are kept.
    """
    extra = [c for c in files.columns if c not in ("path", "text", "license", "score", "how", "from_path")]
    rows = files.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *extra).alias("__extra"))
    counts = document_counts(rows)
    found = store(own_licenses(rows, counts), "licenses")
    parts = F.split("path", "/")
    named = F.element_at(parts, -1).rlike(LICENSE_FILE)
    folder = F.when(F.col("path").isNotNull(), F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")))
    is_file = (named & (F.col("score") >= LEAST_LINE)) | (F.col("whole_score") >= LEAST_FILE)
    found = found.select(
        "path", "__extra", folder.alias("folder"),
        F.when(F.col("whole_score") >= LEAST_FILE, F.col("whole_license")).when(F.col("score") >= LEAST_LINE, F.col("license")).alias("license"),
        F.greatest("score", "whole_score").alias("score"),
        F.coalesce(is_file, F.lit(False)).alias("is_file"),
    )
    declared = (
        found.filter("is_file and folder is not null")
        .groupBy("folder")
        .agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("best"))
        .select(F.col("folder").alias("above"), F.col("best.license").alias("given"), F.col("best.path").alias("from_path"))
    )
    # Folders, not files, are joined to the folders above them.
    folders = found.select("folder").filter("folder is not null").distinct()
    steps = F.split("folder", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(steps)),
        lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, F.lit(1), k), "/").alias("above")),
    )
    up = folders.select("folder", F.explode(above).alias("up")).select("folder", "up.depth", F.when(F.col("up.above") == "", "/").otherwise(F.col("up.above")).alias("above"))
    nearest = store(
        up.join(declared, "above")
        .groupBy("folder")
        .agg(F.max(F.struct("depth", "given", "from_path")).alias("near"))
        .select("folder", "near.given", "near.from_path"),
        "license-folders",
    )
    own = F.col("license").isNotNull()
    return found.join(nearest, "folder", "left").select(
        "path",
        F.coalesce("license", "given").alias("license"),
        F.when(F.col("is_file"), "file").when(own, "header").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(own, F.col("score")).alias("score"),
        F.when(~own, F.col("from_path")).alias("from_path"),
        *[F.col(f"__extra.`{c}`").alias(c) for c in extra],
    )
