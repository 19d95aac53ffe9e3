"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Every block of a file is compared with every template, whatever the file's length: each line, each run
of lines that are not blank, each run of comment lines, the whole text, and all windows of a
template's number of words. Words weigh their count times ln((1 + N) / (1 + n)) + 1, where n of all N
files hold the word. A word that no template has weighs as if no file held it, so only the templates'
words are counted. The best match at or above ``threshold`` is the file's own licence; a match with a
licence text or long header (``LONG`` words or more) goes before shorter notices, which often stand
inside one, and an SPDX tag, which counts as an exact match, goes between the two. A file that says
little else (the largest of the best blocks of each template makes up ``file_share`` of its words) is a
licence file, and speaks for its directory. A file without a
licence of its own inherits from the nearest directory above it that has a licence file; of several
there the best match counts, then the licence's name. Directories are resolved once each, before
files are joined with them, so a directory with a third of all files costs one row.

Blocks are compared only with templates that they can match: a cosine is at most the share of the
template's length that lies in words the file has, which rules most templates out for most files.

Defined results: NULL text has no licence; a NULL path is a file in no directory; ties between
templates go to the first in alphabetical order, between blocks to the first of lines, runs, comment
runs, the whole and windows. Repeated rows are files of their own; an empty table gives no rows; other
columns pass through, and a column with the name of a result is replaced.
"""

import math
import re
from collections import Counter
from importlib.resources import files as resources

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.operators.storage import materialise

from .columns import field, packed, unpacked

THRESHOLD = 0.75
FILE_SHARE = 0.3
LONG = 30
_WORD = re.compile(r"[a-z0-9]+")
_COMMENT = re.compile(r"\s*(?:#|//|/?\*|--|;|%|<!--|\.\.\s|(?:rem|dnl)\b)")
_SLACK = 1e-6  # of bounds worked out with running sums

_TAG = re.compile(r"spdx-license-identifier\s*:[\s(]*([a-z0-9][a-z0-9.+-]*)")


def _gnu(work: str, name: str, version: str) -> list[str]:
    """The usual header, also without the words in brackets, and with its second sentence."""
    header = (
        f"This {work} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} License as "
        f"published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
    )
    warranty = (
        f"This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        f"warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} License for more details."
    )
    return [header.replace("(at your option) ", ""), header, f"{header} {warranty}"]


def _texts(notices: dict[str, list[str]]) -> dict[str, list[str]]:
    """The notices, and the licence texts of the folder ``license_texts``, which are named by their licence."""
    found = {name: list(texts) for name, texts in notices.items()}
    for file in sorted(resources(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name):
        found.setdefault(file.name.removesuffix(".txt"), []).append(file.read_text(encoding="utf-8"))
    return found


# Usual notices and headers, and whole licence texts.
TEMPLATES = _texts({
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        *_gnu("program", "Affero General Public", "3"),
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
    ],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", *_gnu("program", "General Public", "2")],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        *_gnu("program", "General Public", "3"),
    ],
    "LGPL-2.1": _gnu("library", "Lesser General Public", "2.1"),
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        *_gnu("library", "Lesser General Public", "3"),
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright (CC0 1.0 public domain dedication)."],
    "proprietary": ["All rights reserved."],
})


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _blocks(text: str) -> list[tuple[int, int]]:
    """Lines, runs of lines that are not blank, runs of comment lines and the whole, as ranges of words."""
    lines = text.split("\n")
    at = np.cumsum([0, *(len(_WORD.findall(line)) for line in lines)]).tolist()
    found = list(zip(at, at[1:], strict=False))
    for inside in ([bool(line.strip()) for line in lines], [_COMMENT.match(line) is not None for line in lines]):
        edges = [i for i, (a, b) in enumerate(zip([False, *inside], [*inside, False], strict=True)) if a != b]
        found += [(at[i], at[j]) for i, j in zip(edges[::2], edges[1::2], strict=True)]
    return [(i, j) for i, j in dict.fromkeys([*found, (0, at[-1])]) if i < j]


class _Windows:
    """The squared lengths of all windows of so many words."""

    def __init__(self, words: list[str], squares: np.ndarray):
        numbers = {}
        self.squares, self.n = squares, len(words)
        self.ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
        self.places = self.ids * (self.n + 1) + np.arange(self.n)
        order = np.argsort(self.places)
        self.sorted = self.places[order]
        self.rank = np.empty(self.n, np.int64)
        self.rank[order] = np.arange(self.n)

    def lengths(self, size: int) -> np.ndarray:
        """Of windows from each word that has ``size`` words from it on.

        A word that leaves or comes takes or adds its weight squared times 2 c - 1, c being its count
        with itself.
        """
        at, base = np.arange(self.n), self.ids * (self.n + 1)
        ahead = np.searchsorted(self.sorted, base + np.minimum(at + size, self.n)) - self.rank
        behind = self.rank + 1 - np.searchsorted(self.sorted, base + np.maximum(at - size + 1, 0))
        add = self.squares * (2 * behind - 1)
        take = self.squares * (2 * ahead - 1)
        steps = add[size:] - take[: self.n - size]
        return np.cumsum(np.concatenate([[add[:size].sum()], steps]))


class Matcher:
    def __init__(self, templates: dict[str, list[str]], files: int, holding: dict[str, int], threshold: float):
        weigh = lambda n: math.log((1 + files) / (1 + n)) + 1
        self.other, self.threshold = weigh(0), threshold
        self.templates = [(name, Counter(_words(t))) for name, texts in sorted(templates.items()) for t in texts]
        self.weights = {w: weigh(holding.get(w, 0)) for _, counts in self.templates for w in counts}
        self.norms = [math.sqrt(sum((n * self.weights[w]) ** 2 for w, n in counts.items())) for _, counts in self.templates]
        self.sizes = [sum(counts.values()) for _, counts in self.templates]
        self.names = {name.lower(): name for name in templates}
        self.ids = {w: i for i, w in enumerate(self.weights)}
        # one row per word, the last for all words that no template has
        self.squares = np.array([*(v**2 for v in self.weights.values()), self.other**2])
        self.parts = np.zeros((len(self.ids) + 1, len(self.templates)))
        for t, (_, counts) in enumerate(self.templates):
            for w, n in counts.items():
                self.parts[self.ids[w], t] = n * self.weights[w] ** 2 / self.norms[t]
        self.shares = self.parts**2 / self.squares[:, None]

    def cosines(self, words: list[str], wanted) -> list[tuple[int, float]]:
        """The cosines at or above the threshold, of the templates ``wanted``."""
        counts, found = Counter(words), []
        norm = math.sqrt(sum((n * self.weights.get(w, self.other)) ** 2 for w, n in counts.items()))
        for t in wanted:
            template = self.templates[t][1]
            dot = sum(n * template[w] * self.weights[w] ** 2 for w, n in counts.items() if w in template)
            cosine = round(dot / (norm * self.norms[t]), 12)
            if cosine >= self.threshold and cosine > 0:
                found.append((t, cosine))
        return found

    def matches(self, text: str, words: list[str]):
        """Every block that matches a template, and the best window of each template, as (template, cosine, words)."""
        wanted = np.flatnonzero(self.shares[[self.ids[w] for w in self.ids.keys() & set(words)]].sum(axis=0) >= self.threshold**2 - _SLACK)
        if not len(wanted):
            return
        rows = np.array([self.ids.get(w, len(self.ids)) for w in words])
        sums = lambda values: np.concatenate([[0.0], np.cumsum(values)])
        dots = {t: sums(self.parts[rows, t]) for t in wanted.tolist()}
        squares = self.squares[rows]
        lengths, windows = sums(squares), None  # at most the squared length, as if no word came twice
        least = (self.threshold - _SLACK) ** 2
        blocks = _blocks(text)
        start, stop = np.array(blocks).T
        able = np.array([(d[stop] - d[start]) ** 2 >= least * (lengths[stop] - lengths[start]) for d in dots.values()])
        for b in np.flatnonzero(able.any(axis=0)).tolist():
            i, j = blocks[b]
            for t, cosine in self.cosines(words[i:j], wanted[able[:, b]].tolist()):
                yield t, cosine, j - i
        for t, d in dots.items():
            size = self.sizes[t]
            if size >= len(words):
                continue  # the whole text is no longer
            dot = d[size:] - d[:-size]
            if (dot**2 < least * (lengths[size:] - lengths[:-size])).all():
                continue
            windows = windows or _Windows(words, squares)
            cosine = dot / np.sqrt(windows.lengths(size))
            i = int(np.argmax(cosine >= cosine.max() - 1e-9))
            for _, exact in self.cosines(words[i : i + size], [t]):
                yield t, exact, size

    def tags(self, text: str):
        """SPDX tags with the name of a licence, the first one of an expression, as (licence, words)."""
        for tag in _TAG.finditer(text) if "spdx" in text else ():
            name = re.sub(r"(?:-only|-or-later|\+)$", "", tag[1].rstrip(".-"))
            if name in self.names:
                yield self.names[name], len(_words(tag[0]))

    def scan(self, text: str | None) -> tuple[str | None, float | None, bool, float]:
        """Licence, cosine, whether found, and the notice's share of the words."""
        text = (text or "").lower()
        words = _words(text)
        best, license, blocks = (0, 0.0), None, {}
        for t, cosine, size in self.matches(text, words):
            order = (2 if self.sizes[t] >= LONG else 0, cosine)
            if order > best:
                best, license = order, self.templates[t][0]
            if cosine > blocks.get(t, (0.0, 0))[0]:
                blocks[t] = (cosine, size)
        for name, size in self.tags(text):
            if (1, 1.0) > best:
                best, license = (1, 1.0), name
            blocks.setdefault(None, (1.0, size))
        largest = max((size for _, size in blocks.values()), default=0)
        return license, best[1] or None, license is not None, largest / len(words) if license else 0.0


def scan_licenses(
    files: DataFrame,
    *,
    path: str = "path",
    text: str = "text",
    templates: dict[str, list[str]] | None = None,
    threshold: float = THRESHOLD,
    file_share: float = FILE_SHARE,
) -> DataFrame:
    """``files`` with license, cosine (of its own notice), is_license_file and inherited_from (a directory)."""
    spark = files.sparkSession
    templates = TEMPLATES if templates is None else templates
    vocabulary = {w for texts in templates.values() for t in texts for w in _words(t)}

    def holding(frames):
        for frame in frames:
            counts = Counter(w for t in frame["text"] for w in vocabulary.intersection(_words(t or "")))
            yield pd.DataFrame({"word": [*counts, ""], "n": [*counts.values(), len(frame)]})

    texts = files.select(F.col(text).alias("text"))
    counted = texts.mapInPandas(holding, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    held = {r["word"]: r["n"] for r in counted.collect()}  # at most the templates' words
    shared = spark.sparkContext.broadcast(Matcher(templates, held.pop("", 0), held, threshold))

    def scanned(frames):
        for frame in frames:
            rows = [(key, *shared.value.scan(t)) for key, t in zip(frame["key"], frame["text"], strict=True)]
            found = [(key, license, cosine, share) for key, license, cosine, holds, share in rows if holds]
            yield pd.DataFrame(found, columns=["key", "license", "cosine", "share"])

    parents = F.regexp_extract(field(path), "^(.*)/[^/]*$", 1)
    directory = F.when(field(path).isNull(), F.lit(None)).otherwise(parents)
    # every text is scanned once; only those with a licence are written, once for equal texts
    keyed = files.select(F.md5(F.col(text)).alias("key"), F.col(text).alias("text"))
    every = keyed.mapInPandas(scanned, "key string, license string, cosine double, share double")
    found = every.groupBy(F.col("key").alias("_text")).agg(F.first(F.struct("license", "cosine", "share")).alias("_scan"))
    found = materialise(found, "licences")
    rows = packed(files).withColumns({"_key": F.md5(field(text)), "_dir": directory})
    rows = rows.join(found, F.col("_key") == F.col("_text"), "left")
    slim = rows.select("_scan", "_dir")
    slim = materialise(slim.groupBy("_dir", "_scan.license", "_scan.cosine", (F.col("_scan.share") >= file_share).alias("file")).count(), "directories-with-licences")
    speaks = (
        slim.where(F.col("file") & F.col("license").isNotNull() & F.col("_dir").isNotNull())
        .groupBy("_dir")
        .agg(F.min(F.struct(-F.col("cosine"), F.col("license"))).alias("best"))
        .select(F.col("_dir").alias("above"), F.col("best.license").alias("given"))
    )
    # every directory with all directories above it, the root being the empty path
    names = F.split("_dir", "/")
    depth = F.when(F.col("_dir") == "", 0).otherwise(F.size(names))
    ancestors = slim.where(F.col("_dir").isNotNull()).select("_dir").distinct().select(
        "_dir", F.posexplode(F.transform(F.sequence(F.lit(0), depth), lambda n: F.array_join(F.slice(names, 1, n), "/"))).alias("depth", "above")
    )
    nearest = (
        ancestors.join(speaks, "above")
        .groupBy("_dir")
        .agg(F.max_by(F.struct("above", "given"), "depth").alias("near"))
        .select(F.col("_dir").alias("_ndir"), F.col("near.above").alias("above"), F.col("near.given").alias("given"))
    )
    joined = rows.join(materialise(nearest, "directories"), F.col("_dir") == F.col("_ndir"), "left")
    own = F.col("_scan.license")
    outputs = {
        "license": F.coalesce(own, "given"),
        "cosine": F.col("_scan.cosine"),
        "is_license_file": F.coalesce(F.col("_scan.share") >= file_share, F.lit(False)),
        "inherited_from": F.when(own.isNull(), F.col("above")),
    }
    return unpacked(joined, files.columns, outputs)
