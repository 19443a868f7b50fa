"""License scans: sparse TF-IDF cosine to templates, then inheritance along directories.

Every text is read whole, in lines and, for each template, in all runs of as many words
as the template has, across lines too, so a notice counts wherever it stands. A segment's
TF-IDF vector is compared with those of the templates; document frequencies of the
templates' words are counted over all texts, and words of no template weigh as much as
a word seen in no text. A file is licensed by its best segment at LIMIT or above. If it is
named as licence files are, or if the segments at LIMIT or above that speak for its licence
hold HALF of its words together, it is a licence file and licenses its directory; a file
without a licence of its own inherits from the nearest ancestor directory that has one.
Directories meet their ancestors in equi-joins on paths, one row per level; the root, whose
path is empty, is an ancestor of all.

Exact pruning: the norm of a segment is at least the root of its summed squared weights,
which bounds its cosine from above; only segments whose bound reaches LIMIT are scored.

Defined results: null and empty texts have no licence of their own; a null path is a
file without directory; ties go to the higher cosine, then the smaller licence name;
repeated rows are judged one by one. Empty input gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import textkit as tk
from quire.llm.common import Scratch, broadcast_if_small

LIMIT = 0.6
HALF = 0.5
#: Base names of licence files: LICENSE, COPYING.LESSER, MIT-LICENSE.txt, LICENSE-2.0.md, UNLICENSE, but no source files.
NAMED = r"(?i)^([a-z0-9.]+[-_])?((un)?licen[cs]es?|copying)([-_][a-z0-9+-]*(\.[0-9]+)*)?(\.(txt|md|rst|html?|lesser|lib|apache|mit|gpl|lgpl|bsd|mpl))?$"
MAX_BROADCAST_DIRS = 200_000

#: Public notices by SPDX name.
TEMPLATES = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC0-1.0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all rights under CC0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: The other paragraphs of short licences, so that a file that holds a whole text is known by its share.
_DISCLAIMED = (
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES += [
    ("MIT", '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("MIT", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER'),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-3-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", f'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, {_DISCLAIMED}'),
]
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
TEMPLATES += [(f"CC-{k}-4.0", f"This work is licensed under a Creative Commons {v} 4.0 International License.") for k, v in _CC.items()]
TEMPLATES += [(f"CC-{k}-4.0", f"Licensed under CC {k} 4.0.") for k in _CC]
#: Tags name a licence by one word among words that all tags share, so they must match whole.
TAG = "SPDX-License-Identifier:"
WHOLE = 0.999
TEMPLATES += [(k, f"{TAG} {k}") for k in sorted({k for k, _ in TEMPLATES} - {"Proprietary"})]


def _hashes(texts: list[str]) -> list[np.ndarray]:
    return [tk.words(p, tk.ALNUM).hash for p in tk.pieces(pa.array(texts, pa.string()), 1)]


class Templates:
    """Template vocabulary (sorted word hashes) and term counts of each template."""

    def __init__(self, templates: list[tuple[str, str]]):
        own = _hashes([t for _, t in templates])
        self.names = [n for n, _ in templates]
        self.sizes = [len(h) for h in own]
        self.whole = np.array([text.startswith(TAG) for _, text in templates])
        self.vocabulary = np.unique(np.concatenate(own))
        self.counts = np.stack([np.bincount(np.searchsorted(self.vocabulary, h), minlength=len(self.vocabulary)) for h in own], axis=1).astype(float)

    def weigh(self, df: np.ndarray, total: int) -> None:
        self.idf = np.log((total + 1) / (df + 1)) + 1
        self.unseen = float(np.log(total + 1) + 1)
        vectors = self.counts * self.idf[:, None]
        self.table = vectors / np.sqrt((vectors**2).sum(axis=0)) * self.idf[:, None]  # times a term's count gives its share of the dot product

    def limits(self, limit: float) -> np.ndarray:
        return np.where(self.whole, max(limit, WHOLE), limit)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return at, self.vocabulary[at] == h


def frequencies(texts: DataFrame, t: Templates) -> tuple[np.ndarray, int]:
    """In how many texts each template word stands, and the number of texts."""

    def run(batches):
        df, total = np.zeros(len(t.vocabulary), np.int64), 0
        for batch in batches:
            for piece in tk.pieces(batch.column(0)):
                w = tk.words(piece, tk.ALNUM)
                at, known = t.find(w.hash)
                row = np.repeat(np.arange(len(piece)), w.counts)[known]
                df += np.bincount(np.unique(row * len(t.vocabulary) + at[known]) % len(t.vocabulary), minlength=len(t.vocabulary))
                total += len(piece)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(df)), -1), pa.int32()), pa.array(np.append(df, total))], ["term", "n"])

    found = dict(texts.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect())  # a row for each template word
    return np.array([found.get(k, 0) for k in range(len(t.vocabulary))]), found.get(-1, 0)


def _lines(piece: tk.Piece, w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges [first, last) of lines."""
    breaks = np.concatenate((np.flatnonzero(piece.raw == 10), piece.at[:-1]))
    cut = np.unique(np.concatenate((np.searchsorted(w.start, breaks), [len(w.hash)])))
    return cut[:-1], cut[1:]


def _likely(piece: tk.Piece, w: tk.Words, t: Templates, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges whose bound reaches ``limit``: lines, and runs as long as the template they are like."""
    at, known = t.find(w.hash)
    square = np.concatenate(([0], np.cumsum(np.where(known, t.idf[at], t.unseen) ** 2)))
    row = np.repeat(np.arange(len(piece)), w.counts)
    first, last = _lines(piece, w)
    least, limits = np.sqrt(square[last] - square[first]), t.limits(limit)
    whole = np.zeros(len(first), bool)
    begins, sizes, floors = [], [], {}
    for k, size in enumerate(t.sizes):
        dot = np.concatenate(([0], np.cumsum(np.where(known, t.table[at, k], 0))))
        whole |= dot[last] - dot[first] >= limits[k] * least - 1e-9
        if len(row) >= size:
            if size not in floors:
                floors[size] = np.sqrt(square[size:] - square[:-size])
            s = np.flatnonzero(dot[size:] - dot[:-size] >= limits[k] * floors[size] - 1e-9)
            begins.append(s[row[s] == row[s + size - 1]])
            sizes.append(np.full(len(begins[-1]), size))
    begin = np.concatenate((first[whole], *begins))
    spans = np.unique(np.stack((begin, np.concatenate((last[whole], *(b + n for b, n in zip(begins, sizes, strict=True))))), axis=1), axis=0)
    return spans[:, 0], spans[:, 1]


def best_segments(piece: tk.Piece, t: Templates, limit: float) -> list[tuple[str | None, float | None, float | None]]:
    """Licence and cosine of each row's best segment at ``limit`` or above, and the share of words in all for that licence."""
    out: list[tuple[str | None, float | None, float | None]] = [(None, None, None)] * len(piece)
    w = tk.words(piece, tk.ALNUM)
    if not len(w.hash):
        return out
    first, last = _likely(piece, w, t, limit)
    limits = t.limits(limit)
    found: dict[int, list[tuple[float, str, int, int]]] = {}
    for s, r in enumerate(tk.row_of(w.at, first).tolist()):
        value, count = np.unique(w.hash[first[s] : last[s]], return_counts=True)
        place, ok = t.find(value)
        norm = np.sqrt((count**2 * np.where(ok, t.idf[place], t.unseen) ** 2).sum())
        cosine = (t.table[place[ok]] * count[ok][:, None]).sum(axis=0) / norm
        k = min(np.flatnonzero(cosine >= limits).tolist(), key=lambda k: (-round(cosine[k], 12), t.names[k]), default=None)
        if k is not None:
            found.setdefault(r, []).append((-round(float(cosine[k]), 12), t.names[k], int(first[s]), int(last[s])))
    for r, matches in found.items():
        score, name, _, _ = min(matches)
        held = np.zeros(int(w.counts[r]), bool)
        for _, _, a, b in sorted((m for m in matches if m[1] == name), key=lambda m: (m[0], m[2] - m[3], m[2])):
            if not held[a - w.at[r] : b - w.at[r]].any():  # a run shifted from a better one adds words that are none of the notice
                held[a - w.at[r] : b - w.at[r]] = True
        out[r] = (name, min(1.0, -score), float(held.mean()))
    return out


def scan(files: DataFrame, path: Column, *, templates: list[tuple[str, str]] = TEMPLATES, limit: float = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, path, license, score, origin, from_dir`` of every file; origin: own, inherited or none."""
    spark = files.sparkSession
    scratch = Scratch(spark, "licenses")
    t = Templates(templates)
    t.weigh(*frequencies(files.select(F.col(text_col).cast("string")), t))
    shared = spark.sparkContext.broadcast(t)

    def run(batches):
        for batch in batches:
            first = 0
            for piece in tk.pieces(batch.column(2)):
                rows = best_segments(piece, shared.value, limit)
                kinds = (pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, len(piece)) for k in (0, 1)), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["id", "path", "license", "score", "share"])
                first += len(piece)

    own = scratch.put(files.select(F.col(id_col).cast("long").alias("id"), path.cast("string").alias("path"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, path string, license string, score double, share double").withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1)), "own")
    licensed = own.filter("dir is not null").filter((F.col("share") >= HALF) | (F.col("license").isNotNull() & F.regexp_extract("path", "([^/]*)$", 1).rlike(NAMED))).groupBy(F.col("dir").alias("at")).agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best")).select("at", F.col("best.license").alias("license"))
    dirs = own.filter("license is null and dir is not null").select("dir").distinct()
    steps = dirs.select("dir", F.split("dir", "/").alias("p")).select("dir", F.explode(F.sequence(F.lit(0), F.size("p"))).alias("depth"), "p").select("dir", "depth", F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/").alias("at"))
    nearest = scratch.put(steps.join(licensed, "at").groupBy("dir").agg(F.max(F.struct("depth", "at", "license")).alias("n")).select("dir", F.col("n.at").alias("from_dir"), F.col("n.license").alias("inherited")), "nearest")
    joined = own.join(broadcast_if_small(nearest, MAX_BROADCAST_DIRS), "dir", "left")
    takes = F.col("license").isNull() & F.col("inherited").isNotNull()
    return joined.select("id", "path", F.coalesce("license", "inherited").alias("license"), "score", F.when(F.col("license").isNotNull(), "own").when(takes, "inherited").otherwise("none").alias("origin"), F.when(takes, F.col("from_dir")).alias("from_dir"))


def digest(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source / language / hundreds of ids / id."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(docs, path).withColumnRenamed("id", "doc_id")
