"""License scan: TF-IDF cosine of license headers and files to templates, then inheritance down the directories.

A file's license passages are its runs of lines that are mostly made of template words and hold a license word, and
the whole text of files named like a license (LICENSE, COPYING ...). A passage takes the template with the highest
cosine of sparse TF-IDF vectors, if that is high enough. Inverse document frequencies cover the whole table: for the
words of the templates their own, for all others together one common value, so the weights need no table of all words.

A license file gives its license to its directory. Files without a license of their own take that of the nearest
directory at or above theirs which has one: distinct directories are joined with licensed ones by every ancestor path.

NULL or empty text: no license of its own. NULL path: nothing is inherited. Several passages: the best score counts,
ties go to the first template name. Several license files in one directory: the best score, then the first name.
Repeated rows get equal answers. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import stored

MIN_SCORE = 0.5
LINE_SHARE = 0.5  # words of a line that must be template words for the line to belong to a passage

# Notices by which these licenses are commonly declared, as plain text.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Released under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
        "either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
    ],
    "LGPL-3.0": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 3.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "CC-BY-SA-4.0": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "CC-BY-NC-4.0": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved. No part of this work may be reproduced without written permission of the copyright holder."],
}
LICENSE_WORD = re.compile(r"licen[cs]e|copyright|spdx|all rights reserved|public domain|permission is hereby|redistribution and use", re.I)
WORDS = re.compile(r"[a-z]+|[0-9]+")
FILE_NAME = r"(?i)^(un)?(licen[cs]e|copying|copyright)([-_.][^/]*)?$"


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def pairs_of(words: list[str]) -> list[str]:
    """Words and pairs of neighbours: "BY NC" differs from "BY" by a pair as well as a word."""
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


VOCABULARY = frozenset(w for texts in TEMPLATES.values() for t in texts for w in pairs_of(words_of(t)))


def document_frequencies(files: DataFrame) -> dict[str, int]:
    """In how many files each template word occurs, and under the empty word the number of files."""
    single = frozenset(w for w in VOCABULARY if " " not in w)
    pairs = VOCABULARY - single

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                words = words_of(text.as_py() or "")
                held.update(single.intersection(words))
                if len(single.intersection(words)) > 1:
                    held.update(pairs.intersection(f"{a} {b}" for a, b in zip(words, words[1:]) if a in single and b in single))
                held[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    found = files.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in found.collect()}  # at most the templates' words


class Scorer:
    """Cosines of a passage to all templates."""

    def __init__(self, frequencies: dict[str, int]):
        n = frequencies.get("", 0)
        self._idf = {w: math.log((1 + n) / (1 + frequencies.get(w, 0))) + 1 for w in VOCABULARY}
        self._other = math.log(1 + n) + 1  # words outside all templates are taken to be as rare as can be
        self._templates = [(name, self._vector(t)) for name, texts in sorted(TEMPLATES.items()) for t in texts]

    def _vector(self, text: str) -> tuple[dict[str, float], float]:
        counts = Counter(pairs_of(words_of(text)))
        weights = {w: (1 + math.log(c)) * self._idf.get(w, self._other) for w, c in counts.items()}
        return weights, math.sqrt(sum(x * x for x in weights.values()))

    def best(self, passage: str) -> tuple[str | None, float]:
        own, norm = self._vector(passage)
        best: tuple[str | None, float] = (None, 0.0)
        for name, (weights, other_norm) in self._templates:
            if norm and (score := sum(x * own.get(w, 0.0) for w, x in weights.items()) / (norm * other_norm)) > best[1] + 1e-12:
                best = (name, score)
        return best[0], min(best[1], 1.0)


def passages(text: str) -> list[str]:
    """Runs of lines made mostly of template words, those with a license word in them, and each such line alone."""
    if not LICENSE_WORD.search(text):
        return []
    found, run, hit = [], [], False
    for line in [*text.split("\n"), "\0"]:
        words = words_of(line)
        if not words and line != "\0":
            if run:
                run.append(line)  # blank and comment-mark lines do not end a header
            continue
        if words and sum(w in VOCABULARY for w in words) >= LINE_SHARE * len(words):
            run.append(line)
            if LICENSE_WORD.search(line):
                hit = True
                found.append(line)  # by itself too: neighbours made of common words would dilute it
            continue
        if hit:
            found.append("\n".join(run))
        run, hit = [], False
        if line != "\0" and LICENSE_WORD.search(line):  # a notice inside a longer line: its sentence
            found += [s for s in re.split(r"(?<=[.!?])\s+(?=\S)", line) if LICENSE_WORD.search(s)]
    return found


def own_licenses(files: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The columns of `files` (file_id, path, text) without the text, with license, score and is_license_file."""
    frequencies = document_frequencies(files)
    name = re.compile(FILE_NAME)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(frequencies)
        known: dict[str, tuple[str | None, float]] = {}  # notices repeat word for word
        for batch in batches:
            names, scores, whole = [], [], []
            for path, value in zip(batch.column("path").to_pylist(), batch.column("text")):
                text = value.as_py() or ""
                is_file = bool(path and name.match(path.rpartition("/")[2]))
                best: tuple[str | None, float] = (None, 0.0)
                for passage in passages(text) + ([text] if is_file else []):
                    if passage not in known:
                        if len(known) > 10_000:
                            known.clear()
                        known[passage] = scorer.best(passage)
                    if known[passage][1] > best[1]:
                        best = known[passage]
                good = best[1] >= min_score
                names.append(best[0] if good else None)
                scores.append(best[1])
                whole.append(is_file and good)
            yield pa.RecordBatch.from_arrays(
                [batch.column("file_id"), batch.column("path"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(whole, pa.bool_())],
                ["file_id", "path", "license", "score", "is_license_file"],
            )

    rows = files.select(F.col("file_id").cast("bigint").alias("file_id"), "path", "text")
    return rows.mapInArrow(run, "file_id bigint, path string, license string, score double, is_license_file boolean")


def directory(path: str) -> Column:
    """Directory of a path, without a closing slash; empty at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(folder: str) -> Column:
    """The directory and all above it, the top as the empty path."""
    parts = F.split(folder, "/")
    return F.array_union(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")), F.array(F.lit("")))


def scan(files: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Per file: file_id, path, license, score, origin (own, inherited or none) and licensed_by, the directory."""
    own = stored(own_licenses(files, min_score).withColumn("dir", directory("path")), "licenses")
    licensed = own.filter("is_license_file AND dir IS NOT NULL").groupBy("dir").agg(
        F.min_by("license", F.struct(-F.col("score"), "license")).alias("dir_license"), F.min(-F.col("score")).alias("dir_score")
    )
    # Files are many, directories few: the ancestor join runs over distinct directories and is then joined back.
    folders = own.filter("dir IS NOT NULL").select("dir").distinct().withColumn("above", F.explode(ancestors("dir")))
    nearest = folders.join(licensed.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(
        F.max_by(F.struct("above", "dir_license", "dir_score"), F.length("above")).alias("near")
    )
    joined = own.join(nearest, "dir", "left")
    has_own = F.col("license").isNotNull()
    return joined.select(
        "file_id", "path", F.coalesce("license", "near.dir_license").alias("license"),
        F.when(has_own, F.col("score")).otherwise(F.coalesce(-F.col("near.dir_score"), F.lit(0.0))).alias("score"),
        F.when(has_own, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~has_own, F.col("near.above")).alias("licensed_by"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """A corpus of documents as a tree of files: a directory for each source, one below it for each thousand ids.

    A document that consists of nothing but short license lines stands for its directory's license file.
    """
    block = F.floor(F.col("doc_id") / 1000).cast("string")
    lone = (F.length("text") < 400) & F.col("text").rlike(f"(?is)^\\s*[^\\n]*({LICENSE_WORD.pattern})[^\\n]*\\s*$")
    leaf = F.when(lone, F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", F.coalesce("source", F.lit("unknown")), block, leaf).alias("path"), "text")
