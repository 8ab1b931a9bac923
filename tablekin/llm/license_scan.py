"""License scans: lines are matched with licence templates by sparse TF-IDF cosine, directories pass their licence down.

Only the words of the templates have columns in the sparse vectors; all other words of a line count in its length with
the weight of a word that a single document has. Document frequencies are counted over all texts. A file whose licence
lines make up a quarter of its words is a licence file: its directory has that licence. A file without a licence of its
own takes that of the nearest directory above it that has one.

Defined results: a null or empty text has no licence line. A null path is in no directory, and nothing is inherited by
it. Ties go to the first template by name, for a directory to the better cosine and then the smallest path. Each row
gives one row, repeated rows too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekin.llm.common import HOT_SHARE, text_bytes
from tablekin.session import materialize

# fixed values: short statements by which files name common licences
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "Apache-2.0 short": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "BSD-3-Clause short": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0 short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 short": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3.",
    "GPL-3.0 short": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    "MIT short": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "proprietary": "All rights reserved.",
}
_WORD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 or b in b"-." else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Cosine from which a line is a licence line; share of a licence file's words that are in its licence lines.
COSINE, FILE_SHARE = 0.6, 0.25


def line_words(line: bytes) -> list[bytes]:
    return [w for x in line.translate(_WORD).split() if (w := x.strip(b"-."))]


def template_name(key: str) -> str:
    return key.removesuffix(" short")


VOCABULARY = frozenset(w for t in TEMPLATES.values() for w in line_words(t.encode()))


class Matcher:
    """Sparse unit vectors of the templates for given document frequencies."""

    def __init__(self, df: dict[bytes, int], documents: int):
        self.weight = {w: log((1 + documents) / (1 + df.get(w, 0))) + 1 for w in VOCABULARY}
        self.other = log((1 + documents) / 2) + 1
        self.postings: dict[bytes, list[tuple[str, float]]] = {}
        for key in sorted(TEMPLATES):
            own = Counter(line_words(TEMPLATES[key].encode()))
            norm = sqrt(sum((n * self.weight[w]) ** 2 for w, n in own.items()))
            for w, n in own.items():
                self.postings.setdefault(w, []).append((key, n * self.weight[w] / norm))

    def best(self, words: list[bytes]) -> tuple[float, str]:
        """Cosine and name of the template nearest to a line."""
        own = Counter(words)
        dots: dict[str, float] = {}
        square = 0.0
        for w, n in own.items():
            weight = n * self.weight.get(w, self.other)
            square += weight * weight
            for key, value in self.postings.get(w, ()):
                dots[key] = dots.get(key, 0.0) + weight * value
        if not dots:
            return 0.0, ""
        score, key = max((v, [-ord(c) for c in k], k) for k, v in dots.items())[::2]
        return score / sqrt(square), key

    def scan(self, text: bytes) -> tuple[float, str, int, int]:
        """Best cosine, its licence, words in licence lines, all words."""
        found, inside, total = (0.0, ""), 0, 0
        for line in text.split(b"\n"):
            words = line_words(line)
            total += len(words)
            known = sum(w in VOCABULARY for w in words)
            if 4 * known >= len(words) and known > 1:  # a smaller share of known words can't reach the cosine
                score, key = self.best(words)
                if score >= COSINE:
                    inside += len(words)
                    if score > found[0] + 1e-12:
                        found = score, template_name(key)
        return *found, inside, total


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()
    rows = 0
    for batch in batches:
        for text in text_bytes(batch.column("text")):
            rows += 1
            counts.update(VOCABULARY.intersection(line_words(text)))
    words = [b"", *counts]
    yield pa.record_batch([pa.array(words, pa.binary()), pa.array([rows, *counts.values()], pa.int64())], ["word", "n"])


def _scan(df: dict[bytes, int], documents: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(df, documents)
        for batch in batches:
            found = [matcher.scan(t) for t in text_bytes(batch.column("text"))]
            score = [round(f[0], 9) if f[1] else None for f in found]
            yield pa.record_batch(
                [
                    batch.column("doc_id"), batch.column("path"), pa.array([f[1] or None for f in found], pa.string()), pa.array(score, pa.float64()),
                    pa.array([bool(f[1]) and f[2] >= FILE_SHARE * f[3] for f in found]),
                ],
                ["doc_id", "path", "license", "cosine", "is_license_file"],
            )

    return run


def _above(path: str = "path"):
    """All directories above a path with their depth, the root ('') included."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("directory")),
    )


def scan_licenses(files: DataFrame) -> DataFrame:
    """(doc_id, path, license, cosine, is_license_file, origin, inherited_from) of files with doc_id, path and text.

    Paths are joined with licence directories at every level. A directory that a large share of the files lies under is
    found by a broadcast of at most ``HOT_SHARE`` directories, the others by a shuffle.
    """
    counts = files.select("text").mapInArrow(_frequencies, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {bytes(r["word"]): r["n"] for r in counts}  # as many as the templates have words
    documents = df.pop(b"", 0)
    schema = "doc_id long, path string, license string, cosine double, is_license_file boolean"
    found = materialize(files.select("doc_id", "path", "text").mapInArrow(_scan(df, documents), schema), "licenses")

    inside = found.filter("is_license_file and path is not null").withColumn("directory", F.expr("array_join(slice(split(path, '/'), 1, size(split(path, '/')) - 1), '/')"))
    ranked = inside.groupBy("directory").agg(F.min(F.struct((-F.col("cosine")).alias("order"), "path", "license")).alias("best"))
    directories = materialize(ranked.select("directory", F.col("best.license").alias("passed")), "directories")

    open_ = found.filter("license is null and path is not null").select("path").distinct()
    levels = open_.select("path", F.explode(_above()).alias("at")).select("path", "at.depth", "at.directory")
    total = levels.count()
    size = levels.groupBy("directory").count().filter(F.col("count") * HOT_SHARE >= total).select("directory")
    hot = directories.join(F.broadcast(size), "directory", "left_semi")
    cold = directories.join(F.broadcast(size), "directory", "left_anti")
    near = levels.join(F.broadcast(hot), "directory").unionByName(
        levels.join(F.broadcast(size), "directory", "left_anti").join(cold, "directory")
    )
    nearest = near.groupBy("path").agg(F.max(F.struct("depth", "directory", "passed")).alias("near")).withColumnRenamed("path", "of")
    out = found.join(nearest, F.col("license").isNull() & (F.col("path") == F.col("of")), "left")
    origin = F.when(F.col("license").isNotNull(), F.when(F.col("is_license_file"), "file").otherwise("header")).when(F.col("near").isNotNull(), "inherited")
    return out.select(
        "doc_id", "path", F.coalesce("license", "near.passed").alias("license"), "cosine", "is_license_file", origin.alias("origin"),
        F.col("near.directory").alias("inherited_from"),
    )
