"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory above.

A template is a notice. Every stretch of a file that is as long as the notice, across line ends and anywhere in the file,
is compared with it; a shorter file is compared as a whole. Weights come from the files that have each word, words that
no template has by hash bucket. A running sum bounds the cosine of every stretch from above, so only those that may pass
the bar are compared word by word. A file's own notice is the stretch that is most alike. A licence file (by its name, by
being mostly a licence, or as the caller says) speaks for its directory; files without a notice of their own take the
licence of the nearest directory above, found by joins on paths: only distinct directories are expanded into their
ancestors, so a directory with a third of all files is one row, and is sent to its files rather than shuffled.

Nulls: a null text is empty and has no notice; a null path is in no directory and inherits nothing. Of several licence
files in a directory the most alike counts, ties by path; of templates that are equally alike, the first. Repeated rows
are each reported. An empty table gives no rows. Columns other than those named are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import Scratch, freeing, join_named, slices, text_or_empty
from galley.llm.terms import BUCKETS, SLICE, Weights, prefix, term_counts, terms_of, words_of

#: Public licence notices, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
#: Cosine of a notice; share of a file's words that makes it a licence file; words within which a file that opens with a notice begins it.
COSINE, WHOLE, OPENING = 0.7, 0.5, 8
NAMES = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
NOTICES = "doc_id long, path string, own string, cosine double, word long, opens boolean, whole double"
#: Stretches that are compared word by word together.
CHUNK = 4096


def words_in(texts: pa.Array) -> pa.ListArray:
    """Lower-case words of each text: letters and digits, with hyphens and full stops inside. A text without words has one empty word."""
    plain = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}.-]+", " ")
    plain = pc.replace_substring_regex(plain, r"(^|\s)[.-]+|[.-]+(\s|$)", " ")
    return pc.utf8_split_whitespace(pc.utf8_trim_whitespace(plain))


class Templates:
    """Unit TF-IDF vectors of the templates over their own words."""

    def __init__(self, templates=TEMPLATES):
        self.names = [n for n, _ in templates]
        self.words = [words_of(t, words_in) for _, t in templates]
        self.lengths = np.array([len(ws) for ws in self.words])
        self.vocabulary = sorted({w for ws in self.words for w in ws})
        self.weigh(Weights(self.vocabulary, np.zeros(len(self.vocabulary) + BUCKETS), 0))

    def weigh(self, weights: Weights) -> Templates:
        """columns: what a word adds to the product with each template, that is its weight in the file times that in the template."""
        place = {w: k for k, w in enumerate(self.vocabulary)}
        self.idf = weights.idf
        unit = np.zeros((len(self.vocabulary), len(self.words)))
        for k, ws in enumerate(self.words):
            np.add.at(unit[:, k], [place[w] for w in ws], self.idf[[place[w] for w in ws]])
        unit /= np.linalg.norm(unit, axis=0)
        self.columns = self.idf[: len(self.vocabulary), None] * unit
        return self

    def notices(self, texts: pa.Array, cosine: float = COSINE) -> list[tuple[str | None, float, int, float]]:
        """(licence, cosine, word where it begins, share of the words that it is) of each text's most alike stretch; no licence below the bar."""
        cut = words_in(texts)
        terms, offsets = terms_of(cut.flatten(), pa.array(self.vocabulary, pa.string())), cut.offsets.to_numpy().astype(np.int64)
        known = terms < len(self.vocabulary)
        places = np.flatnonzero(known)
        before = np.concatenate([[0], np.cumsum(known)])
        square, sizes = prefix(self.idf[terms] ** 2), np.diff(offsets)
        text_of = np.repeat(np.arange(len(sizes)), sizes)
        best: dict[int, tuple[float, int, int, int]] = {}
        for k, n in enumerate(self.lengths.tolist()):
            product = prefix(self.columns[terms[places], k])
            # a stretch begins with a known word, or is a whole file that is shorter than the template
            start = np.unique(np.concatenate([places, offsets[:-1][sizes < n]]))
            end = np.minimum(start + n, offsets[text_of[start] + 1])
            start, end = start[end - start >= np.minimum(n, sizes[text_of[start]])], end[end - start >= np.minimum(n, sizes[text_of[start]])]
            # repeated words make a stretch longer than this, so no cosine is over this bound
            able = np.flatnonzero(product[before[end]] - product[before[start]] >= cosine * np.sqrt(square[end] - square[start]) - 1e-9)
            for lo in range(0, len(able), CHUNK):
                a, b = start[able[lo : lo + CHUNK]], end[able[lo : lo + CHUNK]]
                at = a[:, None] + np.arange(n)
                inside = at < b[:, None]
                pair, times = np.unique((np.arange(len(a))[:, None] * len(self.idf) + terms[np.minimum(at, len(terms) - 1)])[inside], return_counts=True)
                which, term = np.divmod(pair, len(self.idf))
                length = np.sqrt(np.bincount(which, (times * self.idf[term]) ** 2, minlength=len(a)))
                own = term < len(self.vocabulary)
                score = np.bincount(which[own], times[own] * self.columns[term[own], k], minlength=len(a)) / length
                for t, s, x in zip(text_of[a].tolist(), score.tolist(), a.tolist(), strict=True):
                    if s >= cosine and s > best.get(t, (0.0,))[0] + 1e-12:
                        best[t] = (s, k, x - int(offsets[t]), n)
        out = []
        for t, size in enumerate(sizes.tolist()):
            s, k, word, n = best.get(t, (0.0, -1, -1, 0))
            out.append((self.names[k] if k >= 0 else None, s, word, min(n, size) / size if k >= 0 else 0.0))
        return out


def notices(files: DataFrame, templates: Templates, cosine: float = COSINE) -> DataFrame:
    """NOTICES: of each file (doc_id, path, text), the licence of its most alike stretch (null below the bar), where that begins, whether the file opens with it, and its share of the file."""
    sent = files.sparkSession.sparkContext.broadcast(templates)
    names = [x.split()[0] for x in NOTICES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in slices(b, 2, SLICE):
                own, score, word, share = zip(*sent.value.notices(some.column(2), cosine), strict=True)
                opens = [0 <= w < OPENING for w in word]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(own, pa.string()), pa.array(score, pa.float64()), pa.array(word, pa.int64()), pa.array(opens), pa.array(share, pa.float64())], names)

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), text_or_empty()).mapInArrow(freeing(run), NOTICES)


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def inherit(found: DataFrame, is_licence_file: Column) -> DataFrame:
    """found (a written table) with licence (own, or that of the nearest directory above or equal) and licence_from (the file it is from)."""
    found = found.withColumn("dir", directory(F.col("path")))
    spoken = found.where(is_licence_file & F.col("own").isNotNull() & F.col("dir").isNotNull())
    said = spoken.groupBy(F.col("dir").alias("above")).agg(F.min_by(F.struct(F.col("own").alias("licence"), F.col("path").alias("from")), F.struct(-F.col("cosine"), "path")).alias("said"))
    # the directory itself, then those above it, then the top ("")
    parts = F.split("dir", "/")
    ups = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/")), F.array(F.lit(""))))
    dirs = found.where("dir is not null").groupBy("dir").agg(F.count(F.lit(1)).alias("files"))
    nearest = dirs.select("dir", "files", F.posexplode(ups).alias("steps", "above")).join(said, "above").groupBy("dir").agg(F.max("files").alias("files"), F.min_by("said", "steps").alias("said"))
    joined = join_named(found, nearest, "dir", "files", found.count(), "left")
    own = F.col("own").isNotNull()
    return joined.select("doc_id", "path", "own", "cosine", F.when(own, F.col("own")).otherwise(F.col("said.licence")).alias("licence"), F.when(own, F.col("path")).otherwise(F.col("said.from")).alias("licence_from"))


def scan_licenses(files: DataFrame, is_licence_file: Column | None = None) -> DataFrame:
    """doc_id, path, own, cosine, licence, licence_from for files (doc_id, path, text)."""
    scratch = Scratch(files.sparkSession, "licenses")
    tidy = files.select("doc_id", "path", text_or_empty())
    templates = Templates()
    counts, documents = term_counts(tidy, templates.vocabulary, words_in)
    found = scratch.write(notices(tidy, templates.weigh(Weights(templates.vocabulary, counts, documents))), "notices")
    by_name = F.col("path").rlike(NAMES) | (F.col("whole") >= WHOLE)
    return inherit(found, by_name if is_licence_file is None else by_name | is_licence_file)


def document_path() -> Column:
    """Documents have no path: they are laid out by source, language and thousands of doc_id."""
    return F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus has no licence files, so a document that opens with a notice stands for one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_licenses(docs.select("doc_id", document_path().alias("path"), "text"), F.col("opens"))
