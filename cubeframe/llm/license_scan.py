"""Licence scans: TF-IDF cosine of header lines and licence files to templates, then inheritance along directories. DataFrame operations only.

1. A line is a header candidate if it has a licence word (``MARKER``); all lines of the whole text are looked at. So are the windows of 2
   to 4 joined lines around it, as notices are broken over lines, and the blocks (between blank lines, or lines of comment signs only)
   that have such a word. A licence file (by its name) is also compared as a whole; its text is known by its title or its grant.
   An SPDX line is not compared but read: the first one's identifier is the licence (``-only``, ``-or-later`` and ``+`` of templates'
   names left off; identifiers without a template and expressions stay as they are).
2. The weights: the frequency of each word in the text (one and the logarithm of its number), times its inverse document frequency,
   which is counted over all documents. A word that is in no template weighs as much as one that no document has, so that prose
   around a licence word lowers the cosine. The vectors of the templates are a literal map of at most their words, so lines
   are scored where they are, without a join.
3. The best template with a cosine of ``LEAST`` or more is the file's licence. A directory's licence is that of its licence file (of
   several the one with the highest cosine, then the first path). Directories without one take that of the nearest ancestor:
   every directory is joined, as a path, with its ancestors (their number is the depth of the path), and the deepest wins. Files
   without a header take their directory's.

Defined cases: a null or empty text matches nothing; a null path is in no directory and inherits nothing; ties go to the template first by
name; files that repeat are reported each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize

#: Notices, titles and grants by licence (fixed values, after the licences' own wording).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Released into the public domain under CC0 1.0.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "LGPL-2.1": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "The MIT License (MIT)", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    "MPL-2.0": ("This work is licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0",),
    "Proprietary": ("All rights reserved.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: Words that make a line a candidate, and names of licence files (fixed patterns).
MARKER = r"(?i)licen[cs]e|rights\s+reserved|public\s+domain|redistribut|hereby|SPDX-"
#: What an SPDX line declares: one identifier, or an expression of several.
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*(\(*[a-z0-9][a-z0-9.+-]*\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[a-z0-9][a-z0-9.+-]*\)*)*)"
#: Lines that windows join, and what parts blocks: lines without a letter or digit.
WINDOWS = (2, 3, 4)
BLOCK_BREAK = r"\R(?:[^\p{L}\p{N}\r\n]*\R)+"
LICENCE_FILE = r"(?i)(^|/)(LICEN[CS]E|COPYING|UNLICENSE)([._-][^/]*)?$"
WORD_BREAK = r"[^a-z0-9]+"
LEAST = 0.6


def _words(text: Column) -> Column:
    """The lower-case words of a text, as often as they come."""
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w != "")


def _frequency(n: int) -> float:
    return 1 + math.log(n)


def _template_words() -> dict[tuple[str, int], dict[str, float]]:
    """The frequencies of the words of each template."""
    return {(name, i): {w: _frequency(n) for w, n in Counter(filter(None, re.split(WORD_BREAK, t.lower()))).items()} for name, texts in TEMPLATES.items() for i, t in enumerate(texts)}


def document_frequency(texts: DataFrame, text: str = "text") -> tuple[int, dict[str, int]]:
    """The number of texts, and in how many of them each template word occurs."""
    known = sorted(set().union(*_template_words().values()))
    rows = texts.select(F.array_intersect(_words(F.coalesce(F.col(text), F.lit(""))), F.array(*[F.lit(w) for w in known])).alias("words"))
    # A text with the same template words as others is counted with them before the words are taken apart.
    sets = rows.groupBy("words").agg(F.count(F.lit(1)).alias("n"))
    found = sets.select(F.explode_outer("words").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row per template word
    return texts.count(), {r["word"]: r["n"] for r in found if r["word"] is not None}


def _best(words: Column, total: int, frequency: dict[str, int]) -> Column:
    """The best template for the words of a text: struct(similarity, licence), similarity 0 without a word in common."""
    vectors = _template_words()
    idf = {w: math.log((total + 1) / (frequency.get(w, 0) + 1)) + 1 for w in sorted(set().union(*vectors.values()))}
    unknown = math.log(total + 1) + 1
    names = sorted(vectors)
    norms = [math.sqrt(sum((vectors[n][w] * idf[w]) ** 2 for w in vectors[n])) for n in names]
    squares = F.create_map(*[F.lit(x) for w in idf for x in (w, idf[w] ** 2)])
    dots = F.create_map(*[x for w in idf for x in (F.lit(w), F.array(*[F.lit(vectors[n].get(w, 0.0) * idf[w] ** 2) for n in names]))])
    # Words in order come in runs; the end of a run adds its word's square to the norm, and its products if a template has the word.
    times = lambda s: 1 + F.log(s["n"].cast("double"))
    norm = lambda s: s["norm"] + times(s) * times(s) * F.coalesce(F.try_element_at(squares, s["word"]), F.lit(unknown**2))
    sums = lambda s: F.coalesce(F.zip_with(s["dots"], F.try_element_at(dots, s["word"]), lambda a, b: a + times(s) * b), s["dots"])
    state = lambda word, n, square, products: F.struct(word.alias("word"), n.alias("n"), square.alias("norm"), products.alias("dots"))
    start = state(F.lit(None).cast("string"), F.lit(0), F.lit(0.0), F.array(*[F.lit(0.0)] * len(names)))
    step = lambda s, w: F.when(s["word"] == w, state(w, s["n"] + 1, s["norm"], s["dots"])).when(s["n"] == 0, state(w, F.lit(1), s["norm"], s["dots"])).otherwise(state(w, F.lit(1), norm(s), sums(s)))
    ends = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(norms[i]).alias("norm"), F.lit(names[i][0]).alias("licence"), F.lit(len(names) - i).alias("first")) for i in range(len(names))])
    whole = F.aggregate(F.array_sort(words), start, step, lambda s: F.struct(F.when(s["n"] > 0, norm(s)).otherwise(0.0).alias("norm"), F.when(s["n"] > 0, sums(s)).otherwise(s["dots"]).alias("dots")))
    scored = F.transform(F.array(whole), lambda s: F.array_max(F.transform(ends, lambda e: F.struct(F.when(s["norm"] > 0, F.get(s["dots"], e["i"]) / (F.sqrt(s["norm"]) * e["norm"])).otherwise(0.0).alias("similarity"), e["first"].alias("first"), e["licence"].alias("licence")))))
    return F.get(scored, F.lit(0))


def scan(files: DataFrame, ident: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """One row per file: id, path, license, evidence (``header``, ``file``, ``inherited`` or null), similarity, license_from (the path it is from)."""
    total, frequency = document_frequency(files, text)
    whole = F.coalesce(F.col(text), F.lit(""))
    named = F.coalesce(F.col(path).rlike(LICENCE_FILE), F.lit(False))
    none = F.array().cast("array<string>")
    marked = whole.rlike(MARKER)
    parted = files.select(
        F.col(ident).alias("id"), F.col(path).alias("path"), named.alias("named"), F.when(named, F.array(whole)).otherwise(none).alias("wholes"),
        F.when(marked, F.split(F.regexp_replace(whole, SPDX, ""), r"\R")).otherwise(none).alias("lines"),
        F.when(marked, F.filter(F.split(F.regexp_replace(whole, SPDX, ""), BLOCK_BREAK), lambda x: x.rlike(MARKER))).otherwise(none).alias("blocks"),
        F.regexp_extract(whole, SPDX, 1).alias("spdx"),
    )
    parted = parted.withColumn("at", F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(MARKER), i)), lambda i: i.isNotNull()))
    around = F.array_distinct(F.flatten(F.transform("at", lambda i: F.flatten(F.transform(F.filter(F.array(*map(F.lit, WINDOWS)), lambda w: w <= F.size("lines")), lambda w: F.transform(F.sequence(F.greatest(i - w + 1, F.lit(0)), F.least(i, F.size("lines") - w)), lambda k: F.struct(k.alias("k"), w.alias("w"))))))))
    texts = F.concat("wholes", F.transform("at", lambda i: F.get("lines", i)), F.transform(around, lambda x: F.array_join(F.slice("lines", x["k"] + 1, x["w"]), " ")), "blocks")
    plain = F.regexp_replace("spdx", r"(?i)(-only|-or-later|\+)$", "")
    declared = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for n in TEMPLATES for x in (n.lower(), n)]), F.lower(plain)), F.col("spdx"))
    found = parted.withColumn("texts", F.array_distinct(texts)).withColumn(
        "best",
        F.when(F.col("spdx") != "", F.struct(F.lit(1.0).alias("similarity"), F.lit(0).alias("first"), declared.alias("licence"))).otherwise(F.array_max(F.transform("texts", lambda x: _best(_words(x), total, frequency)))),
    )
    good = F.coalesce(F.col("best.similarity") >= LEAST, F.lit(False))
    own = materialize(
        found.select(
            "id",
            "path",
            F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).otherwise(F.when(F.col("path").isNotNull(), "")).alias("dir"),
            F.when(good, F.when(F.col("named"), "file").otherwise("header")).alias("evidence"),
            F.when(good, F.col("best.licence")).alias("license"),
            F.when(good, F.round("best.similarity", 6)).alias("similarity"),
        ),
        "licences",
    )
    # One licence per directory that has a licence file; then the nearest of each directory's ancestors, itself first.
    roots = own.where("evidence = 'file' AND dir IS NOT NULL").groupBy(F.col("dir").alias("ancestor")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "path", "license")).alias("root"))
    parts = F.split("dir", "/")
    ancestors = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    dirs = own.where("dir IS NOT NULL").select("dir").distinct()
    nearest = (
        dirs.select("dir", F.posexplode(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(ancestors)).alias("depth", "ancestor"))
        .join(roots, "ancestor")
        .groupBy("dir")
        .agg(F.max(F.struct("depth", F.col("root.path").alias("path"), F.col("root.license").alias("license"), (-F.col("root.s")).alias("similarity"))).alias("near"))
    )
    taken = own.where("license IS NULL AND dir IS NOT NULL").join(nearest, "dir", "left").select("id", "path", F.col("near.license").alias("license"), F.when(F.col("near").isNotNull(), "inherited").alias("evidence"), F.col("near.similarity").alias("similarity"), F.col("near.path").alias("license_from"))
    direct = own.where("license IS NOT NULL OR dir IS NULL").select("id", "path", "license", "evidence", "similarity", F.when(F.col("license").isNotNull(), F.col("path")).alias("license_from"))
    return direct.unionByName(taken).withColumnRenamed("id", ident)
