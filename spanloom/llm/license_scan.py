"""Licence scans: TF-IDF cosine of headers and licence files to templates, then directory inheritance.

Units are the lines and the paragraphs (between blank lines) of a file. A unit
is compared with every template by the cosine of their TF-IDF vectors; the
weights come from the fixed templates. Units without any of the templates' prefix words
cannot reach the threshold (the rest of a template's vector is too short) and
are never tokenised, so the scan is one pass with a regular expression and
the joins see only candidate units.

A file takes the licence of its best unit. Licence files (LICENSE, COPYING and
the like) give theirs to their directory; a file without one of its own
inherits from the nearest ancestor directory that has one. Directories are
resolved once each, by an equi-join on their ancestors' paths.

Defined results: a null or empty text has no licence of its own; a null path
inherits nothing; a path without a slash lies in the root directory ``""``. Among several
licences of one directory the highest score wins, then the smallest name, then
the smallest path. Every input row gives one row; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

#: The usual notices of common licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
            "and associated documentation files (the Software), to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
                   "except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of "
                "the GNU General Public License as published by the Free Software Foundation, either version 3 "
                "of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of "
                "the GNU General Public License as published by the Free Software Foundation; either version 2 "
                "of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the "
                     "LICENSE file."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
            "fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
                     "License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
                     "International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights "
                "to this work under CC0 1.0."),
)
THRESHOLD = 0.7
#: Words of everyday English: weighed as if in every template, and tried last as prefix words.
EVERYDAY = frozenset(
    "a all and any are as at be by can deal for form found free from has in into is it may met not of on or "
    "that the this to under use v version with without work you file following person program terms "
    "1.0 2 3 2.0 4.0".split())
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENCE_FILE = r"(?i)^(?:licen[cs]e|copying|unlicense)(?:[._-].*)?$"
#: Directories with a licence up to which their table is broadcast (paths of some 100 bytes).
BROADCAST_ROWS = 200_000


def weights(templates=TEMPLATES) -> tuple[dict[str, float], float, list[dict[str, float]]]:
    """Inverse document frequency of template words and of other words; unit vectors of the templates."""
    bags = [Counter(re.findall(TOKEN, text.lower())) for _, text in templates]
    df = Counter(t for bag in bags for t in bag)
    n = len(bags)
    idf = {t: 1.0 if t in EVERYDAY else math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
    vectors = []
    for bag in bags:
        v = {t: k * idf[t] for t, k in bag.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / size for t, x in v.items()})
    return idf, math.log(1 + n) + 1, vectors


def prefix_words(vectors: list[dict[str, float]], threshold: float) -> list[str]:
    """Words of which a unit must have one: without them no template reaches the threshold.

    What is left of a template's unit vector bounds the cosine with any unit
    that has none of the words taken so far.
    """
    out = set()
    for v in vectors:
        rest = 1.0
        for t in sorted(v, key=lambda t: (t in EVERYDAY, -v[t], t)):
            if math.sqrt(max(rest, 0.0)) < threshold:
                break
            out.add(t)
            rest -= v[t] ** 2
    return sorted(out)


def trigger(threshold: float = THRESHOLD, templates=TEMPLATES) -> str:
    words = "|".join(re.escape(w) for w in prefix_words(weights(templates)[2], threshold))
    return rf"(?<![a-z0-9])(?:{words})(?![a-z0-9])"


def units(text: Column, pattern: str) -> Column:
    """Lines and paragraphs that may hold a licence."""
    low = F.lower(text)
    each = F.array_distinct(F.concat(F.split(low, "\n"), F.split(low, r"\n[ \t\r]*\n")))
    return F.when(low.rlike(pattern), F.filter(each, lambda u: u.rlike(pattern))).otherwise(
        F.array().cast("array<string>"))


def own_licences(found: DataFrame, threshold: float, templates=TEMPLATES) -> DataFrame:
    """(rid, licence, score) of the files with a unit at the threshold; ``found``: rid, units."""
    spark = found.sparkSession
    idf, other, vectors = weights(templates)
    idf_t = F.broadcast(spark.createDataFrame(list(idf.items()), "token string, idf double"))
    tv = F.broadcast(spark.createDataFrame(
        [(t, i, templates[i][0], w) for i, v in enumerate(vectors) for t, w in v.items()],
        "token string, template int, licence string, tw double"))
    tok = (found.select("rid", F.posexplode("units").alias("unit", "text"))
           .select("rid", "unit", F.explode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("token"))
           .groupBy("rid", "unit", "token").agg(F.count("*").alias("tf")).join(idf_t, "token", "left")
           .withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other))))
    tok = materialize(tok.select("rid", "unit", "token", "w"), "licence-words")
    norm = tok.groupBy("rid", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = tok.join(tv, "token").groupBy("rid", "unit", "template", "licence").agg(
        F.sum(F.col("w") * F.col("tw")).alias("dot"))
    best = dot.join(norm, ["rid", "unit"]).select(
        "rid", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    return (best.where(F.col("score") >= threshold).groupBy("rid")
            .agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
            .select("rid", "b.licence", (-F.col("b.s")).alias("score")))


def ancestors(directory: Column) -> Column:
    """The directory and those above it, with the number of their names, up to the root ""."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(
        i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("above")))


def license_scan(files: DataFrame, path_col: str = "path", text_col: str = "text",
                 threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """path, licence, score, how (own, inherited, none), licence_path of every input row."""
    pattern = trigger(threshold, templates)
    found = materialize(files.select(
        F.monotonically_increasing_id().alias("rid"), F.col(path_col).alias("path"),
        units(F.coalesce(F.col(text_col).cast("string"), F.lit("")), pattern).alias("units")), "licence-units")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    parts = F.filter(F.split(F.regexp_replace("path", r"[^/]*$", ""), "/"), lambda p: p != "")
    own = own_licences(found.where(F.size("units") > 0), threshold, templates)
    rows = materialize(found.select("rid", "path", F.array_join(parts, "/").alias("dir"),
                                    name.rlike(LICENCE_FILE).alias("gives"))
                       .join(own, "rid", "left"), "licence-files")
    given = materialize(rows.where("gives and licence is not null").groupBy(F.col("dir").alias("above")).agg(
        F.min(F.struct((-F.col("score")).alias("s"), "licence", "path")).alias("b")).select(
        "above", F.col("b.licence").alias("up"), (-F.col("b.s")).alias("up_score"),
        F.col("b.path").alias("up_path")), "licence-dirs")
    small = F.broadcast(given) if given.count() <= BROADCAST_ROWS else given
    dirs = rows.where("dir is not null").select("dir").distinct()
    near = (dirs.select("dir", F.explode(ancestors(F.col("dir"))).alias("a"))
            .select("dir", "a.depth", "a.above").join(small, "above").groupBy("dir")
            .agg(F.max(F.struct("depth", "up", "up_score", "up_path")).alias("n")).select("dir", "n.*"))
    near = materialize(near, "licence-near")
    near = F.broadcast(near) if near.count() <= BROADCAST_ROWS else near
    out = rows.join(near, "dir", "left")
    mine = F.col("licence").isNotNull()
    return out.select(
        "path", F.coalesce("licence", "up").alias("licence"),
        F.when(mine, F.col("score")).otherwise(F.col("up_score")).alias("score"),
        F.when(mine, "own").when(F.col("up").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(mine, F.col("path")).otherwise(F.col("up_path")).alias("licence_path"), "rid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op1_license_scan``: licence of every document.

    Documents have no path, so they get one: source / language / hundreds of
    the id / name. A text of at most 40 words that speaks of a licence is that
    directory's LICENSE; every other text is a file named by its id.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    notice = (F.size(F.split(F.trim("text"), r"\s+")) <= 40) & F.lower("text").contains("licen")
    name = F.when(notice, F.concat(F.lit("LICENSE."), F.col("doc_id"))).otherwise(
        F.concat(F.col("doc_id"), F.lit(".txt")))
    group = F.floor(F.col("doc_id") / 100).cast("string")
    # A notice stands one level above the files of its hundred.
    where = F.when(notice, F.concat_ws("/", "source", "lang")).otherwise(
        F.concat_ws("/", "source", "lang", group))
    files = docs.select(F.concat_ws("/", where, name).alias("path"), "text")
    return license_scan(files).drop("rid")


def oracle() -> str:
    """The query in DuckDB SQL, with the template weights as literals."""
    idf, other, vectors = weights()
    idf_rows = ", ".join(f"('{t}', {w!r}::DOUBLE)" for t, w in idf.items())
    tv_rows = ", ".join(f"('{t}', {i}, '{TEMPLATES[i][0]}', {w!r}::DOUBLE)"
                        for i, v in enumerate(vectors) for t, w in v.items())
    words = "|".join(re.escape(w) for w in prefix_words(vectors, THRESHOLD))
    hit = f"(^|[^a-z0-9])({words})([^a-z0-9]|$)"
    return rf"""
WITH idf(token, idf) AS (VALUES {idf_rows}),
tv(token, template, licence, tw) AS (VALUES {tv_rows}),
f0 AS (SELECT row_number() OVER () AS r, doc_id, source, lang, text,
         len(regexp_split_to_array(trim(text), '\s+')) <= 40 AND contains(lower(text), 'licen') AS notice
       FROM documents),
f AS (SELECT r, text, notice,
        source || '/' || lang || CASE WHEN notice THEN '' ELSE '/' || (doc_id // 100) END AS dir,
        source || '/' || lang || CASE WHEN notice THEN '/LICENSE.' || doc_id
          ELSE '/' || (doc_id // 100) || '/' || doc_id || '.txt' END AS path FROM f0),
u AS (SELECT DISTINCT r, u FROM (
        SELECT r, unnest(string_split(lower(text), chr(10))) AS u FROM f
        UNION ALL SELECT r, unnest(regexp_split_to_array(lower(text), '\n[ \t\r]*\n')) FROM f)
      WHERE regexp_matches(u, '{hit}')),
tok AS (SELECT r, u, token, count(*) AS tf FROM (
          SELECT r, u, unnest(regexp_extract_all(u, '{TOKEN}')) AS token FROM u) GROUP BY ALL),
tw AS (SELECT r, u, token, tf * coalesce(idf, {other!r}::DOUBLE) AS w FROM tok LEFT JOIN idf USING (token)),
norm AS (SELECT r, u, sqrt(sum(w * w)) AS norm FROM tw GROUP BY ALL),
dot AS (SELECT r, u, template, licence, sum(w * tv.tw) AS dot FROM tw JOIN tv USING (token) GROUP BY ALL),
best AS (SELECT r, licence, round(dot / norm, 6) AS score FROM dot JOIN norm USING (r, u)),
own AS (SELECT r, licence, score FROM best WHERE score >= {THRESHOLD}
        QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, licence) = 1),
rows_ AS (SELECT f.r, dir, path, notice, licence, score FROM f LEFT JOIN own USING (r)),
given AS (SELECT dir, licence AS up, score AS up_score, path AS up_path FROM rows_
          WHERE notice AND licence IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, licence, path) = 1),
near AS (SELECT r, up, up_score, up_path FROM rows_ JOIN given
         ON rows_.dir = given.dir OR starts_with(rows_.dir, given.dir || '/')
         QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(given.dir) DESC) = 1)
SELECT path, coalesce(licence, up) AS licence, coalesce(score, up_score) AS score,
       CASE WHEN licence IS NOT NULL THEN 'own' WHEN up IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
       CASE WHEN licence IS NOT NULL THEN path ELSE up_path END AS licence_path
FROM rows_ LEFT JOIN near USING (r)
"""


ORACLE = oracle()
