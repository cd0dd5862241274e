"""Cosines and inheritance by brute force on small trees."""

import math
import re
from collections import Counter

from spanloom.llm import license_scan as op


def brute_score(unit):
    idf, other, vectors = op.weights()
    v = {t: k * idf.get(t, other) for t, k in Counter(re.findall(op.TOKEN, unit.lower())).items()}
    size = math.sqrt(sum(x * x for x in v.values()))
    best = None
    for (name, _), tv in zip(op.TEMPLATES, vectors, strict=True):
        s = round(sum(w * v.get(t, 0.0) for t, w in tv.items()) / size, 6) if size else 0.0
        if s >= op.THRESHOLD and (best is None or (-s, name) < best):
            best = (-s, name)
    return best


def brute(rows):
    own = []
    for path, text in rows:
        low = (text or "").lower()
        found = [b for u in {*low.split("\n"), *re.split(r"\n[ \t\r]*\n", low)} if (b := brute_score(u))]
        own.append(min(found) if found else None)
    given = {}
    for (path, _), b in zip(rows, own, strict=True):
        if b and path is not None and re.match(op.LICENCE_FILE, path.rsplit("/", 1)[-1]):
            d = "/".join(p for p in path.split("/")[:-1] if p)
            given[d] = min(given.get(d, (*b, path)), (*b, path))
    out = []
    for (path, _), b in zip(rows, own, strict=True):
        if b:
            out.append((path, b[1], -b[0], "own", path))
            continue
        hit = None
        if path is not None:
            parts = [p for p in path.split("/")[:-1] if p]
            for k in range(len(parts), -1, -1):
                hit = hit or given.get("/".join(parts[:k]))
        out.append((path, hit[1], -hit[0], "inherited", hit[2]) if hit else (path, None, None, "none", None))
    return sorted(map(str, out))


def test_tree(spark):
    mit, apache = "Released under the MIT License.", "x\nLicensed under the Apache License, Version 2.0.\ny"
    gpl = ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General "
           "Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n"
           "(at your option) any later version.\n\ncode()")
    rows = [("LICENSE", mit), ("a/COPYING", gpl), ("a/b/c/main.py", "print()"), ("a/b/x.py", apache),
            ("z/y.py", "the license is unclear to me"), ("a/b/LICENSE.txt", "all rights reserved"),
            ("q/LICENSE", "Licensed under CC BY-NC 4.0."), ("q/LICENSE-2", apache), ("q/r/s.txt", None),
            ("q/r/s.txt", None), (None, mit), (None, "nothing"), ("top.txt", ""), ("/q//r/t.txt", "the"),
            ("a/bb/n.py", "mit"), ("w/u.py", "SPDX-License-Identifier: Apache-2.0")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "path string, text string, licence string")
    out = op.license_scan(df).collect()
    assert sorted(str((r["path"], r["licence"], r["score"], r["how"], r["licence_path"])) for r in out) == brute(rows)
    assert {r["path"]: r["licence"] for r in out}["a/b/c/main.py"] == "GPL-3.0"


def test_prefix_words_lose_nothing():
    """Dropping every prefix word from a template leaves it under the threshold."""
    words = set(op.prefix_words(op.weights()[2], op.THRESHOLD))
    for _, text in op.TEMPLATES:
        rest = [t for t in re.findall(op.TOKEN, text.lower()) if t not in words]
        assert brute_score(" ".join(rest)) is None


def test_empty_and_plan(spark):
    df = spark.createDataFrame([], "path string, text string")
    out = op.license_scan(df)
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
