"""The licence scan against plain Python without any filter, real notices, and directories within directories."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandlake.llm.license_scan import GAP, LICENCE_FILE, MIN_COSINE, SPDX, TEMPLATES, YEAR, _terms, hint, license_scan, may_reach, template_weights

IDF, PARTS, OTHER = template_weights()
VECTORS = [{t: w for t, j, w in PARTS if j == i} for i in range(len(TEMPLATES))]


def cosines(segment):
    found = {t: n * IDF.get(t, OTHER) for t, n in Counter(_terms(segment)).items()}
    norm = math.sqrt(sum(w * w for w in found.values()))
    return [round(sum(w * v.get(t, 0.0) for t, w in found.items()) / norm, 4) if norm else 0.0 for v in VECTORS]


def best_of(text):
    """(licence, cosine, kind, number, terms) of the best of all lines and blocks; None if none is near enough."""
    segments = [("block", i, s) for i, s in enumerate(re.split(GAP, text.lower())) if "\n" in s] + [("line", i, s) for i, s in enumerate(text.lower().split("\n"))]
    scored = [(-c, i, kind, n, len(re.findall("[a-z0-9]+", s))) for kind, n, s in segments for i, c in enumerate(cosines(s)) if c >= MIN_COSINE]
    return (TEMPLATES[min(scored)[1]][0], -min(scored)[0], *min(scored)[2:]) if scored else None


def brute(files):
    own = [best_of(t or "") for _, _, t in files]
    dirs = [re.match("^(?:(.*)/[^/]*)?", p or "").group(1) or "" for _, p, _ in files]
    counts = {}
    for (_, p, t), o, d in zip(files, own, dirs, strict=True):
        if o and (re.search(LICENCE_FILE, p or "") or 2 * o[4] >= len(re.findall("[a-z0-9]+", (t or "").lower()))):
            counts.setdefault(d, Counter())[o[0]] += 1
    chosen = {d: min(c, key=lambda k, c=c: (-c[k], k)) for d, c in counts.items()}
    out = []
    for (i, _, _), o, d in zip(files, own, dirs, strict=True):
        parts = d.split("/")
        above = next((a for n in range(len(parts), 0, -1) if (a := "/".join(parts[:n])) in chosen), None)
        out.append((i, *(o[:4] if o else (None,) * 4), None if o else chosen.get(above), None if o else above))
    return out


GPL = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * Something else follows here.
 */
int main;"""
MIT = "Copyright (c) 2021 Foo\n\n" + dict(reversed([x for x in TEMPLATES if len(x[1]) > 300 and x[0] == "mit"]))["mit"]
HEADERS = [
    ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("// SPDX-License-Identifier: MIT", "mit"), ("# SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3.0"),
    ("Copyright 2020 Foo Inc. All rights reserved.", "all-rights-reserved"), ("Released under CC BY 4.0.", "cc-by-4.0"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("Released under the MIT License.", "mit"), (GPL, "gpl-3.0"), (MIT, "mit"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"), ("The old mill stands by the river.", None), ("A free version of the public program, licensed to nobody at all.", None),
    ("", None), ("the of and", None),
]


@pytest.mark.parametrize("text,want", HEADERS)
def test_notices(text, want):
    assert (best_of(text) or (None,))[0] == want


def test_every_template_is_its_own_best_licence():
    assert {best_of(phrase)[0] == name for name, phrase in TEMPLATES} == {True} and len({n for n, _ in TEMPLATES}) > 15
    assert all(n.lower() in {x for x, _ in TEMPLATES} for n in SPDX)


def test_the_filter_loses_no_segment():
    """Every mix of words from the templates that comes near enough holds a needed term."""
    import random

    rng = random.Random(3)
    vocabulary = [t for t, _, _ in PARTS]
    for _ in range(4000):
        words = rng.choice(TEMPLATES)[1].split()
        text = " ".join(rng.sample(words, rng.randint(1, len(words))) + rng.sample(vocabulary, rng.randint(0, 3))).lower()
        assert max(cosines(text)) < MIN_COSINE or re.search(hint(), text)


def test_the_counts_lose_no_segment(spark):
    import random

    rng = random.Random(4)
    vocabulary, texts = [t for t, _, _ in PARTS] + ["v2", "v3", "2", "1999", "mill", "river", "village"], []
    for _ in range(3000):
        words = rng.choice(TEMPLATES)[1].split()
        texts.append(" ".join(rng.sample(words, rng.randint(1, len(words))) * rng.randint(1, 3) + rng.choices(vocabulary, k=rng.randint(0, 12))).lower())
    rows = spark.createDataFrame([(t,) for t in [*texts, "mit dem " + "wort und satz " * 50]], "t string").select("t", may_reach(F.col("t")).alias("may")).collect()
    assert all(r["may"] for r in rows if max(cosines(r["t"])) >= MIN_COSINE) and not rows[-1]["may"] and sum(r["may"] for r in rows) < len(rows)


def test_scan(spark):
    files = [(i, f"/p/src/f{i}.c", t) for i, (t, _) in enumerate(HEADERS)]
    files += [
        (100, "/a/LICENSE", MIT + "\n" + "more text " * 300), (101, "/a/b/c/x.c", "int main"), (102, "/a/b/COPYING", GPL), (103, "/a/b/c/d/y.c", ""), (104, "/ab/z.c", None), (105, None, "text"),
        (106, "LICENSE", "Released under the MIT License."), (107, "/a/b/notice.txt", "nothing here"), (108, "/e/f.txt", "Released under the ISC License."), (109, "/e/g/h.c", "x"), (None, "/e/g/i.c", "x"), (None, "/e/g/i.c", "x"),
        (110, "/e/LICENSE", "Released under the MIT License."), (111, "/v/y.c", "GPL v3 or 1999 " * 20_000),
    ]
    assert all(re.match(YEAR, y) for y in ("1999", "2024"))
    docs = spark.createDataFrame([(*f, "x", 0.5, "s") for f in files], "doc_id long, path string, text string, license string, cosine double, _dir string").repartition(3)
    got = [tuple(r[k] for k in ("doc_id", "license", "cosine", "segment", "line", "inherited_license", "inherited_from")) for r in license_scan(docs, F.col("path")).collect()]
    assert sorted(got, key=str) == sorted(brute(files), key=str)
    by = {g[0]: g for g in got}
    assert by[101][5:] == ("gpl-3.0", "/a/b") and by[103][5:] == ("gpl-3.0", "/a/b") and by[104][5:] == ("mit", "") and by[109][5:] == ("isc", "/e")
    assert license_scan(docs.where("false"), F.col("path")).collect() == []
