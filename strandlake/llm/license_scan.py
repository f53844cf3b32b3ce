"""Licences of files: sparse TF-IDF cosine of header lines and blocks to templates, then inheritance from the nearest directory above.

Built-in functions only. The templates are fixed, so their weights are one small table of literals; a segment costs its own terms and nothing
more. Directories, not files, are joined to the licence files above them, so a directory of any number of files is one row there.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, skew_join

_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
#: Notices by licence, as the licences' own texts give them; of equal cosines the first wins.
NOTICES: tuple[tuple[str, str], ...] = (
    ("agpl-3.0", _GNU.format("Affero General Public License", 3)),
    ("agpl-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("all-rights-reserved", "All rights reserved."),
    ("all-rights-reserved", "Copyright (c). All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("bsd-3-clause", "Released under the BSD 3-Clause License, the new or revised BSD license."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-2-clause", "Released under the BSD 2-Clause License, the simplified BSD license."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-1.0", "Dedicated to the public domain under CC0 1.0 Universal, the Creative Commons Zero license."),
    ("gpl-2.0", _GNU.format("General Public License", 2)),
    ("gpl-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", _GNU.format("General Public License", 3)),
    ("gpl-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "Released under the ISC License."),
    ("lgpl-2.1", _GNU.format("Lesser General Public License", "2.1")),
    ("lgpl-3.0", _GNU.format("Lesser General Public License", 3)),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit", "The MIT License (MIT)"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
#: SPDX names with templates of their own.
SPDX = (
    "AGPL-3.0 Apache-2.0 BSD-2-Clause BSD-3-Clause CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 GPL-2.0 GPL-3.0 ISC LGPL-2.1 LGPL-3.0 MIT MPL-2.0 Unlicense"
).split()
TEMPLATES: tuple[tuple[str, str], ...] = NOTICES + tuple((name.lower(), f"SPDX-License-Identifier: {name}") for name in SPDX)

#: Terms are runs of letters and digits of the lower-cased text; "v2" counts as "2", and years don't count.
TERM = "[a-z0-9]+"
VERSION = "^v([0-9]+)$"
YEAR = "^(19|20)[0-9][0-9]$"
#: Blocks of lines are parted by lines without a term.
#: Everyday words, which tell nothing about licences and weigh nothing.
STOP = frozenset(
    "a above all an and any appear are as at be by so can code copy except fee for form forms from have held if in into is it its level may met name names new no nor not of on one or other out persons"
    " prior products program provided purpose specific subject terms that the this to under used use was whom will with without work written you your"
    " https http www org com one two three january february march april june july august september october november december c v option into neither"
    " distributed distribute following conditions deal person obtaining obtain associated including limitation permit furnished files file".split()
)
GAP = r"\n(?:[^a-z0-9\n]*\n)+"
LICENCE_FILE = r"(?i)(^|/)(un)?(licen[sc]e|copying|copyright|notice)([._-][^/]*)?$"
MIN_COSINE = 0.6


def _terms(phrase: str) -> list[str]:
    found = (re.sub(VERSION, r"\1", t) for t in re.findall(TERM, phrase.lower()))
    return [t for t in found if not re.match(YEAR, t) and t not in STOP]


def template_weights() -> tuple[dict[str, float], list[tuple[str, int, float]], float]:
    """Each term's idf; (term, template, its part of the template's unit vector); the idf of other terms."""
    counts = [Counter(_terms(phrase)) for _, phrase in TEMPLATES]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in sorted(df.items())} | dict.fromkeys(sorted(STOP), 0.0)
    parts = []
    for i, c in enumerate(counts):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        parts += [(t, i, n * idf[t] / norm) for t, n in sorted(c.items())]
    return idf, parts, math.log(1 + len(counts)) + 1


def needed_terms(least: float = MIN_COSINE) -> list[str]:
    """Terms of which a segment must hold one to reach a cosine of `least` with any template.

    A cosine is at most the length of the template's unit vector over the shared terms, so the terms left out of each template are its lightest, whose squares sum to
    less than least squared.
    """
    _, parts, _ = template_weights()
    needed = set()
    for i in range(len(TEMPLATES)):
        left = least**2 - 1e-6
        for w, t in sorted((w, t) for t, j, w in parts if j == i):
            left -= w * w
            if left < 0:
                needed.add(t)
    return sorted(needed)


def hint() -> str:
    """A pattern that every lower-cased segment with a needed term matches."""
    return f"(?:^|[^a-z0-9])(?:{'|'.join(f'v?{t}' if t.isdigit() else t for t in needed_terms())})(?:$|[^a-z0-9])"


def may_reach(segment: Column, least: float = MIN_COSINE) -> Column:
    """False only for lower-cased segments whose cosine to every template is below `least`: told from the counts of their terms, within the row.

    With K and U the squared weights of the segment's terms that templates do and don't hold, a cosine is at most sqrt(K / (K + U)). K is at most the largest idf squared times the
    squared counts of those terms; U is at least the squared idf of foreign terms times n * n / d, for n of them, d different ones.
    """
    idf, _, other = template_weights()
    known = [t for t, w in idf.items() if w]
    known += [f"v{t}" for t in known if t.isdigit()]
    terms = F.regexp_extract_all(segment, F.lit(TERM), F.lit(0))
    ours = F.filter(terms, lambda t: t.isin(known))
    foreign = F.filter(terms, lambda t: ~t.isin([*known, *sorted(STOP)]) & ~t.rlike(YEAR))
    squares = F.aggregate(F.transform(F.array_distinct(ours), lambda t: F.size(F.filter(ours, lambda x: x == t))), F.lit(0).cast("double"), lambda a, n: a + n * n)
    n, d = F.size(foreign), F.greatest(F.size(F.array_distinct(foreign)), F.lit(1))
    # a version with a v and its number may be one term counted twice over, hence the factor 2
    most = 2 * max(idf.values()) ** 2 * squares
    return n.cast("double") * n / d * other**2 * least**2 <= most * (1 - least**2) + 1e-6


def idf_rows() -> str:
    return ", ".join(f"('{t}', {w!r}D)" for t, w in template_weights()[0].items())


def part_rows() -> str:
    return ", ".join(f"('{t}', {i}, {w!r}D)" for t, i, w in template_weights()[1])


def name_rows() -> str:
    return ", ".join(f"({i}, '{name}')" for i, (name, _) in enumerate(TEMPLATES))


def _table(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    """A table of literals, some hundred rows whatever the input."""
    return F.broadcast(spark.sql(f"select * from values {rows} as w({columns})"))


def license_scan(files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: <id_col>, license and cosine (of the best segment; null if none reaches MIN_COSINE), segment ("line" or "block") and line
    (its number of that kind, from 0), licence_file, inherited_license and inherited_from (a directory).

    Segments are all lines, and all blocks of two or more lines between lines without a term. Of equal cosines, the first template, then "block", then the first
    number wins. A file is a licence file if its name says so, or if its best segment holds half of its terms or more. A file without a licence of its own inherits
    from the nearest directory at or above its own that has a licence file with a licence; where files there differ, the most frequent licence counts, then the
    first by name. Null and empty texts have no licence of their own; a null path is the root. Repeated rows get equal results; other columns are ignored.
    Only segments that may reach MIN_COSINE (needed_terms, may_reach) leave the scan; a long text costs no more than its lines and blocks.
    """
    spark, pattern = files.sparkSession, hint()
    _, _, other = template_weights()
    rows = files.select(
        F.col(id_col).alias("_id"),
        F.regexp_extract(F.coalesce(path, F.lit("")), "^(.*)/[^/]*$", 1).alias("_dir"),
        F.coalesce(path.rlike(LICENCE_FILE), F.lit(False)).alias("_named"),
        F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"),
    ).withColumn("_hash", F.xxhash64("_text"))
    key = ["_id", "_hash", "_dir", "_named"]
    hinted = rows.where(F.col("_text").rlike(pattern)).withColumn("_size", F.size(F.regexp_extract_all("_text", F.lit(TERM), F.lit(0))))

    def cut_at(kind: str, at: str) -> Column:
        parts = F.transform(F.split("_text", at), lambda s, i: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("line"), s.alias("segment")))
        return F.filter(parts, lambda p: p["segment"].rlike(pattern) & (F.lit(kind == "line") | p["segment"].contains("\n")))

    found = hinted.select(*key, "_size", F.explode(F.concat(cut_at("block", GAP), cut_at("line", "\n"))).alias("s")).select(*key, "_size", "s.*")
    segments = cut(found.where(may_reach(F.col("segment"))).dropDuplicates([*key, "kind", "line"]))
    own_key = [*key, "_size", "kind", "line"]
    term = F.regexp_replace("term", VERSION, "$1")
    terms = segments.select(*own_key, F.explode(F.regexp_extract_all("segment", F.lit(TERM), F.lit(0))).alias("term")).select(*own_key, term.alias("term"))
    counted = terms.groupBy(*own_key, "term").agg(F.count(F.lit(1)).alias("n")).withColumn("year", F.col("term").rlike(YEAR))
    weighted = counted.join(_table(spark, idf_rows(), "term, idf"), "term", "left").withColumn("w", F.when(F.col("year"), 0.0).otherwise(F.col("n") * F.coalesce("idf", F.lit(other))))
    with_norm = cut(weighted.groupBy(*own_key).agg(F.sum(F.col("w") * F.col("w")).alias("n2"), F.sum("n").alias("_terms"), F.collect_list(F.struct("term", "w")).alias("ts")))
    dots = with_norm.select(*own_key, "n2", "_terms", F.explode("ts").alias("t")).select(*own_key, "n2", "_terms", "t.*")
    dots = dots.join(_table(spark, part_rows(), "term, i, part"), "term").groupBy(*own_key, "n2", "_terms", "i").agg(F.sum(F.col("w") * F.col("part")).alias("d"))
    scored = dots.withColumn("c", F.round(F.col("d") / F.sqrt(F.nullif(F.col("n2"), F.lit(0.0))), 4)).where(F.col("c") >= MIN_COSINE)
    best = scored.groupBy(*key, "_size").agg(F.min(F.struct((-F.col("c")).alias("c"), "i", "kind", "line", "_terms")).alias("b"))
    own = best.join(_table(spark, name_rows(), "i, name"), F.col("b.i") == F.col("i")).select(
        *key, F.col("name").alias("license"), (-F.col("b.c")).alias("cosine"), F.col("b.kind").alias("segment"), F.col("b.line").alias("line"),
        (F.col("_named") | (F.col("b._terms") * 2 >= F.col("_size"))).alias("licence_file"),
    )
    own = cut(own)

    theirs = own.select(*[F.col(k).alias(f"own{k}") for k in key], "license", "cosine", "segment", "line", "licence_file")
    same = [F.col(k).eqNullSafe(F.col(f"own{k}")) for k in key]
    licensed = cut(rows.select(*key).join(theirs, same, "left").drop(*[f"own{k}" for k in key]))
    by_dir = licensed.where("licence_file").groupBy("_dir", "license").agg(F.count(F.lit(1)).alias("n"))
    licences = cut(by_dir.groupBy("_dir").agg(F.min(F.struct(-F.col("n"), "license")).alias("b")).select(F.col("_dir").alias("_above"), F.col("b.license").alias("inherited_license")))
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    dirs = licensed.groupBy("_dir").agg(F.count(F.lit(1)).alias("_n")).select("_dir", F.posexplode(above).alias("_depth", "_above"))
    nearest = skew_join(dirs, licences, "_above", by_key_rows=licences.count()).groupBy("_dir").agg(F.max(F.struct("_depth", "inherited_license", "_above")).alias("b"))
    nearest = nearest.select("_dir", F.col("b.inherited_license").alias("inherited_license"), F.col("b._above").alias("inherited_from"))
    inherits = F.col("license").isNull()
    return skew_join(licensed, nearest, "_dir", "left").select(
        F.col("_id").alias(id_col), "license", "cosine", "segment", "line",
        F.coalesce("licence_file", F.lit(False)).alias("licence_file"),
        F.when(inherits, F.col("inherited_license")).alias("inherited_license"),
        F.when(inherits, F.col("inherited_from")).alias("inherited_from"),
    )
