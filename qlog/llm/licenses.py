"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Windows come in classes of length and step, so that every template lies whole in some window of its
class and fills a known share of it. That share is the least Jaccard similarity of a match, from which
the number of bands follows: a match collides in at least one band with the asked probability. All
retrieved pairs are verified on the shingles themselves. DataFrame functions only.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qlog.llm.common import text_key, written

SHINGLE, LEAST, MISS = 5, 0.8, 1e-6
#: (length, step) of windows in words; a class takes templates of up to length - step + 1 words.
CLASSES = [(8 << k, 2 << k) for k in range(10)]

# Notices by which texts name their licence.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def template_shingles(text: str) -> list[str]:
    w = template_words(text)
    return list(dict.fromkeys(" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))))


def anchors_for(templates: list[tuple[str, str]]) -> list[str]:
    """Words of which every match of any template holds at least one.

    For each template words are added, long ones first, until its shingles without any of them are too
    few to reach the threshold. Texts and windows without such a word need not be looked at.
    """
    chosen: list[str] = []
    for _, t in templates:
        shingles = [x.split() for x in template_shingles(t)]
        need = math.ceil(LEAST * len(shingles))
        while len(bare := [x for x in shingles if not set(x) & set(chosen)]) >= need:
            chosen.append(max({w for x in bare for w in x}, key=lambda w: (min(len(w), 7), sum(w in x for x in bare), w)))
    return chosen


def template_class(words: int) -> int:
    """Smallest class whose windows hold a template of so many words whole."""
    if words < SHINGLE:
        raise ValueError(f"a licence template has {SHINGLE} words at least, this one has {words}")
    fit = [k for k, (length, step) in enumerate(CLASSES) if words <= length - step + 1]
    if not fit:
        raise ValueError(f"a licence template has {CLASSES[-1][0] - CLASSES[-1][1] + 1} words at most, this one has {words}; split it")
    return fit[0]


def bands_for(templates: list[tuple[str, str]], miss: float = MISS) -> int:
    """Bands of one MinHash value each that a match misses altogether with probability ``miss`` at most.

    The least similarity of a match is its needed shingles over those of a whole window of its class.
    """
    least = 1.0
    for _, t in templates:
        n, (length, _) = len(template_shingles(t)), CLASSES[template_class(len(template_words(t)))]
        need = math.ceil(LEAST * n)
        least = min(least, need / (length - SHINGLE + 1 + n - need))
    return 1 if least >= 1 else math.ceil(math.log(miss) / math.log(1 - least))


def _shingles(words: Column) -> Column:
    """Distinct shingles; fewer words than a shingle make none."""
    return F.when(
        F.size(words) >= SHINGLE,
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - SHINGLE + 1), lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))),
    ).otherwise(F.array().cast("array<string>"))


def _signature(shingles: Column, bands: int) -> Column:
    """One MinHash value a band."""
    hashes = F.transform(shingles, lambda s: F.xxhash64(s))
    each = lambda hs: F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda k: F.array_min(F.transform(hs, lambda h: F.xxhash64(h, k))))
    return F.get(F.transform(F.array(hashes), each), F.lit(0))  # the shingles are hashed once, not once a band


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, found: str = "licenses") -> DataFrame:
    """``docs`` with ``found``: sorted array of struct(license, containment) of its notices, empty if none.

    A notice is found where one window holds at least 0.8 of a template's distinct five-word shingles;
    ``containment`` is the best share. Null and empty texts have none. Repeated rows are found alike. An
    input column named ``found`` is replaced. Templates are a parameter of some hundred rows, whole licence
    bodies among them; their bands are broadcast. One of under five or too many words is an error.
    """
    templates = TEMPLATES if templates is None else templates
    spark, bands = docs.sparkSession, bands_for(templates)
    rows = [(k, name, template_class(len(template_words(t))), template_shingles(t)) for k, (name, t) in enumerate(templates)]
    known = spark.createDataFrame(rows, "template int, license string, class int, shingles array<string>")
    known = known.select("*", F.posexplode(_signature(F.col("shingles"), bands)).alias("band", "value"))
    docs = docs.drop(found)
    keyed = docs.withColumn("_h", text_key())
    anchor = "(?<![a-z0-9])(?:" + "|".join(anchors_for(templates)) + ")(?![a-z0-9])"
    text = keyed.select("_h", "text").where(F.lower("text").rlike(anchor))
    words = text.select("_h", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("w")).where(F.size("w") >= SHINGLE)
    classes = sorted({r[2] for r in rows})
    windows = F.array(*[_windows(c) for c in classes])
    cut = words.select("_h", F.explode(F.flatten(windows)).alias("x")).select("_h", "x.class", "x.part")
    cut = cut.where(F.array_join("part", " ").rlike(anchor))
    signed = cut.select("_h", "class", _shingles(F.col("part")).alias("own")).where(F.size("own") > 0)
    signed = signed.select("*", F.posexplode(_signature(F.col("own"), bands)).alias("band", "value"))
    met = signed.join(F.broadcast(known), ["class", "band", "value"])
    share = F.size(F.array_intersect("shingles", "own")) / F.size("shingles")
    sure = met.select("_h", "license", share.alias("share")).where(F.col("share") >= LEAST).groupBy("_h", "license").agg(F.max("share").alias("containment"))
    lists = sure.groupBy("_h").agg(F.array_sort(F.collect_list(F.struct("license", "containment"))).alias(found))
    out = keyed.join(written(lists, "licenses"), "_h", "left")  # two plain shuffles: a hot text can be split
    return out.withColumn(found, F.coalesce(found, F.array().cast("array<struct<license:string,containment:double>>"))).select(*docs.columns, found)


def _windows(c: int) -> Column:
    length, step = CLASSES[c]
    return F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step)), lambda i: F.named_struct(F.lit("class"), F.lit(c), F.lit("part"), F.slice("w", i + 1, length)))


def license_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_licenses, licenses (comma-joined names) and best containment of every document.

    Null and empty texts have 0, "" and 0.0; repeated rows are listed as often as they are there.
    """
    thin = docs.select("doc_id", "text")
    found = scan_licenses(thin)
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.transform("licenses", lambda x: x["license"]), ",").alias("licenses"),
        F.round(F.coalesce(F.array_max(F.transform("licenses", lambda x: x["containment"])), F.lit(0.0)), 6).alias("containment"),
    )


def digest_sql() -> str:
    """DuckDB twin: the same windows, each compared with every template directly."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    shingles = ",\n".join(f"({k}, {quoted(name)}, {template_class(len(template_words(t)))}, {len(template_shingles(t))}, {quoted(s)})" for k, (name, t) in enumerate(TEMPLATES) for s in template_shingles(t))
    used = {template_class(len(template_words(t))) for _, t in TEMPLATES}
    classes = ", ".join(f"({k}, {length}, {step})" for k, (length, step) in enumerate(CLASSES) if k in used)
    return f"""
WITH t(template, license, class, n, s) AS (VALUES {shingles}),
k(class, length, step) AS (VALUES {classes}),
w AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
s AS (
  SELECT rid, i - 1 AS p, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS s
  FROM (SELECT rid, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM w WHERE len(w) >= {SHINGLE})),
h AS (SELECT rid, template, license, class, n, s, p FROM s JOIN t USING (s)),
x AS (
  SELECT rid, template, license, n, v * step AS start, count(DISTINCT s) AS c
  FROM (SELECT h.*, k.length, k.step, unnest(range(greatest(0, CAST(ceil((p + {SHINGLE} - k.length) / k.step) AS BIGINT)), p // k.step + 1)) AS v FROM h JOIN k USING (class))
  WHERE p >= v * step AND p + {SHINGLE} <= v * step + length
  GROUP BY rid, template, license, n, v * step),
m AS (SELECT rid, license, max(c / n) AS share FROM x WHERE c / n >= {LEAST} GROUP BY rid, license),
l AS (SELECT rid, count(*) AS n, string_agg(license, ',' ORDER BY license) AS names, max(share) AS best FROM m GROUP BY rid)
SELECT doc_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_licenses, coalesce(names, '') AS licenses, round(coalesce(best, 0.0), 6) AS containment
FROM w LEFT JOIN l USING (rid)
"""
