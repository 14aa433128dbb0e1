"""Licence scans: sparse TF-IDF cosine to templates, then the nearest ancestor directory's licence."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattweave.llm.common import ROW, join_counted, stored, with_row_id

#: SPDX identifier -> (titles, spoken names). Notices are built from them by `forms`.
LICENCES = {
    "Apache-2.0": (["Apache License", "Apache License Version 2.0, January 2004"], ["Apache License, Version 2.0", "Apache 2.0 License"]),
    "BSD-3-Clause": (["BSD 3-Clause License"], ["BSD 3-Clause License"]),
    "CC-BY-4.0": (["Creative Commons Attribution 4.0 International"],
                  ["Creative Commons Attribution 4.0 International License, CC BY 4.0", "CC BY 4.0"]),
    "CC-BY-NC-4.0": (["Creative Commons Attribution-NonCommercial 4.0 International"],
                     ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"]),
    "CC0-1.0": (["CC0 1.0 Universal"], ["CC0 1.0 Universal public domain dedication"]),
    "GPL-3.0": (["GNU General Public License", "GNU General Public License Version 3, 29 June 2007"],
                ["GNU General Public License, version 3"]),
    "LGPL-3.0": (["GNU Lesser General Public License", "GNU Lesser General Public License Version 3, 29 June 2007"],
                 ["GNU Lesser General Public License, version 3"]),
    "MIT": (["MIT License", "The MIT License (MIT)"], ["MIT License"]),
    "MPL-2.0": (["Mozilla Public License Version 2.0"], ["Mozilla Public License, version 2.0"]),
}
#: Openings and notices of the licences in their own words.
TEXTS = {
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Terms and conditions for use, reproduction, and distribution"],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
        "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal."],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."],
    "LGPL-3.0": ["This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU "
                 "General Public License, supplemented by the additional permissions listed below."],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Proprietary": ["All rights reserved.", "All rights reserved. No part may be copied or distributed without written permission."],
}
SUBJECTS = ["", "This work is ", "This project is ", "This software is "]
VERBS = ["licensed", "released"]
CUE = r"(?i)licen[cs]e|copyright|all rights reserved|public domain|spdx|permission is hereby granted|redistribution and use"
TERM = r"[a-z0-9][a-z0-9.\-]*[a-z0-9]|[a-z0-9]"
BLANK = r"\n[^\p{L}\p{N}]*\n"
FILE = r"(?i)^(licen[cs]e|copying|notice)([.\-_].*)?$"
LEAST = 0.7


def forms() -> dict[str, list[str]]:
    """Per licence its titles, SPDX lines, notices by name ('Released under the ...') and the texts of its own."""
    out = {k: list(v) for k, v in TEXTS.items()}
    for spdx, (titles, names) in LICENCES.items():
        lines = [*titles, *[f"SPDX-License-Identifier: {spdx}{tail}" for tail in ["", "-only", "-or-later"] if "GPL" in spdx or not tail]]
        lines += [f"{subject}{verb} under the {name}." for name in names for subject in SUBJECTS for verb in VERBS]
        out[spdx] = lines + out.get(spdx, [])
    return out


def template_terms(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    """(licence, distinct terms in order) of each form; forms of a licence with the same terms are one."""
    sets = {(k, tuple(sorted(set(re.findall(TERM, text.lower()))))) for k, texts in templates.items() for text in texts}
    return [(k, list(terms)) for k, terms in sorted(sets) if terms]


def _quoted(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def header_units(text: Column, name: Column) -> Column:
    """The term sets of a text's headers: each line with a word of CUE, each block with one (blocks are parted by lines
    without a letter or digit), and the whole text of a licence file. Equal sets of a row are one."""

    def terms(part: Column) -> Column:
        return F.sort_array(F.array_distinct(F.regexp_extract_all(F.lower(part), F.lit(TERM), F.lit(0))))

    parts = [F.filter(F.split(text, "\n"), lambda x: x.rlike(CUE)), F.filter(F.split(text, BLANK), lambda x: x.rlike(CUE)),
             F.when(name.rlike(FILE), F.array(text)).otherwise(F.array().cast("array<string>"))]
    units = F.filter(F.array_distinct(F.transform(F.concat(*parts), terms)), lambda x: F.size(x) > 0)
    return F.when(text.rlike(CUE) | F.coalesce(name.rlike(FILE), F.lit(False)), units).otherwise(F.array().cast("array<array<string>>"))


def own_licenses(rows: DataFrame, templates: dict[str, list[str]], least: float) -> DataFrame:
    """(row id, license, score) of the rows that have a header as near as `least` to a form of a licence.

    `rows` has the row id and its units. A term weighs ln(1 + N / units with the term), N being all units of the table
    and all forms. Cosines are rounded to 6 places; the best counts, of equals the first licence by name. The forms'
    terms are a table of fixed size; frequent terms meet their weight in a broadcast of fewer than a thousand.
    """
    fixed = template_terms(templates)
    in_forms = Counter(t for _, terms in fixed for t in terms)
    units = rows.select(ROW, F.posexplode("units").alias("unit", "terms"))
    terms = stored(units.select(ROW, "unit", F.explode("terms").alias("t")), "license_terms")
    counted = stored(terms.groupBy("t").agg(F.count(F.lit(1)).alias("n")), "license_term_counts")
    n_terms, n_units = terms.count(), units.count()
    found = {r["t"]: r["n"] for r in counted.where(F.col("t").isin(sorted(in_forms))).collect()}  # at most the forms' terms
    weight = {t: math.log(1 + (n_units + len(fixed)) / (n + found.get(t, 0))) for t, n in in_forms.items()}

    entries = []
    for form, (license, own) in enumerate(fixed):
        norm = math.sqrt(sum(weight[t] ** 2 for t in own))
        entries += [(form, license, t, weight[t] / norm) for t in own]
    forms_in = F.create_map(*[x for t, n in sorted(in_forms.items()) for x in (F.lit(t), F.lit(n))])
    idf = F.log(1 + F.lit(n_units + len(fixed)) / (F.col("n") + F.coalesce(F.try_element_at(forms_in, F.col("t")), F.lit(0))))
    weighed = stored(join_counted(terms, counted, "t", "n", n_terms).select(ROW, "unit", "t", idf.alias("w")), "license_weights")
    entries = entries or [(-1, "", "", 0.0)]  # no forms: no term is empty, so nothing is found
    table = rows.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(
        f"({form}, {_quoted(k)}, '{t}', {u!r}D)" for form, k, t, u in entries) + " AS forms(form, license, t, u)")
    norms = weighed.groupBy(ROW, "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(table), "t").groupBy(ROW, "unit", "form", "license").agg(F.sum(F.col("w") * F.col("u")).alias("dot"))
    scores = dots.join(norms, [ROW, "unit"]).select(ROW, "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    best = scores.where(F.col("score") >= least).groupBy(ROW).agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select(ROW, F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def scan_licenses(files: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """file, license, score, found ('header', 'directory' or 'none') and from_dir of each (file, path, text) row.

    A file's own header comes first (a line, a block or, in a licence file, the whole text; see `header_units`). Else it
    has the licence of the nearest of its directories, up to the root, that has a licence file (a name like LICENSE,
    COPYING or NOTICE) with a licence; of several there the best score, then the first name. `templates` has the texts
    of each licence. A bare title such as 'GNU General Public License' counts as the version that is listed. A line with
    several words that no form has ('... MIT License by the authors') stays below the border, as rare words weigh most.
    Only the distinct directories are expanded to their ancestors and joined; a directory with many below it (the root,
    say) and one with many files is broadcast. `file` is only passed on: it may be null or repeated.
    from_dir of the root is / for absolute paths and empty for relative ones.
    Null or empty text: no header. Null path: no directory, so only a header counts. Repeated rows stay, each with the
    same answer. Empty table: no rows. Other columns are not read.
    """
    templates = forms() if templates is None else templates
    files = with_row_id(files.select("file", "path", F.coalesce("text", F.lit("")).alias("text")))
    # the root is / of absolute paths and empty for relative ones; a null path has a null directory
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    folder = F.when(F.col("path").startswith("/") & (folder == ""), "/").otherwise(folder)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    marked = stored(files.select(ROW, "file", folder.alias("dir"), name.alias("name"), header_units(F.col("text"), name).alias("units")), "files")
    place = F.coalesce(F.concat(F.lit("="), "dir"), F.lit("-"))  # a key for null directories too
    marked = marked.withColumn("place", place)
    some = marked.where(F.size("units") > 0)
    own = own_licenses(some.select(ROW, "units"), templates, least)
    kept = ["file", "dir", "name", "place", "license", "score"]
    plain = marked.where(F.size("units") == 0).withColumns({"license": F.lit(None).cast("string"), "score": F.lit(None).cast("double")})
    light = stored(some.select(ROW, "file", "dir", "name", "place").join(own, ROW, "left").select(*kept).unionByName(plain.select(*kept)), "own")
    best = F.min(F.struct((-F.col("score")).alias("s"), "license"))
    holds = light.where(F.col("license").isNotNull() & F.col("name").rlike(FILE) & F.col("dir").isNotNull()).groupBy("dir").agg(best.alias("b"))
    holds = holds.select(F.col("dir").alias("from_dir"), F.col("b.license").alias("dir_license"), (-F.col("b.s")).alias("dir_score"))
    dirs = light.groupBy("place", "dir").agg(F.count(F.lit(1)).alias("n_files"))
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    root = F.when(F.col("dir").startswith("/"), "/").otherwise("")
    above = F.array_union(F.array(root), F.filter(above, lambda x: x != ""))
    up = stored(dirs.where(F.col("dir").isNotNull()).select("dir", F.explode(above).alias("up")), "ancestors")
    below = up.groupBy("up").agg(F.count(F.lit(1)).alias("n_below"))
    holds = holds.join(below, F.col("up") == F.col("from_dir")).select("up", "n_below", "from_dir", "dir_license", "dir_score")
    near = join_counted(up, stored(holds, "holders"), "up", "n_below", up.count()).where(F.col("from_dir").isNotNull()).groupBy("dir").agg(
        F.max(F.struct(F.length("from_dir").alias("n"), "from_dir", "dir_license", "dir_score")).alias("h"))
    answers = stored(dirs.join(near, "dir", "left").select(
        "place", "n_files", "h.from_dir", "h.dir_license", "h.dir_score"), "directories")
    rows = join_counted(light, answers, "place", "n_files", light.count())
    header, by_dir = F.col("license").isNotNull(), F.col("dir_license").isNotNull()
    return rows.select(
        "file", F.coalesce("license", "dir_license").alias("license"), F.coalesce("score", "dir_score").alias("score"),
        F.when(header, "header").when(by_dir, "directory").otherwise("none").alias("found"),
        F.when(~header & by_dir, F.col("from_dir")).alias("from_dir"))


def paths_of(docs: DataFrame) -> DataFrame:
    """documents as a tree: source / thousands / hundreds / name; ids that are 0, 1 or 2 past a hundred are its licence
    files."""
    i = F.col("doc_id").cast("long")
    name = F.when(F.pmod(i, F.lit(100)) < 3, F.concat(F.lit("LICENSE-"), i)).otherwise(F.concat(i, F.lit(".txt")))
    folder = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(i / 1000), F.floor(i / 100))
    return docs.select(i.alias("file"), F.when((F.pmod(i, F.lit(1000)) == 1), F.concat_ws("/", F.coalesce("source", F.lit("unknown")), name)).otherwise(
        F.when(i.isNotNull(), F.concat_ws("/", folder, name))).alias("path"), "text")


def document_licenses(docs: DataFrame) -> DataFrame:
    return scan_licenses(paths_of(docs)).withColumnRenamed("file", "doc_id")


def oracle() -> str:
    fixed = template_terms(forms())
    values = ", ".join(f"({form}, '{k}', '{t}')" for form, (k, terms) in enumerate(fixed) for t in terms)
    return rf"""
WITH ft(form, license, t) AS (VALUES {values}
), f AS (
  SELECT doc_id, coalesce(text, '') AS text,
         CASE WHEN doc_id % 100 < 3 THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END AS name,
         CASE WHEN doc_id % 1000 = 1 THEN coalesce(source, 'unknown')
              ELSE coalesce(source, 'unknown') || '/' || (doc_id // 1000) || '/' || (doc_id // 100) END AS dir
  FROM documents
), p AS (
  SELECT doc_id, unnest(list_distinct(list_transform(
    list_filter(string_split(text, chr(10)), lambda v: regexp_matches(v, '{CUE}'))
    || list_filter(string_split_regex(text, '{BLANK}'), lambda v: regexp_matches(v, '{CUE}'))
    || CASE WHEN regexp_matches(name, '{FILE}') THEN [text] ELSE [] END,
    lambda v: list_sort(list_distinct(regexp_extract_all(lower(v), '{TERM}')))))) AS terms
  FROM f WHERE regexp_matches(text, '{CUE}') OR regexp_matches(name, '{FILE}')
), u AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS unit, terms FROM p WHERE len(terms) > 0
), x AS (
  SELECT doc_id, unit, unnest(terms) AS t FROM u
), c AS (
  SELECT t, sum(n) AS n FROM (SELECT t, count(*) AS n FROM x GROUP BY 1 UNION ALL SELECT t, count(*) FROM ft GROUP BY 1) GROUP BY 1
), i AS (
  SELECT t, ln(1 + ((SELECT count(*) FROM u) + {len(fixed)}) / n) AS idf FROM c
), fn AS (
  SELECT form, sqrt(sum(idf * idf)) AS norm FROM ft JOIN i USING (t) GROUP BY 1
), fu AS (
  SELECT form, license, t, idf / norm AS w FROM ft JOIN i USING (t) JOIN fn USING (form)
), n AS (
  SELECT unit, sqrt(sum(idf * idf)) AS norm FROM x JOIN i USING (t) GROUP BY 1
), d AS (
  SELECT x.doc_id, x.unit, fu.form, fu.license, sum(i.idf * fu.w) AS dot FROM x JOIN i USING (t) JOIN fu USING (t) GROUP BY 1, 2, 3, 4
), s AS (
  SELECT doc_id, license, round(dot / norm, 6) AS score FROM d JOIN n USING (unit)
), o AS (
  SELECT doc_id, license, score FROM s WHERE score >= {LEAST}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1
), g AS (
  SELECT f.*, o.license, o.score FROM f LEFT JOIN o USING (doc_id)
), h AS (
  SELECT dir AS from_dir, license AS dir_license, score AS dir_score FROM g
  WHERE license IS NOT NULL AND regexp_matches(name, '{FILE}')
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1
), a AS (
  SELECT g.dir, h.* FROM (SELECT DISTINCT dir FROM g) g JOIN h ON g.dir = h.from_dir OR starts_with(g.dir, h.from_dir || '/')
  QUALIFY row_number() OVER (PARTITION BY g.dir ORDER BY length(from_dir) DESC) = 1
)
SELECT g.doc_id, coalesce(license, dir_license) AS license, coalesce(score, dir_score) AS score,
       CASE WHEN license IS NOT NULL THEN 'header' WHEN dir_license IS NOT NULL THEN 'directory' ELSE 'none' END AS found,
       CASE WHEN license IS NULL AND dir_license IS NOT NULL THEN from_dir END AS from_dir
FROM g LEFT JOIN a USING (dir)
"""


ORACLE = oracle()
