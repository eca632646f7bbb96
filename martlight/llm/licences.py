"""Licence scans: TF-IDF cosine of headers and licence files to templates, inheritance along directories.

Every line of every file is a possible header, and so are up to ``WINDOW`` adjacent lines and the sentences of its
paragraphs.  They are compared with all templates as sparse vectors of terms, weighed by how many of the files hold them;
a file declares the licence of its best one.  Files named or declared as licences are also compared as a whole with whole
licence texts, which then decide.  A licence file, by its name, because half of its lines are licence text or because it
is a whole one, gives its licence to its directory, and files without a licence of their own take that of the nearest
directory above.

DataFrame functions only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martlight.llm.base import columns_of, join_rates, table
from martlight.llm.licence_texts import TEXTS
from martlight.session import stable

# Licences by their SPDX name, with the words files state them in.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "This code is licensed under the BSD 2-Clause Simplified License."),
    ("BSD-3-Clause", "This code is licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
_PUBLISHED = "as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} License " + _PUBLISHED
_IDENTIFIERS = (
    ("AGPL-3.0", "AGPL-3.0-only AGPL-3.0-or-later"), ("Apache-2.0", "Apache-2.0"), ("BSD-2-Clause", "BSD-2-Clause"),
    ("BSD-3-Clause", "BSD-3-Clause"), ("CC-BY-4.0", "CC-BY-4.0"), ("CC-BY-NC-4.0", "CC-BY-NC-4.0"),
    ("CC-BY-NC-SA-4.0", "CC-BY-NC-SA-4.0"), ("CC-BY-ND-4.0", "CC-BY-ND-4.0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"),
    ("CC0-1.0", "CC0-1.0"), ("GPL-2.0", "GPL-2.0 GPL-2.0-only GPL-2.0-or-later"), ("GPL-3.0", "GPL-3.0 GPL-3.0-only GPL-3.0-or-later"),
    ("ISC", "ISC"), ("LGPL-2.1", "LGPL-2.1-only LGPL-2.1-or-later"), ("LGPL-3.0", "LGPL-3.0-only LGPL-3.0-or-later"),
    ("MIT", "MIT"), ("MPL-2.0", "MPL-2.0"), ("Unlicense", "Unlicense"),
)
#: Standard notices, headings and identifiers, compared with windows and sentences besides the templates.
NOTICES = TEMPLATES + (
    ("AGPL-3.0", _GNU.format("Affero General Public", 3)),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Apache License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("GPL-2.0", _GNU.format("General Public", 2)),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", _GNU.format("General Public", 3)),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "GNU General Public License"),
    ("ISC", "ISC License"),
    ("LGPL-2.1", _GNU.format("Lesser General Public", "2.1")),
    ("LGPL-3.0", _GNU.format("Lesser General Public", 3)),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MIT", "MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
) + tuple((name, f"SPDX-License-Identifier: {i}") for name, ids in _IDENTIFIERS for i in ids.split())
#: Adjacent lines compared together.
WINDOW = 5
#: Comment marks at the begin of a line, the space between paragraphs, and the ends of sentences.
MARK = r"(?m)^[ \t]*(?://+|/\*+|\*+/?|#+|;+|--+|%+|<!--)?[ \t]*"
PARAGRAPH = r"\r?\n(?:[ \t]*\r?\n)+"
SENTENCE = r"(?<=[.!?])\s+(?=[\"(\[]?[A-Z])|(?<=;)\s+"
#: Cosine from which a whole file is a whole licence text.
LEAST_FILE = 0.8
#: Cosine from which a line states a template's licence.
LEAST = 0.7
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([._-].*)?$"
TERM = "[a-z0-9]+"


#: Terms of every template with their counts.
COUNTS = [Counter(re.findall(TERM, text.lower())) for _, text in TEMPLATES]
VOCABULARY = sorted({t for c in COUNTS for t in c})
NOTICE_COUNTS = [Counter(re.findall(TERM, text.lower())) for _, text in NOTICES]
TEXT_COUNTS = [Counter({t: int(n) for t, n in (x.split(":") for x in terms.split())}) for _, terms in TEXTS]
ALL_TERMS = sorted({t for c in (*NOTICE_COUNTS, *TEXT_COUNTS) for t in c})


@dataclass(frozen=True)
class Weights:
    """Inverse document frequencies of the templates' terms, that of any other term (their mean), and the templates as
    unit vectors."""

    idf: dict[str, float]
    other: float
    units: list[dict[str, float]]

    @classmethod
    def of(cls, n_files: int, found: dict[str, int], templates: list[Counter] = COUNTS) -> Weights:
        idf = {t: math.log((1 + n_files) / (1 + found.get(t, 0))) + 1 for t in sorted({t for c in templates for t in c})}
        units = []
        for c in templates:
            norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
            units.append({t: n * idf[t] / norm for t, n in sorted(c.items())})
        return cls(idf, sum(idf.values()) / len(idf), units)

    def cues(self) -> list[str]:
        """Terms of which a line needs one to come near any template, the rarest in the files.

        By the Cauchy-Schwarz inequality a line with none of them has at most the length of what the template keeps
        without them as its cosine; terms are added until that is under ``LEAST`` for every template.  Nothing is lost.
        """
        cues: set[str] = set()
        for unit in self.units:
            for term in sorted(unit, key=lambda t: (-self.idf[t], t)):
                if math.sqrt(sum(w * w for t, w in unit.items() if t not in cues)) < LEAST - 0.01:
                    break
                cues.add(term)
        return sorted(cues)

    def cue_pattern(self) -> str:
        return any_of(self.cues())


def any_of(terms: Iterable[str]) -> str:
    return r"(?<![a-z0-9])(?:" + "|".join(sorted(terms)) + r")(?![a-z0-9])"


def _held(files: DataFrame) -> tuple[int, dict[str, int]]:
    """Count the files, and those that hold each of the templates' terms; a thousand counts reach the driver."""
    words = F.split(F.lower("text"), "[^a-z0-9]+")
    held = F.explode(F.array_intersect(words, F.array(*(F.lit(t) for t in ALL_TERMS))))
    counts = files.select(held.alias("term")).groupBy("term").count().collect()
    return files.count(), {r["term"]: r["count"] for r in counts}


def weigh(files: DataFrame) -> Weights:
    return Weights.of(*_held(files))


def _known_terms(spark: SparkSession, weights: Weights) -> DataFrame:
    """``term, idf, templates``: a row for each of the templates' terms, with its weight in each of them."""
    held: dict[str, list] = {t: [] for t in weights.idf}
    for i, unit in enumerate(weights.units):
        for t, w in unit.items():
            held[t].append((i, weights.idf[t] * w))
    schema = "term string, idf double, templates array<struct<template: int, value: double>>"
    return spark.createDataFrame([(t, idf, held[t]) for t, idf in weights.idf.items()], schema)


def _near(units: DataFrame, weights: Weights, least: float) -> DataFrame:
    """``id, path, line_no, template, cosine`` of the ``units`` (id, path, line_no, line) near a template.

    Units are exchanged once, by their key; terms are counted and summed where they lie.  The squared norm is summed
    beside the products with the templates, as that of number -1.
    """
    key = ["id", "path", "line_no"]
    terms = units.repartition(*key).select(*key, F.explode(F.regexp_extract_all(F.lower("line"), F.lit(TERM), 0)).alias("term"))
    counted = terms.groupBy(*key, "term").agg(F.count("*").cast("double").alias("n"))
    # The templates' terms are about a thousand rows whatever the files.
    known = counted.join(F.broadcast(_known_terms(units.sparkSession, weights)), "term", "left")
    square = F.pow(F.col("n") * F.coalesce("idf", F.lit(weights.other)), 2.0)
    products = F.transform(
        F.coalesce("templates", F.expr("array()")), lambda t: F.struct(t["template"].alias("template"), (F.col("n") * t["value"]).alias("value"))
    )
    parts = F.concat(F.array(F.struct(F.lit(-1).alias("template"), square.alias("value"))), products)
    sums = known.select(*key, F.explode(parts).alias("part")).groupBy(*key, "part.template").agg(F.sum("part.value").alias("value"))
    of_unit = sums.groupBy(*key).agg(
        F.sqrt(F.max(F.when(F.col("template") < 0, F.col("value")))).alias("norm"),
        F.collect_list(F.when(F.col("template") >= 0, F.struct("template", "value"))).alias("dots"),  # one for each template
    )
    each = of_unit.select(*key, "norm", F.explode("dots").alias("dot"))
    return each.select(*key, "dot.template", F.round(F.col("dot.value") / F.col("norm"), 6).alias("cosine")).where(F.col("cosine") >= least)


def headers(files: DataFrame, weights: Weights) -> DataFrame:
    """``id, path, line_no, template, cosine`` of the lines of ``files`` (id, path, text) near a template."""
    cue = weights.cue_pattern()
    lines = (
        files.where(F.lower("text").rlike(cue))
        .select("id", "path", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .where(F.lower("line").rlike(cue))
        .distinct()
    )
    return _near(lines, weights, LEAST)


def notices(files: DataFrame, weights: Weights) -> DataFrame:
    """As :func:`headers`, of windows of adjacent lines and of sentences near a notice; ``line_no`` is a hash."""
    cue = weights.cue_pattern()
    bare = F.regexp_replace("text", MARK, "")
    lines = F.filter(F.split(bare, "\n"), lambda x: F.trim(x) != "")
    sentences = F.flatten(
        F.transform(F.split(bare, PARAGRAPH), lambda p: F.split(F.regexp_replace(p, r"\s+", " "), SENTENCE))
    )
    windows = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(WINDOW)),
            lambda w: F.transform(
                F.filter(F.sequence(F.lit(1), F.greatest(F.size("lines"), F.lit(1))), lambda i: i + w - 1 <= F.size("lines")),
                lambda i: F.array_join(F.slice("lines", i, w), " "),
            ),
        )
    )
    units = (
        files.where(F.lower("text").rlike(cue))
        .select("id", "path", lines.alias("lines"), sentences.alias("sentences"))
        .select("id", "path", F.explode(F.concat(windows, "sentences")).alias("line"))
        .where(F.lower("line").rlike(cue))
        .withColumn("line_no", F.xxhash64("line"))
        .distinct()
    )
    return _near(units, weights, LEAST)


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan_licences(files: DataFrame, *, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``doc_id, path, licence, origin, score, from_dir``: one row per row of ``files``.

    ``origin`` is ``declared`` (``score`` is the cosine), ``inherited`` (``from_dir`` is the directory it comes from) or
    ``none``.  Of several licences in a file or directory the higher cosine wins, then the name first in order.  Null
    texts state nothing, a null path has no directory, and the top directory is the empty path.  Rows with one id and
    path are one file; of its texts, those without any term that a licence needs are passed over.  Directories find their nearest licence before files meet them, so that deep or full directories
    repeat no file; a directory that holds a third of the files is joined by :func:`join_rates`.
    """
    own = columns_of(files, {"id": id_col, "path": path_col, "text": text_col})
    held = _held(own)
    weights = Weights.of(*held)

    def named(near: DataFrame, templates: tuple, kind: int) -> DataFrame:
        names = F.array(*(F.lit(n) for n, _ in templates))
        return near.withColumn("licence", F.element_at(names, F.col("template") + 1)).withColumn("kind", F.lit(kind))

    # Texts with a term that a line, window or sentence needs are written once; the others are never exchanged.
    by_notice = Weights.of(*held, NOTICE_COUNTS)
    is_file = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE), F.lit(False))
    cued = stable(
        own.withColumn("is_file", is_file).where(F.col("is_file") | F.lower("text").rlike(any_of({*weights.cues(), *by_notice.cues()})))
    )
    # Kind 1: lines, 0: windows and sentences, 2: whole files, which decide where there are any.
    parts = named(headers(cued, weights), TEMPLATES, 1).unionByName(named(notices(cued, by_notice), NOTICES, 0))
    parts = stable(parts)
    marked = parts.select(F.col("id").alias("_id"), F.col("path").alias("_path")).distinct()
    some = cued.join(marked, F.col("id").eqNullSafe(F.col("_id")) & F.col("path").eqNullSafe(F.col("_path")), "left_semi")
    some = some.unionByName(cued.where("is_file")).select("id", "path", "text").distinct()
    whole = _near(some.withColumn("line_no", F.lit(0)).withColumnRenamed("text", "line"), Weights.of(*held, TEXT_COUNTS), LEAST_FILE)
    near = parts.unionByName(named(whole, TEXTS, 2))
    best = F.struct(F.col("kind") == 2, "cosine", "kind", -F.col("template"))
    stated = stable(
        near.groupBy("id", "path").agg(
            F.max_by("licence", best).alias("licence"),
            F.max_by("cosine", best).alias("score"),
            F.countDistinct(F.when(F.col("kind") == 1, F.col("line_no"))).alias("hits"),
            F.max(F.col("kind") == 2).alias("is_text"),
        )
    )
    sizes = some.select(
        "id", "path", F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("n_lines")
    ).groupBy("id", "path").agg(F.max("n_lines").alias("n_lines"))
    same = F.col("s.id").eqNullSafe(F.col("z.id")) & F.col("s.path").eqNullSafe(F.col("z.path"))
    licence_files = (
        stated.alias("s").join(sizes.alias("z"), same)
        .where(F.element_at(F.split("s.path", "/"), -1).rlike(LICENCE_FILE) | F.col("is_text") | (2 * F.col("hits") >= F.col("n_lines")))
        .select(_directory(F.col("s.path")).alias("dir"), "licence", "score")
    )
    first = Window.partitionBy("dir").orderBy(F.desc("score"), "licence")
    given = licence_files.where("dir is not null").withColumn("_n", F.row_number().over(first)).where("_n = 1").select("dir", "licence")
    dirs = own.select(_directory(F.col("path")).alias("dir")).where("dir is not null").distinct()
    parts = F.split("dir", "/")
    above = dirs.select(
        "dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("depth", "up")
    )
    found = above.join(given.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(
        F.max_by(F.struct("licence", F.col("up").alias("from_dir")), "depth").alias("given")
    )
    found = stable(found.select(F.col("dir").alias("_dir"), "given"))
    rows = own.select("id", "path").withColumn("_dir", _directory(F.col("path")))
    rows = join_rates(rows, found, "_dir", found.count(), how="left").select("id", "path", "given")
    marks = stated.select(F.col("id").alias("_id"), F.col("path").alias("_path"), "licence", "score")
    joined = rows.join(marks, F.col("id").eqNullSafe(F.col("_id")) & F.col("path").eqNullSafe(F.col("_path")), "left")
    return joined.select(
        F.col("id").alias("doc_id"),
        "path",
        F.coalesce("licence", F.col("given.licence")).alias("licence"),
        F.when(F.col("licence").isNotNull(), "declared").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("origin"),
        "score",
        F.when(F.col("licence").isNull(), F.col("given.from_dir")).alias("from_dir"),
    )


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their source: ``source / thousand / ten / doc_id``."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.expr("doc_id div 1000"), F.expr("doc_id div 10"), "doc_id")
    return scan_licences(docs.select("doc_id", "text", path.alias("path")))


def _oracle() -> str:
    counts = ", ".join(f"({i}, '{t}', {n})" for i, c in enumerate(COUNTS) for t, n in sorted(c.items()))
    names = ", ".join(f"({i}, '{n}')" for i, (n, _) in enumerate(TEMPLATES))
    return f"""
    WITH templates(template, term, n) AS (VALUES {counts}), names(template, licence) AS (VALUES {names}),
    held AS (
        SELECT term, count(*) AS files FROM (
            SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM documents)
        GROUP BY 1
    ), idf AS (
        SELECT term, ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + coalesce(files, 0))) + 1 AS idf
        FROM (SELECT DISTINCT term FROM templates) LEFT JOIN held USING (term)
    ), weights AS (
        SELECT template, term, idf * n * idf / sqrt(sum(pow(n * idf, 2)) OVER (PARTITION BY template)) AS weight
        FROM templates JOIN idf USING (term)
    ), files AS (
        SELECT doc_id, text, concat_ws('/', coalesce(source, 'unknown'), doc_id // 1000, doc_id // 10, doc_id) AS path FROM documents
    ), lines AS (
        SELECT doc_id, path, unnest(string_split(text, chr(10))) AS line,
            generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM files
    ), terms AS (
        SELECT doc_id, path, line_no, unnest(regexp_extract_all(lower(line), '{TERM}')) AS term FROM lines
    ), counted AS (
        SELECT doc_id, path, line_no, term, count(*)::DOUBLE AS n FROM terms GROUP BY ALL
    ), norms AS (
        SELECT doc_id, path, line_no, sqrt(sum(pow(n * coalesce(idf, (SELECT avg(idf) FROM idf)), 2))) AS norm
        FROM counted LEFT JOIN idf USING (term) GROUP BY ALL
    ), dots AS (
        SELECT doc_id, path, line_no, template, sum(n * weight) AS dot FROM counted JOIN weights USING (term) GROUP BY ALL
    ), near AS (
        SELECT doc_id, path, line_no, template, licence, round(dot / norm, 6) AS cosine
        FROM dots JOIN norms USING (doc_id, path, line_no) JOIN names USING (template) WHERE round(dot / norm, 6) >= {LEAST}
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, template) AS place,
            count(DISTINCT line_no) OVER (PARTITION BY doc_id) AS hits FROM near
    ), stated AS (
        SELECT doc_id, path, licence, cosine AS score, hits,
            (SELECT count(*) FROM lines l WHERE l.doc_id = r.doc_id AND trim(l.line) <> '') AS n_lines
        FROM ranked r WHERE place = 1
    ), given AS (
        SELECT regexp_replace(path, '/[^/]*$', '') AS dir, licence, score,
            row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY score DESC, licence) AS place
        FROM stated WHERE 2 * hits >= n_lines
    ), inherited AS (
        SELECT f.doc_id, g.licence, g.dir,
            row_number() OVER (PARTITION BY f.doc_id ORDER BY length(g.dir) DESC) AS place
        FROM files f JOIN given g ON g.place = 1 AND starts_with(f.path, g.dir || '/')
    )
    SELECT f.doc_id, f.path, coalesce(s.licence, i.licence) AS licence,
        CASE WHEN s.licence IS NOT NULL THEN 'declared' WHEN i.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
        s.score, CASE WHEN s.licence IS NULL THEN i.dir END AS from_dir
    FROM files f LEFT JOIN stated s USING (doc_id) LEFT JOIN inherited i ON i.doc_id = f.doc_id AND i.place = 1"""


QUERIES = {"op7_licence_scan": op7_licence_scan}
SQL = {"op7_licence_scan": _oracle()}
