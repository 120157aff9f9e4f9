"""License scans: sparse TF-IDF cosine of notices to templates, then inheritance by path joins.

A notice is a line, or a block of several lines between blank ones, that has one of the CUES words.
Notices and templates are vectors of term counts times inverse document frequency, counted over all
texts; a notice has the licence of the template of greatest cosine, where that is at least
THRESHOLD. A unit with an SPDX tag has the first identifier of the tag that the table knows, or none.
A text that is a licence's own text, by cosine to the full texts in `licences`, has that licence,
whatever its notices; other files have the licence of their best notice. A folder has that of its licence files (named
as LICENSE_NAMES says; the best, then the first path). Files without a licence of their own inherit
that of the nearest folder on their path.

Defined results: null and empty texts have no notices; a null path is in no folder; rows are keyed
by path, id and text, so repeated rows get equal results; ties go to the first template, then the
first path; an empty table gives an empty result; further columns are ignored. Texts are read whole.
A whole text counts as a notice. Identifiers ending in -only, -or-later or + stand under the table's
name, and a GNU title without a version under none. SQL states TEMPLATES and their cosines alone, so
it equals the query where no text has a tag, a title or a notice of MORE, or is a licence's own text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import documents, row_key, stored
from fieldloom.llm.decontaminate import SEPARATORS, normal_words

THRESHOLD = 0.6
#: The least cosine of a text to a licence's full text, as a part of all its words.
WHOLE_THRESHOLD = 0.9
CUES = ("license", "licence", "licensed", "copyright", "copyleft", "warranty", "redistribution", "permission", "spdx", "domain", "rights")
#: A cheap test for any of CUES.
CUE_GATE = "(?i)licen[sc]e|copy(?:right|left)|warranty|redistribution|permission|spdx|domain|rights"
LICENSE_NAMES = "(?i)^(?:license|licence|copying|copyright|unlicense|notice)(?:[.-].*)?$"
#: Folder tables are broadcast up to this many rows (a hundred bytes each).
BROADCAST_ROWS = 20_000

# Customary wordings of licence notices, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to this software to the public domain worldwide. CC0 1.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# Titles of licence files and further notices. Those without an identifier leave it open.
MORE = (
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Apache License"),
    ("Apache-2.0", "Apache License Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", 'The 2-Clause BSD License, "Simplified BSD License" or "FreeBSD License"'),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", 'The 3-Clause BSD License, "New BSD License" or "Modified BSD License"'),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
    (None, "GNU GENERAL PUBLIC LICENSE"),
    (None, "GNU LESSER GENERAL PUBLIC LICENSE"),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("MPL-1.1", "Mozilla Public License Version 1.1"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "ISC License"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "The Unlicense"),
)
NAMES = sorted({name for name, _ in TEMPLATES + MORE if name})
#: SPDX identifiers, in lower case, and the table's names for them.
SPDX = {f"{n}{end}".lower(): n for n in NAMES for end in (("", "-only", "-or-later", "+") if "GPL" in n else ("",))}
# Texts that stand for one that `licences` lacks: they differ from it in some clauses, and have the words of its name.
DERIVED = {
    "AGPL-3.0": ("GPL-3.0", (("GNU General Public License", "GNU Affero General Public License"), ("GNU GENERAL", "GNU AFFERO GENERAL"), ("GNU GPL", "GNU AGPL"))),
    "CC-BY-4.0": ("CC-BY-SA-4.0", (("Attribution-ShareAlike", "Attribution"), ("ShareAlike", ""))),
    "CC-BY-NC-4.0": ("CC-BY-SA-4.0", (("ShareAlike", "NonCommercial"),)),
}


def whole_texts() -> tuple[list[tuple[str, str, float]], list[tuple[str, float]], float]:
    """(licence, term, weight) of the full texts, (term, idf) among them, and the idf of any other term."""
    texts = {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licences").glob("*.txt"))}
    for name, (base, changes) in DERIVED.items():
        text = " ".join(texts[base].split())
        for a, b in changes:
            text = text.replace(a, b)
        texts[name] = text
    counted = {name: Counter(w for w in re.split(SEPARATORS, text.lower()) if w) for name, text in texts.items()}
    total, df = len(counted), Counter(w for c in counted.values() for w in c)
    idf = {w: math.log((1 + total) / (1 + n)) + 1 for w, n in df.items()}
    rows = []
    for name, c in sorted(counted.items()):
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
        rows += [(name, w, n * idf[w] / norm) for w, n in sorted(c.items())]
    return rows, sorted(idf.items()), math.log(1 + total) + 1


def whole_matches(files: DataFrame) -> DataFrame:
    """(k, licence, score) of the files (k, text) that are a licence's own text."""
    spark = files.sparkSession
    rows, idf, other = whole_texts()
    vectors, weights = spark.createDataFrame(rows, "licence string, term string, w double"), spark.createDataFrame(idf, "term string, idf double")
    words = files.where(F.col("text").rlike(CUE_GATE)).dropDuplicates(["k"]).select("k", F.explode(normal_words(F.col("text"))).alias("term"))
    terms = words.groupBy("k", "term").agg(F.count("*").alias("tf")).join(F.broadcast(weights), "term", "left")
    terms = terms.select("k", "term", (F.col("tf") * F.coalesce("idf", F.lit(other))).alias("v"), F.col("idf").isNotNull().alias("known"))
    norms = terms.groupBy("k").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dots = terms.where("known").join(F.broadcast(vectors), "term").groupBy("k", "licence").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    near = dots.join(norms, "k").select("k", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= WHOLE_THRESHOLD)
    return near.groupBy("k").agg(F.min_by("licence", F.struct(-F.col("score"), "licence")).alias("licence"), F.max("score").alias("score"))


def tagged(text: Column) -> Column:
    """The licence of a unit's SPDX tag: null without a tag, empty where the table knows none of its identifiers."""
    said = F.regexp_extract(text, "(?i)SPDX-License-Identifier:([^\\n]*)", 1)
    names = F.create_map(*[F.lit(x) for pair in sorted(SPDX.items()) for x in pair])
    known = F.array_compact(F.transform(F.split(F.lower(said), "[^a-z0-9.+-]+"), lambda x: F.element_at(names, F.regexp_replace(x, "[.]+$", ""))))
    return F.when(text.rlike("(?i)SPDX-License-Identifier:"), F.coalesce(F.get(known, 0), F.lit("")))


def templates(spark: SparkSession, table: tuple = TEMPLATES) -> DataFrame:
    """(t, licence, term, tf): a table of templates as term counts."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(table)], "t int, licence string, text string")
    return rows.select("t", "licence", F.explode_outer(normal_words(F.col("text"))).alias("term")).groupBy("t", "licence", "term").agg(F.count("*").alias("tf"))


def term_weights(texts: DataFrame, own: DataFrame, total: int) -> tuple[DataFrame, Column]:
    """(term, idf) of the templates' terms over all texts, and the idf of any other term."""
    vocabulary = sorted(r.term for r in own.select("term").distinct().collect())  # the templates are fixed
    present = F.array_intersect(normal_words(F.col("text")), F.array(*map(F.lit, vocabulary)))
    counted = texts.select(present.alias("terms")).select(F.explode_outer("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    found = {r.term: r.df for r in counted.collect()}  # at most one row for each term of the vocabulary
    spark = texts.sparkSession
    rows = spark.createDataFrame([(w, found.get(w, 0)) for w in vocabulary], "term string, df long")
    idf = lambda df: F.log((F.lit(1.0) + total) / (F.lit(1.0) + df)) + 1
    return rows.select("term", idf(F.col("df")).alias("idf")), idf(F.lit(0))


def has_cue(words: Column) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, CUES)))


def notices(files: DataFrame) -> DataFrame:
    """(k, unit, words, tag): the notices of all files (k, text)."""
    gated = files.where(F.col("text").rlike(CUE_GATE))
    lines, blocks = F.split("text", "\n"), F.filter(F.split("text", "\n[\\x20\\x09-\\x0D]*\n"), lambda b: F.contains(b, F.lit("\n")))
    units = F.filter(F.concat(lines, blocks), lambda x: x.rlike(CUE_GATE))
    split = gated.select("k", F.posexplode_outer(units).alias("unit", "x")).select("k", "unit", normal_words(F.col("x")).alias("words"), tagged(F.col("x")).alias("tag"))
    return split.where(has_cue(F.col("words"))).dropDuplicates(["k", "unit"])


def scored(files: DataFrame, total: int) -> DataFrame:
    """(k, n_notices, licence, score) of files with a recognised notice, of `total` files."""
    own = templates(files.sparkSession, TEMPLATES + MORE)
    idf, other = term_weights(files, own, total)
    vectors = own.join(F.broadcast(idf), "term").withColumn("v", F.col("tf") * F.col("idf"))
    norms = vectors.groupBy("t").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    vectors = vectors.join(F.broadcast(norms), "t").select("t", "licence", "term", (F.col("v") / F.col("norm")).alias("w"))

    said = stored(notices(files), "notices")
    terms = said.where("tag IS NULL").select("k", "unit", F.explode_outer("words").alias("term")).groupBy("k", "unit", "term").agg(F.count("*").alias("tf"))
    terms = terms.join(F.broadcast(idf), "term", "left").withColumn("v", F.col("tf") * F.coalesce("idf", other))
    units = terms.groupBy("k", "unit").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), F.array_compact(F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "v")))).alias("known"))
    dots = units.select("k", "unit", "norm", F.explode_outer("known").alias("x")).select("k", "unit", "norm", "x.*").join(F.broadcast(vectors), "term")
    cosines = dots.groupBy("k", "unit", "norm", "t", "licence").agg((F.sum(F.col("v") * F.col("w"))).alias("dot"))
    cosines = cosines.withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= THRESHOLD)
    best = lambda *key: F.max_by(F.struct("licence", "score"), F.struct("score", *[-F.col(c) for c in key]))
    per_unit = cosines.groupBy("k", "unit").agg(best("t").alias("b")).select("k", "unit", "b.*")
    tags = said.where("tag <> ''").select("k", "unit", F.col("tag").alias("licence"), F.lit(1.0).alias("score"))
    # A score of 2 more puts the whole text before any notice.
    texts = whole_matches(files).select("k", F.lit(-1).alias("unit"), "licence", (F.col("score") + 2).alias("score"))
    found = per_unit.where("licence IS NOT NULL").unionByName(tags).unionByName(texts)
    found = found.groupBy("k").agg(F.count("*").alias("n_notices"), best("unit").alias("b")).select("k", "n_notices", "b.*")
    return found.withColumn("score", F.when(F.col("score") > 2, F.round(F.col("score") - 2, 6)).otherwise(F.col("score")))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def scan(files: DataFrame) -> DataFrame:
    """doc_id, path, n_notices, own_licence, score, licence and licence_dir (where it comes from, for inherited ones) for each row of files (doc_id, path, text)."""
    rows = files.select("doc_id", "path", F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumn("k", row_key(F.col("doc_id"), F.col("path"), F.col("text")))
    parts = F.split("path", "/")
    # All that is needed of a file beside its text, so that texts are read for their notices and terms alone.
    heads = stored(keyed.select("k", "doc_id", "path", F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/").alias("dir"), F.element_at(parts, -1).rlike(LICENSE_NAMES).alias("names")), "heads")
    found = stored(scored(keyed.select("k", "text"), heads.count()), "licences")
    own = heads.join(found, "k", "left")

    lone = own.where(F.col("names") & F.col("licence").isNotNull() & F.col("path").isNotNull())
    folders = lone.groupBy("dir").agg(F.min_by("licence", F.struct(-F.col("score"), F.col("path"), F.col("licence"))).alias("licence"))
    folders = stored(folders, "folders")
    # Each different folder looks up its ancestors, itself first; the nearest one wins.
    dirs = heads.where("path IS NOT NULL").select("dir").distinct()
    steps = F.split("dir", "/")
    up = dirs.select("dir", F.explode_outer(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))).alias("above"), F.size(steps).alias("depth")).distinct()
    hit = up.join(_small(folders.withColumnsRenamed({"dir": "above", "licence": "theirs"})), "above")
    nearest = hit.groupBy("dir").agg(F.max_by(F.struct("theirs", F.col("above").alias("licence_dir")), F.length("above")).alias("n")).select(F.col("dir").alias("_d"), "n.*")
    nearest = stored(nearest, "nearest")
    out = own.join(_small(nearest), own["dir"] == F.col("_d"), "left")
    return out.select(
        "doc_id",
        "path",
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
        F.col("licence").alias("own_licence"),
        "score",
        F.coalesce("licence", "theirs").alias("licence"),
        F.when(F.col("licence").isNull(), F.col("licence_dir")).alias("licence_dir"),
    )


def with_paths(docs: DataFrame) -> DataFrame:
    """Documents in an invented layout: source/lang for texts of under 500 characters, a folder for each hundred ids below
    for longer ones; a text whose last line has a cue stands as LICENSE.<id>, since the table has no paths of its own."""
    last = F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), -1)
    folder = F.when(F.length("text") >= 500, F.concat(F.lit("/"), F.floor(F.col("doc_id") / 100).cast("string"))).otherwise("")
    name = F.concat(F.when(last.rlike(CUE_GATE), "LICENSE.").otherwise("d"), F.coalesce(F.col("doc_id").cast("string"), F.lit("_")))
    path = F.concat(F.coalesce("source", F.lit("_")), F.lit("/"), F.coalesce("lang", F.lit("_")), F.coalesce(folder, F.lit("")), F.lit("/"), name)
    return docs.select("doc_id", path.alias("path"), "text")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(with_paths(documents(spark, sf_dir)))
    return out.withColumn("score", F.round(1000 * F.col("score")).cast("long"))


_WORDS = "list_filter(regexp_split_to_array(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_GATE = CUE_GATE
_VALUES = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '_') || '/' || coalesce(lang, '_') ||
    CASE WHEN length(text) >= 500 THEN coalesce('/' || (doc_id // 100)::VARCHAR, '') ELSE '' END AS dir,
    regexp_matches(string_split(coalesce(text, ''), chr(10))[-1], '{_GATE}') AS names FROM documents
), f AS (SELECT row_number() OVER () AS k, doc_id, text, dir, names, dir || '/' || CASE WHEN names THEN 'LICENSE.' ELSE 'd' END || coalesce(doc_id::VARCHAR, '_') AS path FROM d),
tt AS (SELECT t, licence, term, count(*) AS tf FROM (SELECT t, licence, unnest({_WORDS.format("text")}) AS term FROM (VALUES {_VALUES}) AS v(t, licence, text)) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT k, unnest({_WORDS.format("text")}) AS term FROM f) WHERE term IN (SELECT term FROM tt) GROUP BY term),
n AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT DISTINCT tt.term, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + coalesce(df, 0))) + 1 AS idf FROM tt LEFT JOIN df USING (term), n),
tv AS (SELECT t, licence, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY t)) AS w FROM tt JOIN idf USING (term)),
u AS (
  SELECT k, unit, {_WORDS.format("x")} AS words FROM (SELECT k, unnest(l) AS x, unnest(range(len(l))) AS unit FROM (
    SELECT k, list_filter(list_concat(string_split(text, chr(10)), list_filter(regexp_split_to_array(text, '\\n[\\x20\\x09-\\x0D]*\\n'), lambda b: contains(b, chr(10)))), lambda x: regexp_matches(x, '{_GATE}')) AS l FROM f))
), uw AS (SELECT k, unit, term, count(*) AS tf FROM (SELECT k, unit, unnest(words) AS term FROM u WHERE list_has_any(words, [{", ".join(f"'{c}'" for c in CUES)}])) GROUP BY ALL),
uv AS (SELECT k, unit, term, tf * coalesce(idf, ln(1.0::DOUBLE + n) + 1) AS v FROM uw LEFT JOIN idf USING (term), n),
un AS (SELECT k, unit, sqrt(sum(v * v)) AS norm FROM uv GROUP BY ALL),
cs AS (SELECT k, unit, t, licence, round(sum(v * w) / any_value(norm), 6) AS score FROM uv JOIN tv USING (term) JOIN un USING (k, unit) GROUP BY ALL),
b1 AS (SELECT k, unit, licence, score FROM cs WHERE score >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY k, unit ORDER BY score DESC, t) = 1),
b2 AS (SELECT k, licence, score, count(*) OVER (PARTITION BY k) AS n_notices FROM b1 QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, unit) = 1),
own AS (SELECT f.*, n_notices, licence, score FROM f LEFT JOIN b2 USING (k)),
fold AS (SELECT dir, licence FROM own WHERE names AND licence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path, licence) = 1),
near AS (SELECT o.dir, fold.licence AS theirs, fold.dir AS licence_dir FROM (SELECT DISTINCT dir FROM own) o JOIN fold ON o.dir = fold.dir OR starts_with(o.dir, fold.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY o.dir ORDER BY length(fold.dir) DESC) = 1)
SELECT doc_id, path, coalesce(n_notices, 0)::BIGINT AS n_notices, licence AS own_licence, round(1000 * score)::BIGINT AS score,
  coalesce(licence, theirs) AS licence, CASE WHEN licence IS NULL THEN licence_dir END AS licence_dir
FROM own LEFT JOIN near USING (dir)
"""
