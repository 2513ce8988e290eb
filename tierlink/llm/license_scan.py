"""License scan in DataFrame functions alone: sparse TF-IDF cosine, then nearest-ancestor inheritance.

Lines with a license cue (headers), and whole license files, are compared with templates by the
cosine of sparse TF-IDF vectors: tf weight 1 + ln(tf), idf ln(1 + N / df) over the N templates,
ln(1 + N) for words that no template has. A file's own license is its best header of at least
``threshold``; a license file sets its folder's, the most similar one if a folder has several. A file
without one of its own takes that of the nearest folder above it, found by joining its folder's
ancestors with the folders that have one.

``scan`` also compares whole paragraphs that hold a cue (notices wrapped over lines), against wordings
of more licenses (``WORDINGS``) and full texts (``license_texts``). There version numbers and variant
words (lesser, affero, NonCommercial and so on) decide: a template with others than the notice, or
than the first lines of a license file, is no match. ``lines_only`` leaves all this out.

Only distinct cue lines are exploded into words, so copies of a header cost one comparison, and the
templates are a small fixed table (broadcast). Folders are joined once each, not once a file. Texts are
searched twice: for the distinct lists of cue lines, and for the result; files without a cue, most of
all, are spread by a salt where lists are joined.

Defined cases: null or empty texts have no own license but can inherit; a null path has no folder;
of equal similarities the smaller license id counts; repeated rows get equal results; an empty table
gives an empty result; input columns named as a result are replaced, others pass through; very long
texts are split into lines whole.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierlink.llm._columns import without
from tierlink.session import materialize

# Wordings of license notices by SPDX id.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
)
WORDINGS = (
    *(("GPL-%s.0" % v, "This %s under the %sGNU General Public License, version %s." % (x, y, v)) for v in "23" for x, y in (("work is licensed", ""), ("program is free software; you can redistribute it and/or modify it", "terms of the "))),
    *((i, "GNU %sGeneral Public License Version %s, %s" % (x, v, date)) for i, x, v, date in (("GPL-2.0", "", "2", "June 1991"), ("GPL-3.0", "", "3", "29 June 2007"), ("LGPL-2.1", "Lesser ", "2.1", "February 1999"), ("LGPL-3.0", "Lesser ", "3", "29 June 2007"), ("AGPL-3.0", "Affero ", "3", "19 November 2007"))),
    *((i, "This %s is free software: you can redistribute it and/or modify it under the terms of the GNU %sGeneral Public License as published by the Free Software Foundation, either version %s of the License, or (at your option) any later version." % (what, x, v)) for i, what, x, v in (("GPL-2.0", "program", "", "2"), ("GPL-3.0", "program", "", "3"), ("LGPL-2.1", "library", "Lesser ", "2.1"), ("LGPL-3.0", "library", "Lesser ", "3"), ("AGPL-3.0", "program", "Affero ", "3"))),
    *((i, "Licensed under the GNU %sGeneral Public License, version %s." % (x, v)) for i, x, v in (("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3"))),
    *((i, "Licensed under the %s." % x) for i, x in (("MIT", "MIT License"), ("ISC", "ISC License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("MPL-2.0", "Mozilla Public License, version 2.0"), ("Unlicense", "Unlicense"), ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"))),
    *((i + "-4.0", t % x) for i, short, x in (("CC-BY", "BY", ""), ("CC-BY-SA", "BY-SA", "-ShareAlike"), ("CC-BY-NC", "BY-NC", "-NonCommercial"), ("CC-BY-NC-SA", "BY-NC-SA", "-NonCommercial-ShareAlike"), ("CC-BY-ND", "BY-ND", "-NoDerivatives"), ("CC-BY-NC-ND", "BY-NC-ND", "-NonCommercial-NoDerivatives")) for t, x in (("Licensed under CC %s 4.0.", short), ("This work is licensed under a Creative Commons Attribution%s 4.0 International License.", x))),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
MORE_CUES = "|unlicense|public domain|permission to use, copy|\\bcc0\\b|creative commons"
PARAGRAPH = "\\n[^A-Za-z0-9\\n]*\\n"
CUE = "(?i)licen[sc]e|copyright|all rights reserved|permission is hereby granted|redistribution and use|free software"
FILE_NAME = "(?i)^(license|licence|copying|notice)([.-].*)?$"
WORD = "[a-z0-9.]*[a-z0-9]"
THRESHOLD = 0.75
LONG, HEAD = 1200, 120  # characters: of texts that are no notice, and of their titles


def sql_text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    rows = ", ".join(f"({i}, {sql_text(name)}, {sql_text(text)})" for i, (name, text) in enumerate(templates))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(template, license, text)")


def full_texts() -> tuple[tuple[str, str], ...]:
    return tuple((f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))


def deciding(text: Column) -> tuple[Column, Column]:
    """(variant words, version numbers) of a notice; those of a long text stand in its first lines."""
    x = F.lower(F.when(F.length(text) > LONG, F.substring(F.trim(text), 1, HEAD)).otherwise(text))
    for pattern, name in (("non-?commercial", "nc"), ("share-?alike", "sa"), ("no-?deriv(ative)?s?", "nd"), (r"\b(\d)\.0\b", "$1")):
        x = F.regexp_replace(x, pattern, name)
    words = F.regexp_extract_all(x, F.lit(r"\b(affero|lesser|nc|sa|nd)\b"), F.lit(1))
    return F.array_sort(F.array_distinct(words)), F.regexp_extract_all(x, F.lit(r"(?:^|[^\w.])v?([1-4](?:\.\d)?)(?![\w]|\.\d)"), F.lit(1))


def term_counts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, term, tf)."""
    words = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"({WORD})"), F.lit(1)))
    return df.select(*keys, words.alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def weight(tf: Column, idf: Column) -> Column:
    return (1 + F.ln(tf.cast("double"))) * idf


def classify(texts: DataFrame, key: str, text: str, templates: DataFrame, threshold: float = THRESHOLD, decide: bool = False) -> DataFrame:
    """(key, license, similarity): the best template of each distinct text that reaches the threshold."""
    counted = term_counts(templates.select("template", "license", "text"), ["template", "license"], "text")
    n = F.lit(float(templates.count()))  # a fixed table
    idf = counted.groupBy("term").agg(F.ln(1 + n / F.count("*")).alias("idf"))
    weighted = counted.join(F.broadcast(idf), "term").withColumn("w", weight(F.col("tf"), F.col("idf")))
    size = Window.partitionBy("template")
    weighted = weighted.select("template", "license", "term", "w", F.sqrt(F.sum(F.col("w") * F.col("w")).over(size)).alias("norm"))
    own = term_counts(texts, [key], text).join(F.broadcast(idf), "term", "left")
    own = own.withColumn("v", weight(F.col("tf"), F.coalesce("idf", F.ln(1 + n))))
    norms = own.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("own_norm"))
    dots = own.join(F.broadcast(weighted), "term").groupBy(key, "template", "license", "norm").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    cosine = dots.join(norms, key).withColumn("similarity", F.round(F.col("dot") / (F.col("norm") * F.col("own_norm")), 6)).where(F.col("similarity") >= threshold)
    if decide:
        (a, b), (c, d) = deciding(F.col(text)), deciding(F.col("text"))
        cosine = cosine.join(texts.select(key, a.alias("words"), b.alias("numbers")), key)
        cosine = cosine.join(F.broadcast(templates.select("template", c.alias("own_words"), d.alias("own_numbers"))), "template")
        cosine = cosine.where((F.col("words") == F.col("own_words")) & (F.size(F.array_except("own_numbers", "numbers")) == 0))
    best = cosine.groupBy(key).agg(F.max_by(F.struct("license", "similarity"), F.struct("similarity", F.expr("-template"))).alias("b"))
    return best.select(key, "b.license", "b.similarity")


def ancestors(folder: Column) -> Column:
    """The folder and all above it, ``''`` for the root: (path, depth)."""
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), i.alias("depth")))


def scan(files: DataFrame, path: str = "path", text: str = "text", threshold: float = THRESHOLD, license_file: Column | None = None, lines_only: bool = False) -> DataFrame:
    """``files`` plus ``license``, ``similarity`` and ``found_in`` (header, folder or null).

    ``license_file`` marks files that set their folder's license; by default those named LICENSE,
    LICENCE, COPYING or NOTICE. ``lines_only`` compares single cue lines and license files with ``TEMPLATES`` alone.
    """
    files = without(files, {"license", "similarity", "found_in"})
    templates = template_table(files.sparkSession, TEMPLATES if lines_only else TEMPLATES + WORDINGS + full_texts())
    marks = F.regexp_extract(F.col(path), "([^/]*)$", 1).rlike(FILE_NAME) if license_file is None else license_file
    folder = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(path), F.lit("")), "[^/]*$", ""), "^/+|/+$", "")
    keyed = files.withColumns({"__folder": F.when(F.col(path).isNotNull(), folder), "__mark": F.coalesce(marks, F.lit(False))})
    whole = F.coalesce(F.col(text), F.lit(""))
    cue = CUE if lines_only else CUE + MORE_CUES
    nothing = F.array().cast("array<string>")
    parts = [F.filter(F.split(whole, "\n"), lambda x: x.rlike(cue)), F.when(F.col("__mark") & whole.rlike(cue), F.array(whole)).otherwise(nothing)]
    if not lines_only:
        parts.append(F.filter(F.split(whole, PARAGRAPH), lambda x: x.rlike(cue)))
    keyed = keyed.withColumn("__lines", F.array_distinct(F.transform(F.concat(*parts), lambda x: F.trim(x))))

    digests = F.transform("__lines", F.md5)
    lists = materialize(keyed.select("__folder", "__mark", "__lines").distinct())
    # words, lists and joins carry a line's digest, as a line may be a whole text
    lines = lists.select(F.explode("__lines").alias("line")).distinct().select(F.md5("line").alias("key"), "line", (F.length("line") > LONG).alias("long"))
    known = classify(lines, "key", "line", templates, threshold, not lines_only)
    known = materialize(known.join(lines.select("key", "long"), "key"))
    lists = lists.select("__folder", "__mark", digests.alias("__keys"))
    # a file's lines become one key again after the lookup: the list of its lines
    per_list = lists.select("__keys").distinct().select("__keys", F.explode("__keys").alias("key")).join(known, "key")
    long_ = F.lit(0) if lines_only else -F.col("long").cast("int")  # a full text tells licenses apart that begin alike
    per_list = per_list.groupBy("__keys").agg(F.min_by(F.struct("license", "similarity"), F.struct(long_, -F.col("similarity"), "license")).alias("__own"))

    setters = lists.where("__mark and __folder is not null").select("__folder", "__keys").join(per_list, "__keys").select(F.col("__folder").alias("path"), "__own")
    folder_license = setters.groupBy("path").agg(F.min_by("__own", F.struct(-F.col("__own.similarity"), "__own.license")).alias("__folder_own"))
    folders = lists.where("__folder is not null").select("__folder").distinct()
    above = folders.select("__folder", F.explode(ancestors(F.col("__folder"))).alias("a")).select("__folder", F.col("a.path").alias("path"), F.col("a.depth").alias("depth"))
    nearest = above.join(folder_license, "path").groupBy("__folder").agg(F.max_by("__folder_own", "depth").alias("__inherited"))

    one = F.pmod(F.size("__keys"), F.lit(1)).cast("long")  # 0, but no constant, or the salt would be optimised away
    salt = F.when(F.size("__keys") > 0, one).otherwise(F.xxhash64(path))  # an empty list matches none
    out = keyed.withColumn("__keys", digests).withColumn("__salt", salt).join(per_list.withColumn("__salt", one), ["__keys", "__salt"], "left").join(nearest, "__folder", "left")
    best = F.coalesce("__own", "__inherited")
    return out.withColumns({"license": best["license"], "similarity": best["similarity"], "found_in": F.when(F.col("__own").isNotNull(), "header").when(F.col("__inherited").isNotNull(), "folder")}).drop("__folder", "__mark", "__lines", "__keys", "__salt", "__own", "__inherited")


def op7_query(spark, sf_dir: str) -> DataFrame:
    """License of every document by ``scan``, with a path made up of its columns.

    A document that begins or ends with a cue line is its folder's LICENSE-doc_id, in ``source/lang`` or in one of
    the folders ``source/lang/part0`` to ``part7``, where the others lie; so folders have licenses of their own, or those above, or none.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    name = F.col("doc_id").cast("string")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    notice = F.coalesce(F.get(lines, F.lit(0)).rlike(CUE) | F.get(lines, F.size(lines) - 1).rlike(CUE), F.lit(False))
    part = F.concat(F.lit("part"), F.pmod("doc_id", F.lit(8)).cast("string"))
    folder = F.when(notice & (F.pmod("doc_id", F.lit(3)) == 0), F.lit(None)).otherwise(part)
    path = F.concat_ws("/", "source", "lang", folder, F.when(notice, F.concat(F.lit("LICENSE-"), name)).otherwise(F.concat(name, F.lit(".txt"))))
    return scan(docs.withColumn("path", path)).select("doc_id", "path", "license", "similarity", "found_in")
