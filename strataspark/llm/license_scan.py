"""License notices and texts in documents, by MinHash bands over overlapping windows.

Words are lower-cased runs of letters and digits, shingles are runs of five. A window is nine words, five shingles; windows of a document follow every five words, so that every shingle lies in one and neighbours share four words. Each window has MINIMA minima, each a
band of its own: a window that shares a fifth of the union with a template's window (the least that a notice of five words can share) meets it with probability ``1 - 0.8**48 > 0.9999``, one of equal
shingles always. A retrieved template is verified on the shingles around the window: the share of the template's that occur there. A notice's numbers tell versions apart: of a template of up to NOTICE_WORDS words, every shingle with a number must occur, whatever the share. Of the templates that
verify at a window only the best stay, and all of those with equal shares, so that a license isn't taken for its sibling.

A window's minimum can only equal a template's if the window holds the very shingle, so documents without any shingle that is a template's minimum have no bands in common with any
and their minima are not worked out. Everything is built-in functions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.scratch import materialise

WORDS, WINDOW, MINIMA, THRESHOLD = 5, 5, 48, 0.8
#: Words of a template up to which its numbers must be the document's; in longer ones they are years and sections too.
NOTICE_WORDS = 100
#: Words of templates whose bands (48 for each word) are broadcast at once; more of them are scanned for in as many passes as it takes.
BLOCK_WORDS = 20_000
_SEEDS = [int(x) for x in np.random.Generator(np.random.PCG64(11)).integers(-(2**62), 2**62, MINIMA)]

#: Common license notices by SPDX identifier. Where licenses share a sentence, those that differ have one of their own that says so.
NOTICES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0-or-later", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "has waived all copyright and related or neighboring rights to this work"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-or-later", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def notices(spark: SparkSession) -> DataFrame:
    """The built-in templates, ``(license_id, text)``."""
    return spark.createDataFrame(list(NOTICES), "license_id string, text string")


def _shingles(text: str) -> str:
    """SQL for the array of shingle hashes of a text; empty for texts of fewer than WORDS words."""
    words = f"filter(split(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w <> '')"
    run = ", ".join(f"w[i + {j}]" for j in range(WORDS))
    return f"transform(array({words}), w -> if(size(w) < {WORDS}, array(), transform(sequence(0, size(w) - {WORDS}), i -> xxhash64({run}))))[0]"


def _numbered(text: str) -> str:
    """SQL for the shingle hashes of a notice that hold a number; empty for longer texts."""
    words = f"filter(split(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w <> '')"
    run = ", ".join(f"w[i + {j}]" for j in range(WORDS))
    some = f"filter(sequence(0, size(w) - {WORDS}), i -> exists(slice(w, i + 1, {WORDS}), x -> x rlike '^[0-9]+$'))"
    return f"transform(array({words}), w -> if(size(w) < {WORDS} or size(w) > {NOTICE_WORDS}, array(), transform({some}, i -> xxhash64({run}))))[0]"


def _least(window: str) -> str:
    """SQL for the array of a window's minima, each with the shingle that has it."""
    seeds = ", ".join(f"{s}L" for s in _SEEDS)
    return f"transform(array({seeds}), (a, k) -> array_min(transform({window}, x -> struct(xxhash64(x, a) as h, x as x, k as k))))"


def scan_licenses(
    docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", license_col: str = "license_id", template_col: str = "text", threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``(id_col, license_id, containment, first_word)`` for every document and license found in it.

    ``containment`` is the largest share of a template's distinct shingles found around one window (its length in words to either side), ``threshold`` or more, with all of a notice's numbers; a license is found where no other has more, and licenses of equal shares at a place are all found; a document that holds a license twice has it once, at its best
    place. ``first_word`` is the first
    word (from 0) of the first window with that share. A license may have several templates; the best counts. Null and empty texts and those of fewer than five words have no rows; templates that are null or of fewer than five words
    match nothing. Null ids are left out; rows that repeat an id count as one document. Other columns are ignored, whatever they are called. Templates may be of any length and number: they are dealt to blocks of about
    ``block_words`` words, each a pass over the documents.
    """
    spark = docs.sparkSession
    templates = notices(spark) if templates is None else templates
    templates = templates.select(F.col(license_col).cast("string").alias("license_id"), F.col(template_col).cast("string").alias("text")).where("license_id is not null and text is not null")
    size = templates.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-size // block_words))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    found = None
    for k in range(blocks):
        own = templates if blocks == 1 else templates.where(F.pmod(F.xxhash64("license_id", "text"), F.lit(blocks)) == k)
        part = _places(rows, own, threshold)
        found = part if found is None or part is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "id long, license_id string, containment double, first_word int").withColumnRenamed("id", id_col)
    place = found.groupBy("id", "at", "license_id").agg(F.max("containment").alias("containment"))
    most = place.groupBy("id", "at").agg(F.max("containment").alias("most"))
    place = place.join(most, ["id", "at"]).where("containment = most")
    best = place.groupBy("id", "license_id").agg(F.max(F.struct("containment", (-F.col("at")).alias("f"))).alias("b"))
    return best.select(F.col("id").alias(id_col), "license_id", F.col("b.containment").alias("containment"), (-F.col("b.f")).cast("int").alias("first_word"))


def _places(rows: DataFrame, templates: DataFrame, threshold: float) -> DataFrame | None:
    """``(id, at, license_id, containment)``: the windows of documents ``(id, text)`` that have a band of a template and whose surroundings hold enough of it; None if no template has a band."""
    made = templates.select("license_id", "text", F.expr(_shingles("text")).alias("sh")).where("size(sh) > 0").withColumns({"no": F.xxhash64("license_id", "sh"), "set": F.array_distinct("sh"), "numbers": F.array_distinct(F.expr(_numbered("text")))})
    made = materialise(made.dropDuplicates(["no"]), "templates")
    windows = made.select("no", F.explode(F.expr(f"transform(sequence(0, greatest(0, size(sh) - {WINDOW})), s -> slice(sh, s + 1, {WINDOW}))")).alias("w"))
    bands = windows.select("no", F.explode(F.expr(_least("w"))).alias("m")).select("no", F.col("m.x").alias("x"), F.xxhash64("m.k", "m.h").alias("band")).distinct()
    bands = materialise(bands, "bands")
    known = sorted({r.x for r in bands.select("x").distinct().collect()})
    if not known:
        return None
    minima = rows.sparkSession.createDataFrame([(known,)], "known array<long>")
    text = rows.withColumn("th", F.xxhash64("text"))
    # one row of bounded size beside every document: only those with a shingle that is some template's minimum, and of them the windows that hold one, can have a band
    near = text.select("id", "th", F.expr(_shingles("text")).alias("sh")).join(F.broadcast(minima), F.arrays_overlap("sh", "known"))
    near = near.select("id", "th", "sh", F.array_intersect("sh", "known").alias("hits"))
    own = F.expr(f"""
      transform(filter(sequence(0, size(sh) - 1, {WINDOW}), s -> arrays_overlap(slice(sh, s + 1, {WINDOW}), hits)), s -> struct(s as at,
        transform({_least(f"slice(sh, s + 1, {WINDOW})")}, m -> xxhash64(m.k, m.h)) as bands))
    """)
    met = near.select("id", "th", F.explode(own).alias("w")).select("id", "th", "w.at", F.explode("w.bands").alias("band"))
    met = met.join(F.broadcast(bands.select("no", "band").distinct()), "band").groupBy("id", "th", "no").agg(F.collect_set("at").alias("ats"))
    met = materialise(met, "license-candidates")
    # the few texts that met a template are read again, so that no text travels with its windows
    few = text.join(met.select("id", "th").distinct(), ["id", "th"], "left_semi").select("id", "th", F.expr(_shingles("text")).alias("sh"))
    found = few.join(met, ["id", "th"]).join(made.select("no", "license_id", "set", "numbers"), "no").withColumn("around", F.size("set") + WORDS + WINDOW)
    near = f"slice(sh, greatest(0, s - around) + 1, s - greatest(0, s - around) + {WINDOW} + around)"
    share = f"if(size(array_except(numbers, {near})) > 0, 0D, size(array_intersect(set, {near})) / size(set))"
    found = found.select("id", "license_id", F.explode(F.expr(f"transform(ats, s -> struct(s as at, {share} as containment))")).alias("w"))
    return found.select("id", "w.at", "license_id", "w.containment").where(F.col("containment") >= threshold)
