"""License scans in DataFrame operations: MinHash bands over overlapping windows find templates, shingles verify them.

Templates and texts are cut into five-word shingles over letters and digits alone. Windows come in a few sizes; a template is
indexed by every window of the largest size that it fills, a text is swept by windows of the same size at half its length. A
window that lies in a copy is equal to a window of the template, so each band surely collides; where words differ, a band
collides with the windows' similarity, and BANDS of one row each meet a similarity of 0.6 in 97 of 100 windows. What is met is
verified exactly: a stretch as long as the template must hold 0.8 of its shingles. A template of fewer words than a shingle is a
shingle of its own width.

The library is a table of any size: its band keys are joined with those of the texts, by broadcast if they are few. Only ids meet
there; the texts that met a template are then read again and verified.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyqc.llm.common import small_or_shuffled, text_or_empty, written

SHINGLE = 5
CONTAINMENT = 0.8
#: Window size in shingles: number of bands. A window of one shingle is its own hash.
BANDS: dict[int, int] = {1: 1, 8: 4, 32: 8}

# Notices of public licenses by their SPDX identifiers.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _shingles(text: Column, width: int = SHINGLE) -> Column:
    """Hashes of a text's shingles of `width` words, in order; a text of fewer words has none."""
    # The words are bound to a name, so that they are made once and not for each shingle.
    hashes = F.transform(F.array(_words(text)), lambda w: F.when(F.size(w) < width, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))))
    return F.get(hashes, 0)


def _keys(h: str, size: int, stride: int) -> Column:
    """Band keys of the windows of `size` shingles over the array column h: hash of (size, band, least hash of the band)."""
    if size == 1:
        return F.transform(h, lambda x: F.xxhash64(F.lit(1), F.lit(0), x))
    starts = F.when(F.size(h) < size, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.size(h) - size + 1, F.lit(stride)))

    def band(b: int) -> Column:
        permuted = F.array(F.transform(h, lambda x: F.xxhash64(x, F.lit(b))))  # made once, then bound to p
        return F.get(F.transform(permuted, lambda p: F.transform(starts, lambda i: F.xxhash64(F.lit(size), F.lit(b), F.array_min(F.slice(p, i, size))))), 0)

    return F.concat(*map(band, range(BANDS[size])))


def library(templates: DataFrame) -> DataFrame:
    """template, license_id, width, size, t (hashes of shingles) for templates(template, license_id, text); what has no words is left out."""
    rows = templates.withColumn("width", F.least(F.size(_words(text_or_empty())), F.lit(SHINGLE))).where("width > 0")
    hashes = F.coalesce(*[F.when(F.col("width") == w, _shingles(F.col("text"), w)) for w in range(1, SHINGLE + 1)])
    size = F.coalesce(*[F.when(F.size("t") >= s, s) for s in sorted(BANDS, reverse=True)])
    return rows.withColumn("t", hashes).select("template", "license_id", "width", size.alias("size"), "t")


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | DataFrame | None = None) -> DataFrame:
    """doc_id, license_id, template, start_shingle, containment, n_shingles, text_hash: the best stretch of each document and template that match.

    templates: texts by license, or a table template, license_id, text. Null and empty texts match nothing; repeated rows are each
    reported; an empty table or library gives none. Every text is read whole, within its row. doc_id may be null; other columns
    are ignored. Of equal stretches the first is told.
    """
    spark = docs.sparkSession
    if not isinstance(templates, DataFrame):
        rows = [(i, name, text) for i, (name, text) in enumerate((n, t) for n, ts in (TEMPLATES if templates is None else templates).items() for t in ts)]
        templates = spark.createDataFrame(rows, "template int, license_id string, text string")
    known = written(library(templates), "templates")
    kinds = [tuple(r) for r in known.select("width", "size").distinct().collect()]  # three sizes of width SHINGLE, one of each other
    if not kinds:
        kinds = [(SHINGLE, 1)]
    index = F.coalesce(*[F.when((F.col("width") == w) & (F.col("size") == s), _keys("t", s, 1)) for w, s in kinds])
    index = written(known.select("template", "width", F.explode(F.array_distinct(index)).alias("key")).distinct(), "license-index")
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    found = []
    for width in sorted({w for w, _ in kinds}):
        hashed = texts.select("doc_id", "text_hash", _shingles(F.col("text"), width).alias("h"))
        keys = F.concat(*[_keys("h", s, max(1, s // 2)) for w, s in sorted(kinds) if w == width])
        rows = hashed.select("doc_id", "text_hash", F.explode_outer(keys).alias("key"))  # outer: else a filter over the keys is made first
        own = small_or_shuffled(index.where(F.col("width") == width).select("key", "template"))
        met = written(rows.join(own, "key").select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"), "template").distinct(), "met-templates")
        found.append(_verified(texts, small_or_shuffled(met), small_or_shuffled(known), width))
    return reduce(DataFrame.unionByName, found)


def _verified(texts: DataFrame, met: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """scan's rows for the pairs that met(id_, hash_, template)."""
    pairs = texts.join(met, texts["doc_id"].eqNullSafe(F.col("id_")) & (texts["text_hash"] == F.col("hash_"))).join(known, "template")
    # Exploding an array of one makes its element once: a filter above does not bring the expression back.
    once = lambda df, name, x: df.withColumn("once_", F.explode(F.array(x))).withColumnRenamed("once_", name)
    pairs = once(pairs, "h", _shingles(F.col("text"), width)).drop("text")
    n = F.size("t")
    # A stretch whose predecessor begins with a shingle of the template that it lacks itself is not better than that one.
    worse = lambda i: (i > 1) & F.array_contains("t", F.get("h", i - 2)) & ~F.array_contains(F.slice("h", i, n), F.get("h", i - 2))
    places = F.filter(F.sequence(F.lit(1), F.size("h")), lambda i: F.array_contains("t", F.get("h", i - 1)) & ~F.when(i > 1, worse(i)).otherwise(False))
    held = lambda p: F.size(F.array_intersect(F.slice("h", p, n), "t")) / F.size(F.array_distinct("t"))
    best = F.array_max(F.transform(places, lambda p: F.struct(held(p).alias("containment"), (1 - p).alias("before"))))
    judged = once(pairs, "best", best).withColumn("n_shingles", n).where(F.col("best.containment") >= CONTAINMENT)
    return judged.select("doc_id", "license_id", "template", (-F.col("best.before")).alias("start_shingle"), F.col("best.containment").alias("containment"), "n_shingles", "text_hash")


def winners(matches: DataFrame) -> DataFrame:
    """Of the matches (of `scan`) of one text that overlap, those that no better one overlaps: higher containment, then more shingles."""
    match = F.struct("license_id", "template", "start_shingle", "containment", "n_shingles")
    groups = matches.groupBy("doc_id", "text_hash").agg(F.collect_list(match).alias("all"))  # at most one a template and repeated row

    def beaten(m: Column) -> Column:
        better = lambda o: (o["containment"] > m["containment"]) | ((o["containment"] == m["containment"]) & (o["n_shingles"] > m["n_shingles"]))
        meets = lambda o: (o["start_shingle"] < m["start_shingle"] + m["n_shingles"]) & (m["start_shingle"] < o["start_shingle"] + o["n_shingles"])
        return F.exists("all", lambda o: better(o) & meets(o))

    return groups.select("doc_id", F.explode(F.filter("all", lambda m: ~beaten(m))).alias("m")).select("doc_id", "m.license_id", "m.template", "m.start_shingle", "m.containment")
