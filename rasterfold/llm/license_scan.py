"""Op 10: license notices in documents by MinHash bands over overlapping windows, then exact shingle containment.

Texts become words (runs of 0-9 a-z after lower-casing) and hashes of five-word shingles. Templates are put in size classes
of 1, 2, 4, ... shingles; for a class of s, windows are 2 s shingles long and start every s, so each run of s shingles lies
whole in a window, and a window with a share t of a template's shingles has a Jaccard similarity of at least t / 4 with it.
BANDS bands of one hash each then miss it with a probability of (1 - t / 4) ** BANDS, under 2e-7 for t = 0.8.
A band's value can only be equal if the template's own minimum is in the window, so documents without any shingle of any
template, and windows without one of their class, are passed over without computing bands; that loses nothing.
Only DataFrame functions are used. Templates are a parameter; they are broadcast, behind a check of their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterfold.llm.common import cut, prepare, text_of

BANDS = 70
#: Most template shingles, all templates together; more are a wrong parameter.
MOST_SHINGLES = 50_000
WORDS = 5

# Notice sentences of well-known public licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def shingle_hashes(text: Column) -> Column:
    """Hashes of the five-word shingles of a text, in order; none for fewer words."""
    words = F.array_remove(F.split(F.lower(text), "[^0-9a-z]+"), "")

    def hashes(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)]))
        return F.when(F.size(w) >= WORDS, each).otherwise(F.array().cast("array<long>"))

    # The lambda's variable holds the words, so that they are split once a text and not once a shingle.
    return F.get(F.transform(F.array(words), hashes), 0)


def minima(hashes: Column) -> Column:
    """The least hash under each of BANDS seeds."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda s: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, s))))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, own (distinct hashes), step (size class). Templates with fewer than five words can't be found and are refused."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    out = rows.select("license", F.array_distinct(shingle_hashes(F.col("text"))).alias("own"))
    return out.withColumn("step", F.pow(F.lit(2), F.ceil(F.log2(F.size("own")))).cast("int"))


def _window(step: int):
    return lambda w: F.slice("h", w * step + 1, 2 * step)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """doc_id, license, containment, first_word: a row for each template of which a window holds `threshold` of the shingles.

    containment is the largest share in one window, first_word the position of the first matching shingle in windows that
    qualify. Null, empty and short texts give no rows; a doc_id that repeats gives one row for a license; an empty table gives
    none; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    own = template_table(spark, TEMPLATES if templates is None else templates)
    rows = own.collect()
    if any(not r["own"] for r in rows) or sum(len(r["own"]) for r in rows) > MOST_SHINGLES:
        raise ValueError("templates need five words each and at most MOST_SHINGLES shingles in all")
    every = F.array(*[F.lit(h) for h in sorted({h for r in rows for h in r["own"]})]).cast("array<long>")
    hashed = docs.select("doc_id", shingle_hashes(text_of()).alias("h")).filter(F.arrays_overlap("h", every))
    hashed = cut(hashed)
    windows = None
    for step in sorted({r["step"] for r in rows}):
        anchors = F.array(*[F.lit(h) for h in sorted({h for r in rows if r["step"] == step for h in r["own"]})]).cast("array<long>")
        starts = F.sequence(F.lit(0), F.floor((F.size("h") - 1) / step).cast("int"))
        part = hashed.select("doc_id", F.lit(step).alias("step"), F.posexplode(F.transform(starts, _window(step))).alias("w", "window"))
        part = part.filter(F.arrays_overlap("window", anchors))
        windows = part if windows is None else windows.unionByName(part)
    if windows is None:
        return spark.createDataFrame([], "doc_id long, license string, containment double, first_word long")
    bands = windows.select("doc_id", "step", "w", "window", F.posexplode(minima(F.col("window"))).alias("band", "value"))
    keys = F.broadcast(own.select("license", "own", "step", F.posexplode(minima(F.col("own"))).alias("band", "value")))
    met = bands.join(keys, ["step", "band", "value"]).dropDuplicates(["doc_id", "license", "step", "w"])
    share = F.size(F.array_intersect("window", "own")) / F.size("own")
    place = F.array_position(F.transform("window", lambda h: F.array_contains("own", h)), True) - 1
    found = met.select("doc_id", "license", share.alias("containment"), (F.col("w") * F.col("step") + place).alias("first_word")).filter(F.col("containment") >= threshold)
    return found.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("first_word").cast("long").alias("first_word"))
