"""License scan: MinHash bands over overlapping text windows, then exact shingle containment (built-in functions only).

A license of m distinct shingles is in a text where some stretch of 2m consecutive shingles holds at least THRESHOLD of them, wherever the
stretch starts; words may be changed or inserted. A text becomes lower-cased words (runs of letters and digits) and the
hashes of its five-word shingles. It is seen through windows of 3m shingles that start every m, so each stretch lies whole in a
window, whose Jaccard similarity to the template is then at least 0.8 m / 3.2 m = 0.25. With BANDS
bands of one MinHash each such a window collides in some band with probability above 1 - 1e-6
(0.75 ** 50). In colliding windows every stretch is counted exactly.

A band can only collide if the window holds the shingle where the template's own minimum lies. Those few
shingles (BANDS per template at most) are looked up first, as a literal set; MinHashes are computed for the windows around hits alone.

Null and empty texts, and texts of fewer than five words, match nothing; texts of any length are scanned whole; rows that
share a key are reported together (the best stretch of any of them); a null key is reported as null; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 5
BANDS = 50
THRESHOLD = 0.8

#: Notices to look for; a parameter of scan(). Public license notices, in plain text.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "mit-line": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"),
}


def _once(value: Column, body) -> Column:
    """body(value) with ``value`` bound to a lambda variable, so that it is computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def shingles(text: Column) -> Column:
    """array<long>: the hashes of the five-word shingles of a text, in order (none below five words)."""
    words = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    keys = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))
    return _once(keys, lambda k: F.transform(
        F.slice(k, 1, F.greatest(F.size(k) - (WORDS - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(k, i + j) for j in range(1, WORDS)])))


def _least(column: str, band: int) -> Column:
    """(v, s): the smallest hash in this band and the shingle that has it."""
    return F.array_min(F.transform(column, lambda s: F.struct(F.xxhash64(s, F.lit(band)).alias("v"), s.alias("s"))))


def _windows_at(sh: Column, hits: Column, template: int, m: int, marks: list[int]) -> Column:
    """array<struct<t, start, window>>: the windows of one template that hold one of its marks: per hit the window that starts at or
    before it and the two before that."""
    at = F.transform(F.filter(hits, lambda i: F.get(sh, i).isin(marks)), lambda i: F.floor(i / m).cast("int"))
    every = _once(at, lambda a: F.array_distinct(F.flatten(F.transform(
        a, lambda k: F.array(k, F.greatest(k - 1, F.lit(0)), F.greatest(k - 2, F.lit(0)))))))
    return F.transform(every, lambda k: F.struct(F.lit(template).alias("t"), (k * m).alias("start"),
                                                 F.slice(sh, k * m + 1, F.lit(3 * m)).alias("window")))


def windows(text: Column, rows: list) -> Column:
    """The windows of all templates around the marks in a text."""
    marks = sorted({s for r in rows for s in r.marks})

    def around(sh: Column) -> Column:
        found = F.filter(F.transform(sh, lambda s, i: F.when(s.isin(marks), i)), lambda i: i.isNotNull())
        return _once(found, lambda hits: F.when(F.size(hits) > 0, reduce(
            F.concat, [_windows_at(sh, hits, t, r.m, r.marks) for t, r in enumerate(rows)])))

    return _once(shingles(text), around)


def templates(spark: SparkSession, texts: dict[str, str]) -> list:
    """One row per template: name, m, shingles, mins (its MinHash in every band), marks (the shingles where those lie)."""
    if not texts:
        raise ValueError("no templates")
    df = spark.createDataFrame(sorted(texts.items()), "license string, text string") \
        .withColumn("sh", F.array_distinct(shingles(F.col("text"))))
    least = [_least("sh", b) for b in range(BANDS)]
    rows = df.withColumn("low", F.array(*least)).select(
        "license", F.size("sh").alias("m"), "sh", F.transform("low", lambda x: x["v"]).alias("mins"),
        F.array_distinct(F.transform("low", lambda x: x["s"])).alias("marks")).collect()
    if short := [r.license for r in rows if r.m < 1]:
        raise ValueError(f"templates of fewer than {WORDS} words: {short}")
    return rows


def scan(docs: DataFrame, texts: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, license, containment, first_word, end_word): the best stretch of each license found in a text (most of the template's
    shingles, then the shortest, then the first)."""
    spark = docs.sparkSession
    rows = templates(spark, texts or TEMPLATES)
    known = spark.createDataFrame([(t, r.license, r.m, r.sh, r.mins) for t, r in enumerate(rows)],
                                  "t int, license string, m int, tsh array<bigint>, mins array<bigint>")
    # outer: a plain explode would also filter on the size of the array, which computes it twice
    seen = docs.select(F.col(id_col).alias("id"), F.explode_outer(windows(F.col(text_col), rows)).alias("w")) \
        .filter("w is not null").select("id", "w.*").join(F.broadcast(known), "t")  # known: one row per template
    bands = F.array(*[_least("window", b)["v"] for b in range(BANDS)])
    collide = F.exists(F.zip_with(bands, F.col("mins"), lambda a, b: a == b), lambda x: x)
    match = F.transform("window", lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    checked = seen.filter(collide).filter(F.size(F.array_intersect("window", "tsh")) >= THRESHOLD * F.col("m")) \
        .withColumn("at", F.filter(match, lambda x: F.array_contains("tsh", x["s"])))

    def stretch(a):  # the one that starts at a shingle of the template
        inside = F.filter("at", lambda b: (b["i"] >= a["i"]) & (b["i"] < a["i"] + 2 * F.col("m")))
        last = F.array_max(F.transform(inside, lambda b: b["i"]))
        return F.struct((F.size(F.array_distinct(F.transform(inside, lambda b: b["s"]))) / F.col("m")).alias("share"),
                        (a["i"] - last).alias("short"), (-(F.col("start") + a["i"])).alias("neg"), (F.col("start") + last + WORDS).alias("end"))

    checked = checked.withColumn("found", F.array_max(F.transform("at", stretch))).filter(F.col("found.share") >= THRESHOLD)
    best = F.max("found").alias("best")
    return checked.groupBy("id", "license").agg(best).select(
        F.col("id").alias(id_col), "license", F.col("best.share").alias("containment"),
        (-F.col("best.neg")).cast("long").alias("first_word"), F.col("best.end").cast("long").alias("end_word"))
