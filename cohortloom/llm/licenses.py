"""License scans: MinHash bands retrieve templates, shingle containment verifies them.

A text becomes the hashes of its 5-word shingles (runs of ASCII letters and digits,
lower case).  A text holds a template of ``n`` distinct shingles if some span of ``2 n``
shingles in a row holds at least 0.8 of them, which leaves room for inserted words.
Windows of ``3 n`` shingles start every ``n``, so every span lies inside the window in
whose first ``n`` places it starts.  A window's signature is the minimum of its hashes
under ``BANDS`` permutations (exclusive or with a constant); each minimum is a band of
its own.  A window with such a span has a Jaccard similarity of at least 0.8 / 3.2 with
the template, and 38 bands miss such a pair with a chance of 2 in 100,000.  Retrieved
templates are verified by exact containment in the spans of the window.

Built-in expressions only.  A window without any template's band minimum can't
meet a band, so texts and windows are first tested for those: no pair is lost.
Templates are a parameter and their table is small, whatever the corpus.

Defined results: a row for each document row and template found, with the best span
that starts with a shingle of the template, and the number of spans that hold it;
null, empty and short texts have none; of equally good spans the first counts; rows that repeat give repeated results; null ids are passed through;
other columns are not read; templates shorter than a shingle are refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import bind, documents, utf8

SHINGLE = 5
BANDS = 38
LEAST = 0.8

# Notices as published with the licenses.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may "
     "not use this file except in compliance with the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are "
     "permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International "
     "License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-header", "This program is free software: you can redistribute it and/or modify it under "
     "the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with "
     "or without fee is hereby granted"),
    ("mit", "Released under the MIT License."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of "
     "this software and associated documentation files (the \"Software\"), to deal in the Software "
     "without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, "
     "v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+"), lambda w: w != "")


def shingle_hashes(text: Column) -> Column:
    """Hashes of the 5-word shingles in order; empty for shorter texts."""
    return bind(_words(text), lambda w: F.when(F.size(w) >= SHINGLE, F.transform(
        F.sequence(F.lit(0), F.size(w) - SHINGLE),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
    ).otherwise(F.array().cast("array<bigint>")))


def _constant(j: int) -> int:
    x = (j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    return x - (1 << 64) if x >= 1 << 63 else x


def bands(hashes: Column) -> Column:
    """(band, shingle): under each permutation, the shingle that comes first."""
    def first(j: int) -> Column:
        mask = F.lit(_constant(j))
        return F.array_min(F.transform(hashes, lambda x: x.bitwiseXOR(mask))).bitwiseXOR(mask)

    return F.array(*[F.struct(F.lit(j).alias("band"), first(j).alias("shingle"))
                     for j in range(BANDS)])


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(license, n, shingles, bands) of each template."""
    rows = spark.createDataFrame(list(templates), "license string, body string")
    rows = rows.withColumn("shingles", F.array_distinct(shingle_hashes(F.col("body"))))
    return rows.select("license", F.size("shingles").alias("n"), "shingles",
                       bands(F.col("shingles")).alias("bands"))


def license_matches(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES,
                    least: float = LEAST) -> DataFrame:
    """(doc_id, license, containment, start_word, n_spans) of documents with a notice."""
    spark = docs.sparkSession
    # As many rows as templates were passed in.
    table = template_table(spark, templates).collect()
    if any(t["n"] == 0 for t in table):
        raise ValueError(f"a template needs {SHINGLE} words")
    firsts: dict[int, set[int]] = {}
    for t in table:
        firsts.setdefault(t["n"], set()).update(b["shingle"] for b in t["bands"])
    every = F.array(*[F.lit(x) for x in sorted(set().union(*firsts.values()))])
    found = docs.select(F.col("doc_id"), shingle_hashes(utf8("text")).alias("h"))
    found = found.filter(F.arrays_overlap("h", every)).withColumn(
        "row", F.monotonically_increasing_id())
    # Windows that hold a band minimum of a template of their length.
    kinds = F.array(*[F.struct(F.lit(n).alias("n"), F.array(*[F.lit(x) for x in sorted(v)])
                               .alias("firsts")) for n, v in sorted(firsts.items())])
    windows = found.withColumn("k", F.explode(kinds)).select(
        "row", "doc_id", F.col("k.n").alias("n"), F.explode(F.filter(
            F.transform(F.sequence(F.lit(0), F.size("h") - 1, F.col("k.n")), lambda s: F.struct(
                s.alias("start"), F.slice("h", s + 1, 3 * F.col("k.n")).alias("hashes"))),
            lambda w: F.arrays_overlap(w["hashes"], F.col("k.firsts")))).alias("w"))
    windows = windows.select("row", "doc_id", "n", "w.start", "w.hashes")
    keys = windows.withColumn("b", F.explode(bands(F.col("hashes"))))
    known = spark.createDataFrame(
        [(t["license"], t["n"], t["shingles"], b["band"], b["shingle"])
         for t in table for b in t["bands"]],
        "license string, n int, shingles array<bigint>, band int, shingle bigint")
    # A window and a template often share several bands; they are verified once.
    met = (keys.join(known, (keys["n"] == known["n"]) & (keys["b.band"] == known["band"])
                     & (keys["b.shingle"] == known["shingle"]))
           .select("row", "doc_id", "license", known["n"], "start", "shingles", "hashes")
           .dropDuplicates(["row", "license", "start"]))
    spans = met.select("row", "doc_id", "license", "n", F.explode(F.transform(
        F.filter(F.sequence(F.lit(0), F.least(F.col("n"), F.size("hashes")) - 1),
                 lambda i: F.array_contains(F.col("shingles"), F.get("hashes", i))),
        lambda i: F.struct(
            F.size(F.array_intersect(F.slice("hashes", i + 1, 2 * F.col("n")), "shingles"))
            .alias("shared"), (-F.col("start") - i).alias("back")))).alias("span"))
    spans = spans.filter(F.col("span.shared") >= F.lit(least) * F.col("n"))
    return (spans.groupBy("row", "license").agg(
        F.first("doc_id").alias("doc_id"), F.max("span").alias("best"),
        F.first("n").alias("n"), F.count("*").alias("n_spans"))
        .select("doc_id", "license", (F.col("best.shared") / F.col("n")).alias("containment"),
                (-F.col("best.back")).cast("long").alias("start_word"), "n_spans"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(documents(spark, sf_dir))


def _sql() -> str:
    """Containment of every template in the span from each of its shingles; no windows, no bands."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES)

    def grams(table: str, key: str, text: str) -> str:
        return rf"""
  SELECT {key}, generate_subscripts(g, 1) - 1 AS p, unnest(g) AS gram FROM (
    SELECT {key}, list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' ||
      w[i+2] || ' ' || w[i+3] || ' ' || w[i+4]) AS g FROM (
      SELECT {key}, list_filter(string_split_regex(translate({text}, '{_UPPER}', '{_LOWER}'),
        '[^a-z0-9]+'), lambda x: x <> '') AS w FROM {table}) WHERE len(w) >= 5)"""

    return f"""
WITH notices(license, body) AS (VALUES {values}),
t AS (SELECT DISTINCT license, gram FROM ({grams('notices', 'license', 'body')})),
sizes AS (SELECT license, count(*) AS n FROM t GROUP BY license),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
d AS ({grams('docs', 'r, doc_id', 'body')}),
hits AS (
  SELECT r, doc_id, license, n, p, gram FROM d JOIN t USING (gram) JOIN sizes USING (license)),
shares AS (
  SELECT r, doc_id, license, n, a.p AS start, count(DISTINCT b.gram) AS shared
  FROM hits a JOIN hits b USING (r, doc_id, license, n)
  WHERE b.p >= a.p AND b.p < a.p + 2 * n
  GROUP BY r, doc_id, license, n, a.p),
good AS (SELECT * FROM shares WHERE 10 * shared >= 8 * n)
SELECT doc_id, license, max(shared) / n AS containment,
  arg_max(start, (shared, -start))::BIGINT AS start_word, count(*) AS n_spans
FROM good GROUP BY r, doc_id, license, n"""


QUERIES = {"op1_licenses": op1_licenses}
ORACLE = {"op1_licenses": _sql()}
