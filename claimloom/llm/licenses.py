"""License scan: MinHash bands over overlapping windows, then exact containment.

DataFrame functions only.  Words are runs of letters and digits, lower-cased; a
shingle is five words.  Templates are grouped by size: those of up to 2^c words are
looked for in windows of 2^(c+1) words that start every 2^c words, so a
passage as long as the template lies whole in some window.  Each band is the
minimum of one hash over a window's shingles.  A window with the wanted share of a
template has at least a known Jaccard measure s with it, and the number of bands b of
the group is the least with (1 - s)^b <= ``miss``.  Windows that agree with a template
in a band are verified: the share of its shingles in the window, exactly.

A window without any shingle of any template cannot agree in a band but by a hash
collision and is left out before the bands are computed; that loses nothing.

Templates are a parameter of bounded size (``MAX_SHINGLES``, checked); they enter the
plan as constants, and their band table is broadcast.

Defined cases: a null text is an empty one; a text of fewer than five words has no
shingle and no match; a template of fewer than five words is refused; repeated rows
give one result for their doc_id; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import indices, let, pin

K = 5
SHARE = 0.75
MISS = 1e-6
MAX_SHINGLES = 20_000

# Notices of common licenses, as published.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    (
        "MIT-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the Software without restriction",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-text",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "BSD-text",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
    ),
]


def _shingles(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return let(
        words,
        lambda w: F.transform(indices(F.size(w) - (K - 1)), lambda i: F.xxhash64(F.slice(w, i + 1, K))),
    )


def size_class(words: int) -> int:
    return max(3, math.ceil(math.log2(words)))


def bands_needed(shingles: list[int], window: int, share: float, miss: float) -> int:
    """Bands with which a window holding ``share`` of a template is missed at most so often."""
    least = 1.0
    for n in shingles:
        common = math.ceil(share * n)
        least = min(least, common / (window + n - common))
    return 1 if least >= 1 else math.ceil(math.log(miss) / math.log(1 - least))


def _minima(shingles: Column, bands: Column) -> Column:
    """(band, minimum) pairs."""
    return F.transform(
        F.sequence(F.lit(0), bands - 1),
        lambda j: F.struct(
            j.alias("band"), F.array_min(F.transform(shingles, lambda s: F.xxhash64(j, s))).alias("least")
        ),
    )


def _constants(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in sorted(set(values))])


def scan(
    docs: DataFrame,
    templates: list[tuple[str, str]] | None = None,
    share: float = SHARE,
    miss: float = MISS,
) -> DataFrame:
    """doc_id, license, containment and the first matching window's word of every match."""
    spark = docs.sparkSession
    listed = spark.createDataFrame(templates or TEMPLATES, "license string, text string")
    known = [(r[0], r[1]) for r in listed.select("license", F.array_distinct(_shingles(F.col("text")))).collect()]
    if any(not s for _, s in known):
        raise ValueError("a template needs five words")
    if sum(len(s) for _, s in known) > MAX_SHINGLES:
        raise ValueError(f"templates have more than {MAX_SHINGLES} shingles; scan them in parts")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    every = _constants([v for _, s in known for v in s])
    rows = pin(rows, "doc_id", shingles=_shingles(F.col("text"))).where(F.arrays_overlap("shingles", every))
    classes: dict[int, list] = {}
    for license_, shingles in known:
        classes.setdefault(size_class(len(shingles) + K - 1), []).append((license_, shingles))
    bands = {c: bands_needed([len(s) for _, s in group], span(c), share, miss) for c, group in classes.items()}
    near = F.concat(*[_windows(c, [v for _, s in group for v in s]) for c, group in sorted(classes.items())])
    signed = rows.select("doc_id", F.inline(near)).select(
        "doc_id", "size", "first_word", "part", F.inline(_minima(F.col("part"), _of_size(bands)))
    )
    held = [(c, license_, shingles) for c, group in classes.items() for license_, shingles in group]
    table = spark.createDataFrame(held, "size int, license string, wanted array<long>")
    table = table.select("size", "license", "wanted", F.inline(_minima(F.col("wanted"), _of_size(bands))))
    retrieved = signed.join(F.broadcast(table), ["size", "band", "least"])
    retrieved = retrieved.dropDuplicates(["doc_id", "first_word", "license"])
    contained = F.size(F.array_intersect("wanted", "part")) / F.size("wanted")
    found = retrieved.select("doc_id", "license", "first_word", contained.alias("containment"))
    return found.where(F.col("containment") >= share).groupBy("doc_id", "license").agg(
        F.max("containment").alias("containment"), F.min("first_word").alias("first_word")
    )


def span(c: int) -> int:
    """Shingles of a window of 2^(c+1) words."""
    return (1 << (c + 1)) - (K - 1)


def _of_size(bands: dict[int, int]) -> Column:
    chosen = F.lit(1)
    for c, b in bands.items():
        chosen = F.when(F.col("size") == c, F.lit(b)).otherwise(chosen)
    return chosen


def _windows(c: int, own: list[int]) -> Column:
    """The windows of a size that hold a shingle of its templates."""
    spans = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("shingles") - 1, F.lit(0)), F.lit(1 << c)),
        lambda o: F.struct(
            F.lit(c).alias("size"),
            o.cast("long").alias("first_word"),
            F.slice("shingles", o + 1, span(c)).alias("part"),
        ),
    )
    return F.filter(spans, lambda s: F.arrays_overlap(s["part"], _constants(own)))


def oracle(templates: list[tuple[str, str]] | None = None, share: float = SHARE) -> str:
    """The same windows and shares in SQL, without bands."""
    values = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in t)) for t in templates or TEMPLATES)
    return f"""
WITH template(license, text) AS (VALUES {values}),
worded AS (SELECT license, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM template),
wanted AS (
  SELECT DISTINCT license, CAST(power(2, greatest(3, ceil(log2(len(w))))) AS BIGINT) AS step,
         array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS i FROM worded)
),
sizes AS (SELECT license, count(*) AS n FROM wanted GROUP BY license),
words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents
),
shingles AS (
  SELECT doc_id, i - 1 AS i, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words)
),
hits AS (SELECT doc_id, license, step, i, s FROM shingles JOIN wanted USING (s)),
placed AS (
  SELECT doc_id, license, s, i, step, (i // step - back) * step AS o
  FROM hits, (SELECT unnest([0, 1]) AS back)
),
scored AS (
  SELECT doc_id, license, o, count(DISTINCT s) AS k
  FROM placed WHERE o >= 0 AND i < o + 2 * step - 4 GROUP BY doc_id, license, o
)
SELECT doc_id, license, max(CAST(k AS DOUBLE) / n) AS containment, min(CAST(o AS BIGINT)) AS first_word
FROM scored JOIN sizes USING (license)
WHERE CAST(k AS DOUBLE) / n >= {share}
GROUP BY doc_id, license
"""
