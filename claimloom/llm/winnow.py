"""Document fingerprints by winnowing, in DataFrame functions only.

A text is a sequence of units: its words of up to 16 characters, and every character of
longer ones, so text without blanks is followed character by character.  A rolling
hash covers every run of ``K`` units: a cyclic polynomial of the units' hashes, in which
a unit is hashed once and runs grow by rotation and exclusive or.  From every ``W``
consecutive hashes the smallest is taken, the rightmost of equal ones.  The chosen (hash, position)
pairs are the fingerprint, so two texts that share ``K + W - 1`` units in a row
always share a chosen hash.  A pair is one number: 40 bits of the hash, then
2^24 - 1 minus the position, which makes the smaller number the rightmost of equals.
Window minima come from pairwise minima over doubling distances.

Likeness of two fingerprints is the Jaccard measure of their hashes, without
positions; two empty fingerprints are alike.

Defined cases: a null text is an empty one, with an empty fingerprint; a text of
fewer than K units is one run; the next of a document is the one with the next
smaller doc_id, that of the last one the first (a single document is its own next);
rows with equal doc_id follow each other ordered by text; null doc_ids come last; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let, pin
from .common import code_points

K = 5
W = 4
BITS = 24
MASK = (1 << BITS) - 1
BUCKETS_PER_PARTITION = 4


def _units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"((?<!\S)\S{1,16}(?!\S)|\S)"), F.lit(1))


def _rolled(hashes: Column, k: int) -> Column:
    """The cyclic polynomial of every k neighbours, from those of shorter runs."""

    def rotated(x: Column, by: int) -> Column:
        return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))

    def grown(runs: Column, length: int) -> Column:
        if length == k:
            return F.slice(runs, 1, F.size(hashes) - (k - 1))
        by = length if 2 * length <= k else 1
        tail = F.slice(runs if by == length else hashes, length + 1, F.size(hashes))
        return let(
            F.zip_with(runs, tail, lambda a, b: rotated(a, by).bitwiseXOR(b)),
            lambda longer: grown(longer, length + by),
        )

    return grown(hashes, 1)


def _runs(units: Column, k: int) -> Column:
    """Hash and position of every run, as one number; fewer than k units are one run."""

    def numbers(hashes: Column) -> Column:
        short = F.slice(F.array(F.xxhash64(hashes)), 1, F.least(F.size(hashes), F.lit(1)))
        runs = F.when(F.size(hashes) < k, short).otherwise(_rolled(hashes, k))
        return F.transform(
            runs,
            lambda run, i: F.xxhash64(run)
            .bitwiseAND(F.lit(~MASK))
            .bitwiseOR(F.lit(MASK) - i % F.lit(1 << BITS)),
        )

    return let(F.transform(units, lambda unit: F.xxhash64(unit)), numbers)


def _minima(runs: Column, w: int) -> Column:
    """The smallest of every w consecutive numbers, once; of all, where there are fewer.

    ``w`` is a power of two.
    """

    def step(values: Column, reach: int) -> Column:
        if reach == w:
            return F.slice(values, 1, F.greatest(F.size(values) - (w - 1), F.lit(1)))
        return let(
            F.zip_with(values, F.slice(values, reach + 1, F.size(values)), lambda a, b: F.least(a, b)),
            lambda wider: step(wider, 2 * reach),
        )

    return F.array_distinct(step(runs, 1))


def chosen(text: Column, k: int = K, w: int = W) -> Column:
    """The winnowed (hash, position) numbers of a text, in text order."""
    return let(let(_units(text), lambda u: _runs(u, k)), lambda runs: _minima(runs, w))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard measure of the hashes of two fingerprints."""

    def hashes(x: Column) -> Column:
        return F.transform(x, lambda v: F.shiftright(v, BITS))

    def measure(x: Column, y: Column) -> Column:
        union = F.size(F.array_union(x, y))
        return F.when(union == 0, F.lit(1.0)).otherwise(
            F.size(F.array_intersect(x, y)).cast("double") / union
        )

    return let(hashes(a), lambda x: let(hashes(b), lambda y: measure(x, y)))


def written(numbers: Column) -> Column:
    return F.array_join(numbers.cast("array<string>"), ",")


def fingerprint(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, hash and position of every chosen run."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    picked = docs.select("doc_id", F.explode(chosen(text, k, w)).alias("v"))
    return picked.select(
        "doc_id",
        F.shiftright("v", BITS).alias("hash"),
        (F.lit(MASK) - F.col("v").bitwiseAND(F.lit(MASK))).alias("position"),
    )


def with_next(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Every document beside the next one in descending doc_id: texts and fingerprints.

    Documents are dealt into ranges of doc_id.  The bounds are ids that occur, a few
    for each shuffle partition; the document at a bound is also copied to the end of
    the range above it, and the first document to the end of the last range, so that
    every document finds its next one in its own range.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ranges = BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    found = rows.agg(
        F.percentile_approx("doc_id", cuts, F.lit(20 * ranges)).alias("cuts"), F.max("doc_id").alias("top")
    ).first()
    bounds = sorted({c for c in found["cuts"] or [] if c != found["top"]})
    listed = F.array(*map(F.lit, bounds)).cast("array<long>")
    own = F.coalesce(F.size(F.filter(listed, lambda b: b < F.col("doc_id"))), F.lit(0))

    def place(at: Column, order: int) -> Column:
        return F.struct(at.alias("at"), F.lit(order).alias("copy"))

    places = F.array_compact(
        F.array(
            place(F.col("own"), 0),
            F.when(F.array_contains(listed, F.col("doc_id")), place(F.col("own") + 1, 1)),
            F.when(F.col("doc_id").eqNullSafe(F.lit(found["top"])), place(F.lit(0), 2)),
        )
    )
    dealt = pin(rows, "doc_id", "text", own=own).select("doc_id", "text", F.inline(places)).repartition("at")
    dealt = pin(dealt, "doc_id", "text", "at", "copy", picked=chosen(F.col("text"), k, w))
    order = Window.partitionBy("at").orderBy(
        F.when(F.col("copy") == 2, 1).otherwise(0), F.desc_nulls_last("doc_id"), "text"
    )
    return dealt.select(
        "doc_id",
        "text",
        "picked",
        "copy",
        F.lead("text").over(order).alias("next_text"),
        F.lead("picked").over(order).alias("next_picked"),
    ).where(F.col("copy") == 0)


def compare(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness.

    The edit replaces the last third of the code points by as many, or all, of the
    first ones of the next document.
    """
    n = F.char_length("text")
    tail = F.floor(n / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) as int))"),
                      F.substring("next_text", F.lit(1), tail))
    rows = pin(with_next(docs, k, w), "doc_id", "picked", "next_picked", n_chars=code_points(F.col("text")), edited=edited)
    rows = pin(
        rows,
        "doc_id",
        "n_chars",
        "picked",
        "next_picked",
        edited_sha256=F.sha2("edited", 256),
        edited_picked=chosen(F.col("edited"), k, w),
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("picked")).alias("fingerprint"),
        written(F.col("edited_picked")).alias("edited_fingerprint"),
        likeness(F.col("picked"), F.col("edited_picked")).alias("near_edited"),
        likeness(F.col("picked"), F.col("next_picked")).alias("near_next"),
    )
