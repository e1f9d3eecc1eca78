"""Line dedup over overlapping windows of three lines, in DataFrame functions only.

Every run of three consecutive lines is hashed.  A window that occurs more than
once in the corpus keeps its first occurrence, in the order (doc_id, position); all
lines covered by a later occurrence are removed, overlapping windows merged.

Only window hashes (128 bits) and positions are shuffled, counted with map-side
combining.  The text moves once, to meet its covered positions; documents
without any meet none and stay whole.

Defined cases: a null text is an empty one; a text of fewer than three lines has no
window and is kept; windows of blank lines only are ignored; rows equal in doc_id
and text count as one document and get the same answer; a null doc_id comes first
in the order; an empty table gives no rows; other columns, whatever their names, are
kept by ``dedup`` as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import indices, let, pin

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(text: Column, width: int) -> Column:
    """(position, two hashes) of every window that is not blank."""

    def of(lines: Column) -> Column:
        def one(i: Column) -> Column:
            part = F.slice(lines, i + 1, width)
            return F.struct(
                i.alias("at"),
                F.xxhash64(part).alias("a"),
                F.xxhash64(F.lit(width), F.reverse(part)).alias("b"),
                (F.trim(F.array_join(part, "")) == "").alias("blank"),
            )

        return F.transform(indices(F.size(lines) - (width - 1)), one)

    return F.filter(let(_lines(text), of), lambda w: ~w["blank"])


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc"), text.alias("body")).select(
        "doc", F.xxhash64("body").alias("tie"), "body"
    )


def covered(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc, tie and the window positions that repeat an earlier window."""
    windows = _keyed(docs).select("doc", "tie", F.inline(_windows(F.col("body"), width)))
    windows = windows.select("a", "b", F.struct("doc", "tie", "at").alias("place"))
    repeated = (
        windows.groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
        .where(F.col("n") > 1)
        .select("a", "b", "first")
    )
    later = windows.join(repeated, ["a", "b"]).where(~F.col("place").eqNullSafe(F.col("first")))
    return later.groupBy(
        F.col("place.doc").alias("doc"), F.col("place.tie").alias("tie")
    ).agg(F.collect_set("place.at").alias("positions"))


def _cut(width: int) -> Column:
    """The kept line numbers: all but those a covered window spans."""
    spans = F.flatten(
        F.transform("positions", lambda p: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: p + j))
    )
    return F.array_except(indices(F.size(_lines(F.col("body")))), spans)


def dedup(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """Struct ``row`` of the input row, then n_lines, n_removed and the kept ``lines`` text.

    Kept text is the kept lines joined; a text that loses nothing is unchanged.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs["doc_id"].cast("long").alias("doc"),
        F.xxhash64(text).alias("tie"),
        text.alias("body"),
    )
    hits = covered(docs, width).select(F.col("doc").alias("d"), F.col("tie").alias("t"), "positions")
    joined = rows.join(hits, F.col("doc").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")), "left")
    joined = pin(joined, "row", "body", "positions", kept=F.when(F.col("positions").isNotNull(), _cut(width)))
    n = F.size(_lines(F.col("body")))
    chosen = let(_lines(F.col("body")), lambda ls: F.transform("kept", lambda i: F.get(ls, i)))
    return joined.select(
        "row",
        n.cast("long").alias("n_lines"),
        F.coalesce(n - F.size("kept"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("kept").isNull(), F.col("body")).otherwise(F.array_join(chosen, "\n")).alias("lines"),
    )


def report(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, line counts and the digest of the kept text of every document."""
    return dedup(docs.select("doc_id", "text"), width).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.md5("lines").alias("kept_md5")
    )


def kept(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents with their kept text; those of which nothing is left are dropped."""
    fields = [
        (F.col("lines") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns
    ]
    whole = (F.col("n_removed") == 0) | (F.trim(F.col("lines")) != "")
    out = dedup(docs, width).where(whole).select(*fields)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


SQL = """
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents
),
windows AS (
  SELECT doc_id, unnest(range(len(ls) - 2)) AS pos, ls FROM split WHERE len(ls) >= 3
),
keyed AS (
  SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS k FROM windows
),
ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS r
  FROM keyed WHERE trim(replace(k, chr(10), '')) <> ''
),
gone AS (
  SELECT DISTINCT doc_id, pos + j AS line FROM ranked, (SELECT unnest([0, 1, 2]) AS j) WHERE r > 1
),
numbered AS (
  SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS l FROM split
),
left_over AS (
  SELECT n.doc_id, string_agg(l, chr(10) ORDER BY n.line) AS kept, count(*) AS n
  FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.line = g.line
  WHERE g.line IS NULL GROUP BY n.doc_id
)
SELECT s.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(n, 0) AS BIGINT) AS n_removed,
       md5(coalesce(kept, '')) AS kept_md5
FROM split s LEFT JOIN left_over o ON s.doc_id = o.doc_id
"""
