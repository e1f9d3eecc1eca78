"""CSV, line and experiment sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.constants import (
    OOD_ENCODINGS,
    OOD_TEXT_COLUMNS,
    RAW_LABEL_COLUMNS,
    RAW_TEXT_COLUMNS,
)
from ..functions.text import strip
from . import csv_ranges

CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def with_source_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Number the rows of a file scan from 0 in file order.

    ``df`` has to come straight from a file source.  Row positions inside a
    task are known without moving data; per-split counts give each split its
    base.  Those are broadcast: one row of four numbers per file split, so 100 TB
    in splits of 128 MB make 800 thousand.  The data itself is never shuffled.
    """
    where = ["_file", "_block"]
    path = F.col("_metadata.file_path")
    order = ["_path", "_block"]
    marked = df.withColumns(
        {
            "_path": path,
            "_file": F.xxhash64(path),
            "_block": F.col("_metadata.file_block_start"),
            "_pos": F.monotonically_increasing_id(),
        }
    )
    splits = marked.groupBy(*where, "_path").agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    before = F.sum("_n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    bases = splits.select(
        *where, "_first", F.coalesce(before, F.lit(0)).alias("_base")
    )
    return (
        marked.drop("_path")
        .join(F.broadcast(bases), where)
        .withColumn(name, F.col("_base") + F.col("_pos") - F.col("_first"))
        .drop("_file", "_block", "_pos", "_first", "_base")
    )


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labelled messages; ids number the rows before incomplete ones drop.

    Files are read in ranges, also where quoted texts hold line breaks.
    """
    wanted = {"_text": RAW_TEXT_COLUMNS, "_label": RAW_LABEL_COLUMNS}
    rows = csv_ranges.read(spark, path, wanted, OOD_ENCODINGS)
    return rows.where(F.col("_text").isNotNull() & F.col("_label").isNotNull()).select(
        F.format_string("msg_%06d", "row").alias("message_id"),
        strip(F.col("_text")).alias("text"),
        F.lower(strip(F.col("_label"))).alias("label"),
    )


def read_text_csv(spark: SparkSession, path: str, encodings: list[str] = OOD_ENCODINGS) -> DataFrame:
    """The text column of CSV files of unknown layout and encoding.

    Each file is read in the first of ``encodings`` in which all its bytes are valid, else
    in the last.  Files are read in ranges, also where quoted texts hold line breaks.
    """
    rows = csv_ranges.read(spark, path, {"text": OOD_TEXT_COLUMNS}, encodings)
    return rows.select("text").where(F.length(strip(F.col("text"))) > 0)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One message per non-blank line."""
    return (
        spark.read.text(path)
        .select(strip(F.col("value")).alias("text"))
        .where(F.col("text") != "")
    )


def read_experiments(spark: SparkSession, root: str, pattern: str = "*/*.json") -> DataFrame:
    """Result trees of many runs as VARIANT, tagged with their directory name.

    Directories without a result file simply do not match the pattern.
    """
    raw = spark.read.option("wholetext", True).text(f"{root.rstrip('/')}/{pattern}")
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return raw.select(
        folder.alias("experiment"), F.try_parse_json("value").alias("result")
    ).where(F.col("result").isNotNull())
