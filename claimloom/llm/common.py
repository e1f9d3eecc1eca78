"""What the operators share: input columns, the table reader, scratch tables."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage, unstage

Query = Callable[[SparkSession, str], DataFrame]

__all__ = ["Query", "arrow_batch", "bit_filter", "code_points", "nonnull_text", "reach", "stage", "table", "unstage"]

FILTER_BITS = (1 << 16, 1 << 27)
KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def reach(spark: SparkSession) -> None:
    """Put the folder of this package on the path of the Python workers.

    Enough where workers see the driver's folders; on other clusters ship the package
    with ``addPyFile`` or install it.
    """
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nonnull_text(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id and text (null: empty) and nothing else, so no other column can clash."""
    return docs.select("doc_id", *columns, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def code_points(text: Column) -> Column:
    return F.char_length(text).cast("long")


def arrow_batch(schema: str, *columns) -> pa.RecordBatch:
    """Columns as a record batch of a schema of longs, ints and binaries."""
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)],
        names=[f for f, _ in fields],
    )


def bit_filter(values: DataFrame, column: str, expected: int) -> tuple[np.ndarray, int]:
    """A bit map over the low bits of hashes: no false negatives, at most 16 MB.

    Beyond what it can hold it lets more through; callers join exactly after it.
    """
    bits = min(max(FILTER_BITS[0], 1 << (16 * max(expected, 1)).bit_length()), FILTER_BITS[1])
    cell = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = values.select(cell.alias("cell")).selectExpr(
        "shiftright(cell, 5) AS w", "shiftleft(1L, cast(cell % 32 AS int)) AS m"
    )
    made = np.zeros(bits // 32, dtype=np.uint32)
    for w, m in words.groupBy("w").agg(F.bit_or("m").alias("m")).toLocalIterator():
        made[w] = m
    return made, bits
