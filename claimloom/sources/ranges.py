"""Text files read in ranges where a record can span lines, and a line can lie inside a quoted text.

A file split is read by Spark's line reader, which knows nothing of quotes.  Whether a
piece (what lies between two separators) begins inside a quoted text depends on all that
comes before, but its effect does not: it is a function of two states.  So the pieces of
a split are composed to one function and the totals for both states, one row a split;
windows over those rows give every split its state and its totals at the start; and a
second pass over the pieces, each split from its own start, cuts the records.  What is
left open at the ends of splits is put together by record number.

Only the rows of the splits are broadcast: one of a few numbers per split, 800 thousand
for 100 TB in splits of 128 MB.  Records are never shuffled but those cut by a split's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import reach

SPLIT = ["file", "block"]


def pieces(spark: SparkSession, path: str, separator: str, **columns: Column) -> DataFrame:
    """file, block and value of every piece, in file order within a split, and further columns."""
    reach(spark)
    raw = spark.read.option("lineSep", separator).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        *(c.alias(n) for n, c in columns.items()),
    )


def states(zero: np.ndarray, one: np.ndarray, start: int) -> np.ndarray:
    """The state before each piece and after the last; ``zero`` and ``one`` are the pieces' effects."""
    fixed, swap = zero == one, (zero == 1) & (one == 0)
    turns = np.cumsum(swap)
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(zero)), -1)) if len(zero) else np.zeros(0, int)
    known = last >= 0
    at = np.maximum(last, 0)
    after = np.where(known, zero[at] ^ ((turns - turns[at]) & 1), start ^ (turns & 1)) if len(zero) else zero
    return np.concatenate(([start], after)).astype(np.int64)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row begins and the last one ends."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(ends, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch, bool]]:
    """Parts of batches that belong to one split, and whether the split begins there."""
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column("file"), batch.column("block").to_numpy()
        change = np.flatnonzero(blocks[1:] != blocks[:-1]) + 1
        names = files.dictionary_encode().indices.to_numpy()
        cuts = np.union1d(change, np.flatnonzero(names[1:] != names[:-1]) + 1).astype(int)
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            key = (files[int(a)].as_py(), int(blocks[a]))
            yield key, batch.slice(int(a), int(b - a)), key != current
            current = key


def summaries(effects: DataFrame, total, note, kind: pa.DataType, sql_kind: str, prepare=lambda batch: batch) -> DataFrame:
    """For every split its effect on both states, the totals that go with each, and a note.

    ``effects`` holds file, block, zero, one and what the functions need: ``total`` makes
    a number of a batch and the states around its pieces, ``note`` a value of the note so
    far (None at first) and a batch.  ``prepare`` may add columns to a batch first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for key, part, new in by_split(map(prepare, batches)):
            if new:
                rows.append([*key, 0, 1, 0, 0, None])
            row = rows[-1]
            zero, one = (part.column(c).to_numpy() for c in ("zero", "one"))
            for start in (0, 1):
                around = states(zero, one, row[2 + start])
                row[4 + start] += total(part, around)
                row[2 + start] = int(around[-1])
            row[6] = note(row[6], part)
        if rows:
            names = [*SPLIT, "zero", "one", "total_zero", "total_one"]
            *plain, notes = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([*map(pa.array, plain), pa.array(notes, kind)], names=[*names, "note"])

    made = "file string, block long, zero long, one long, total_zero long, total_one long"
    return effects.mapInArrow(run, f"{made}, note {sql_kind}")


def starts(splits: DataFrame) -> DataFrame:
    """The splits with ``state``, the state in which each begins, and ``total``, its total from there."""
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    fixed = F.col("zero") == F.col("one")
    swaps = splits.withColumn("_turns", F.sum(F.when(~fixed & (F.col("zero") == 1), 1).otherwise(0)).over(whole))
    seen = swaps.withColumns(
        {
            "_last": F.last(F.when(fixed, F.col("zero")), True).over(upto),
            "_then": F.coalesce(F.last(F.when(fixed, F.col("_turns")), True).over(upto), F.lit(0)),
            "_now": F.coalesce(F.last("_turns").over(upto), F.lit(0)),
        }
    )
    state = F.pmod(F.coalesce("_last", F.lit(0)) + F.col("_now") - F.col("_then"), F.lit(2)).cast("int")
    total = F.when(F.col("state") == 0, F.col("total_zero")).otherwise(F.col("total_one"))
    return seen.withColumn("state", state).withColumn("total", total).drop("_turns", "_last", "_then", "_now")


def folded(value: Column, quote: str, step, start: Column) -> Column:
    """A fold over the parts of a value between quotes: ``step(state, part, is_first)``."""
    parts = F.split(value, quote)
    first = step(start, F.get(parts, F.lit(0)), True)
    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), first, lambda s, t: step(s, t, False))
