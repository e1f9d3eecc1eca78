"""JSON arrays of objects (or objects one after another) read in ranges.

A piece is what lies between two closing braces.  It begins inside a string or not, and
changes the depth of nesting accordingly; both are composed over the ranges of a file,
so every range knows how deep it begins.  An object ends with the piece after which the
depth is that of the array again.  Objects within a range are cut there; those that span
ranges are put together from their ends.

Defined cases: a file that begins with ``[`` holds arrays, any other one objects in a
row; elements that are no objects are skipped; an object that cannot be parsed is a row of
nulls; one that is cut off by the end of a file is dropped; empty files and empty arrays
have no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage
from . import ranges

BETWEEN = " \t\r\n,[]\ufeff"
WHOLE, HEAD, TAIL, MIDDLE = 0, 1, 2, 3


_NESTING = np.zeros(256, np.int8)
_NESTING[[*b"{["]], _NESTING[ord("]")] = 1, -1


def _effects(texts: pa.Array) -> dict[str, pa.Array]:
    """Of each piece and either state before it: whether it ends inside a string, its change of depth with the brace after it.

    A quote behind an odd number of backslashes leads into a string from either state, any
    other one swaps the states; brackets and braces count outside of strings.
    """
    data, at = ranges.bytes_of(texts)
    n = len(texts)
    quote = np.flatnonzero(data == ord('"'))
    piece = np.searchsorted(at, quote, "right") - 1
    slashes, live, back = np.zeros(len(quote), np.int64), np.arange(len(quote)), quote - 1
    while len(live):
        more = (back >= at[piece[live]]) & (data[np.maximum(back, 0)] == ord("\\"))
        live, back = live[more], back[more] - 1
        slashes[live] += 1
    odd = slashes % 2 == 1
    turns = np.concatenate(([0], np.cumsum(~odd)))
    first = np.searchsorted(quote, at)
    last = np.maximum.accumulate(np.where(odd, np.arange(len(quote)), -1)) if len(quote) else quote
    known = last >= first[piece]
    since = turns[1:] - np.where(known, turns[last + 1], turns[first[piece]])
    mark = np.flatnonzero(_NESTING[data])
    of = np.searchsorted(at, mark, "right") - 1
    before = np.searchsorted(quote, mark) - 1
    quoted, some = before >= first[of], np.diff(first) > 0
    made = {}
    for name, start in (("zero", 0), ("one", 1)):
        after = np.append(np.where(known, 1, start) ^ (since & 1), start)
        ends = np.where(some, after[first[1:] - 1], start)
        outside = np.where(quoted, after[before], start) == 0
        depth = np.bincount(of[outside], _NESTING[data[mark[outside]]], n).astype(np.int64) if n else np.zeros(0, np.int64)
        made |= {name: pa.array(ends.astype(np.int64)), f"depth_{name}": pa.array(depth - (ends == 0))}
    return made


def _with_effects(batch: pa.RecordBatch) -> pa.RecordBatch:
    made = _effects(batch.column("text"))
    return pa.RecordBatch.from_arrays([*batch.columns, *made.values()], names=[*batch.schema.names, *made])


def _depths(part: pa.RecordBatch, around: np.ndarray) -> np.ndarray:
    """The change of depth of each piece, given the states around it."""
    zero, one = (part.column(c).to_numpy() for c in ("depth_zero", "depth_one"))
    return np.where(around[:-1] == 0, zero, one)


def objects(spark: SparkSession, path: str) -> DataFrame:
    """The text of every object, in no order."""
    value = F.col("value")
    opening = F.when(F.col("_metadata.file_block_start") == 0, F.substring(F.ltrim(value, F.lit(" \t\r\n\ufeff")), 1, 1))
    effects = ranges.pieces(spark, path, "}", text=value, head=opening)

    def opened(note: str | None, part: pa.RecordBatch) -> str | None:
        if note:
            return note
        heads = part.column("head").drop_null().to_pylist()
        return next((h for h in heads if h), None)

    splits = ranges.summaries(effects, lambda b, around: int(_depths(b, around).sum()), opened, pa.string(), "string", _with_effects)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = F.max((F.col("note") == "[").cast("long")).over(Window.partitionBy("file"))
    bases = ranges.starts(splits).select(
        *ranges.SPLIT, "state", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("depth"), F.coalesce(base, F.lit(0)).alias("base")
    )
    bases = stage(bases, "json_bases")
    marked = ranges.pieces(spark, path, "}", text=value).join(F.broadcast(bases), ranges.SPLIT)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, kind = None, [], WHOLE
        state = depth = base = 0

        def made(kinds, texts):
            n = len(texts)
            columns = [pa.array([key[0]] * n), pa.array([key[1]] * n), pa.array(kinds, pa.int32()), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["file", "block", "kind", "text"])

        def rest():
            text = "}".join(held) + "}"
            if kind == HEAD:
                return [made([MIDDLE], [text])]
            return [made([TAIL], [text.lstrip(BETWEEN)])] if held and text.strip(BETWEEN + "}") else []

        for here, part, new in ranges.by_split(map(_with_effects, batches)):
            if new:
                if key is not None:
                    yield from rest()
                key, held = here, []
                state, depth, base = (part.column(c)[0].as_py() for c in ("state", "depth", "base"))
                kind = HEAD if state or depth > base else WHOLE
            around = ranges.states(part.column("zero").to_numpy(), part.column("one").to_numpy(), state)
            depths = depth + np.cumsum(_depths(part, around))
            ends = np.flatnonzero((around[1:] == 0) & (depths == base))
            pieces = part.column("text").to_pylist()
            state, depth, at = int(around[-1]), int(depths[-1]), 0
            kinds, texts = [], []
            for end in ends.tolist():
                text = "}".join([*held, *pieces[at : end + 1]]) + "}"
                kinds.append(kind)
                texts.append(text if kind == HEAD else text.lstrip(BETWEEN))
                held, at, kind = [], end + 1, WHOLE
            held += pieces[at:]
            if texts:
                yield made(kinds, texts)
        if key is not None:
            yield from rest()

    rows = stage(marked.mapInArrow(cut, "file string, block long, kind int, text string"), "json_objects")
    order = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.where(F.col("kind") != WHOLE).withColumn("of", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("block", "kind", "text")))
    joined = ends.groupBy("file", "of").agg(parts.alias("parts"), F.max((F.col("kind") == HEAD).cast("int")).alias("closed"))
    stitched = joined.where("closed = 1").select(F.array_join(F.col("parts.text"), "").alias("text"))
    return rows.where(F.col("kind") == WHOLE).select("text").unionAll(stitched)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects as rows of a schema; absent fields are null."""
    return objects(spark, path).select(F.from_json("text", schema).alias("o")).select("o.*")
