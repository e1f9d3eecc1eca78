"""CSV with quoted line breaks, read in ranges; rows are those of Python's ``csv.DictReader``.

At a line break the reader is in one of two states: inside a quoted field or not.  A
quote opens a field only at its start, a doubled quote inside is a quote, and a quote
elsewhere is text.  Blank lines outside quotes are no rows.

Defined cases: each file has its own header, whose names hold no line break; a missing
column is null, a missing field null, further fields are ignored; CR LF ends a row like
LF, a lone CR is text; an open quote at the end of a file ends there; an empty file has no
rows; a byte order mark is dropped.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage
from . import ranges

START, PLAIN, QUOTED, CLOSED = 0, 1, 2, 3
MARK = "\ufeff"
LONE = "\ue00d"
csv.field_size_limit((1 << 31) - 1)


def _step(state, part, first: bool):
    """The field state after a quote (but for the first part) and the text up to the next one."""
    if not first:
        state = F.when(state == START, QUOTED).when(state == QUOTED, CLOSED).when(state == CLOSED, QUOTED).otherwise(PLAIN)
    outside = F.when(F.endswith(part, F.lit(",")), START).otherwise(PLAIN)
    return F.when((part == "") | (state == QUOTED), state).otherwise(outside).cast("int")


def _ended(batch: pa.RecordBatch, around: np.ndarray) -> np.ndarray:
    """Marks the lines at whose end a row ends."""
    blank = batch.column("blank").to_numpy(zero_copy_only=False).astype(bool) & (around[:-1] == 0)
    return (around[1:] == 0) & ~blank


def _decoded(raw: bytes, encoding: str) -> str:
    return raw.decode(encoding, "replace")


def _rows(text: str) -> Iterator[list[str]]:
    """Rows of whole lines; a CR that ends no line is text."""
    lone = re.compile("\r(?!\n)")
    text += "\n"
    if not lone.search(text):
        yield from csv.reader(io.StringIO(text, newline="\n"))
        return
    for row in csv.reader(io.StringIO(lone.sub(LONE, text), newline="\n")):
        yield [x.replace(LONE, "\r") for x in row]


def _fields(text: str, header: list[str], wanted: list[list[str]]) -> list[list[str | None]]:
    """For every row and every list of names the first field that is not empty."""
    places = [[header.index(n) for n in names if n in header] for names in wanted]
    return [
        [next((row[p] for p in own if p < len(row) and row[p] != ""), None) for own in places]
        for row in _rows(text)
        if row
    ]


def read(spark: SparkSession, path: str, wanted: dict[str, list[str]], encodings: list[str]) -> DataFrame:
    """row (from 0 over all files in order of path), file, and a column for each key of ``wanted``.

    A column holds the first non-empty field among the names given for it.  A file is
    read in the first of ``encodings`` in which all its bytes are valid, else in the last.
    """
    line = F.col("value")
    quoted = F.contains(line, F.lit('"'))

    def effect(start: int, without: int):
        end = ranges.folded(line, '"', _step, F.lit(start))
        return F.when(quoted, (end == QUOTED).cast("long")).otherwise(F.lit(without).cast("long"))

    blank = line.isin("", "\r")
    effects = ranges.pieces(
        spark, path, "\n",
        zero=effect(START, 0), one=effect(QUOTED, 1), blank=blank,
        head=F.when((F.col("_metadata.file_block_start") == 0) & ~blank & (line != MARK), line.cast("binary")),
        odd=F.when(~F.is_valid_utf8("value"), line.cast("binary")),
    )

    def noted(note: dict | None, part: pa.RecordBatch) -> dict:
        """The split's first line that is not blank, and the encodings in which its bytes are not valid."""
        note = note or {"header": None, "bad": [False] * len(encodings)}
        if note["header"] is None:
            heads = part.column("head").drop_null()
            note["header"] = heads[0].as_py() if len(heads) else None
        for raw in part.column("odd").drop_null().to_pylist():
            for i, name in enumerate(encodings):
                if not note["bad"][i]:
                    try:
                        raw.decode(name)
                    except UnicodeDecodeError:
                        note["bad"][i] = True
        return note

    kind = pa.struct([("header", pa.binary()), ("bad", pa.list_(pa.bool_()))])
    splits = ranges.summaries(
        effects, lambda batch, around: int(_ended(batch, around).sum()), noted, kind, "struct<header:binary,bad:array<boolean>>"
    )
    splits = stage(ranges.starts(splits), "csv_splits")
    whole = Window.partitionBy("file")
    bad = [F.max(F.get("note.bad", F.lit(i))).over(whole) for i in range(len(encodings))]
    encoding = F.lit(encodings[-1])
    for flag, name in reversed(list(zip(bad, encodings, strict=True))):
        encoding = F.when(~flag, F.lit(name)).otherwise(encoding)
    order = Window.orderBy("file", "block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(whole.orderBy("block")) == 1
    last = F.row_number().over(whole.orderBy(F.col("block").desc())) == 1
    left_open = F.when(F.col("state") == 0, F.col("zero")).otherwise(F.col("one"))
    some = F.sum("total").over(whole) > 0
    bases = (
        splits.withColumn("total", F.col("total") + F.when(last, left_open).otherwise(0))
        .withColumns({"first": first, "some": some, "encoding": encoding})
        .withColumn("header", F.max("note.header").over(whole))
        .withColumn("number", F.coalesce(F.sum("total").over(before), F.lit(0)))
        .withColumn("heads", F.sum((F.col("first") & F.col("some")).cast("long")).over(order))
        .withColumn("start", F.max(F.when(F.col("first"), F.col("number"))).over(whole))
        .select(*ranges.SPLIT, "state", "number", "heads", "start", "header", "encoding")
    )
    bases = stage(bases, "csv_bases")
    marked = ranges.pieces(
        spark, path, "\n",
        zero=effect(START, 0), one=effect(QUOTED, 1), blank=blank, raw=line.cast("binary"),
    ).join(F.broadcast(bases), ranges.SPLIT)
    alternatives, columns = list(wanted.values()), list(wanted)
    out = pa.schema(
        [("file", pa.string()), ("number", pa.int64()), ("heads", pa.int64()), ("start", pa.int64()), ("block", pa.int64()),
         ("header", pa.binary()), ("encoding", pa.string()), ("open", pa.binary()), *((c, pa.string()) for c in columns)]
    )

    def head_of(raw: bytes | None, encoding: str) -> list[str]:
        text = _decoded(raw or b"", encoding).removeprefix(MARK)
        if text.count('"') % 2:
            raise ValueError("a column name holds a line break")
        return next(_rows(text.removesuffix("\r")), [])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that begin and end in the split, and its open ends as bytes."""
        state = number = 0
        held: list[bytes] = []
        context = None

        def rest() -> Iterator[pa.RecordBatch]:
            if held and any(h.strip(b"\r") or state for h in held):
                yield made([(number, b"\n".join(held))], [[None] * len(columns)])

        def made(keys, values):
            file, block, heads, start, header, encoding = context
            n = len(keys)
            fixed = [[file] * n, [k for k, _ in keys], [heads] * n, [start] * n, [block] * n, [header] * n, [encoding] * n, [o for _, o in keys]]
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip([*fixed, *zip(*values, strict=True)], out, strict=True)], schema=out)

        for key, part, new in ranges.by_split(batches):
            if new:
                yield from rest()
                one = part.slice(0, 1).to_pylist()[0]
                context = (key[0], key[1], one["heads"], one["start"], one["header"], one["encoding"])
                state, number, held = one["state"], one["number"], []
                broken, names_ = bool(state), head_of(one["header"], one["encoding"])
            zero, other = (part.column(c).to_numpy() for c in ("zero", "one"))
            around = ranges.states(zero, other, state)
            ends = np.flatnonzero(_ended(part, around))
            raw = part.column("raw").to_pylist()
            state = int(around[-1])
            if not len(ends):
                held += raw
                continue
            at = 0
            if broken:
                yield made([(number, b"\n".join([*held, *raw[: ends[0] + 1]]))], [[None] * len(columns)])
                number, at, held, broken, ends = number + 1, int(ends[0]) + 1, [], False, ends[1:]
            if len(ends):
                whole = [*held, *raw[at : ends[-1] + 1]]
                text = _decoded(b"\n".join(whole), context[5])
                values = _fields(text.removeprefix(MARK) if number == context[3] else text, names_, alternatives)
                if len(values) != len(ends):
                    raise ValueError(f"{len(values)} rows where {len(ends)} end")
                if values:
                    yield made([(number + i, None) for i in range(len(values))], values)
                number, at, held = number + len(ends), int(ends[-1]) + 1, []
            held += raw[at:]
        if context is not None:
            yield from rest()

    types = "file string, number long, heads long, start long, block long, header binary, encoding string, open binary"
    rows = stage(marked.mapInArrow(cut, types + "".join(f", `{c}` string" for c in columns)), "csv_rows")
    ends = rows.where(F.col("open").isNotNull()).groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct("block", "open"))).alias("parts"),
        *(F.first(c).alias(c) for c in ("heads", "start", "header", "encoding")),
    )

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, keep = [], []
            for i, row in enumerate(batch.to_pylist()):
                raw = b"\n".join(p["open"] for p in row["parts"])
                text = _decoded(raw, row["encoding"])
                got = _fields(text, head_of(row["header"], row["encoding"]), alternatives)
                if got:
                    keep.append(i)
                    values.append(got[0])
            if keep:
                taken = [batch.column(c).take(pa.array(keep)) for c in ("file", "number", "heads", "start")]
                yield pa.RecordBatch.from_arrays([*taken, *(pa.array(c, pa.string()) for c in zip(*values, strict=True))], names=["file", "number", "heads", "start", *columns])

    stitched = ends.mapInArrow(parsed, "file string, number long, heads long, start long" + "".join(f", `{c}` string" for c in columns))
    kept = ["file", "number", "heads", "start", *columns]
    both = rows.where(F.col("open").isNull()).select(*kept).unionAll(stitched.select(*kept))
    return both.where(F.col("number") > F.col("start")).select(
        (F.col("number") - F.col("heads")).alias("row"), "file", *columns
    )
