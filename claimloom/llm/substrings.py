"""Exact substring dedup: every byte covered by a repeated 400-byte string goes.

1. Anchors.  Among the ``K``-byte windows that lie in a 400-byte string, the one with
   the smallest hash (the rightmost of equal ones) is the string's anchor: equal
   strings have equal anchors at equal offsets.  Neighbouring starts mostly share an
   anchor, so a document is a list of pieces: the run of starts of one anchor and the
   bytes their strings span.  Each start belongs to exactly one piece.
2. Pieces are counted by (anchor hash, hash of their bytes) with map-side combining.  A
   piece that occurs twice repeats as a whole.  A piece that occurs once can only
   repeat in part, together with a different piece of the same anchor hash.
3. Those differing pieces of an anchor are cut into blocks aligned to the anchor and
   concatenated, and their suffix array is built by linear grouping
   (``suffix.suffix_array``).  A repeated string spans at least ``SHARED`` whole blocks,
   so its starts lie among suffixes with that common prefix; these few are told
   apart by 128-bit hashes of their strings.
4. An anchor with very many different pieces (``HOT_PIECES``, 12 MB: a passage in ever
   different surroundings) is not gathered in one task: the strings of its pieces are
   hashed one by one and counted across the cluster.
5. Repeated starts, as intervals, meet their document again; covered bytes are merged
   and removed.

Only hashes, the differing pieces and, once, the texts are shuffled.  Hash equality
is on 128 bits over the whole piece or string.

Defined cases: a null text is empty; texts under 400 bytes lose nothing; strings are
judged on the input, overlaps inside one document count; rows equal in doc_id and text
are separate documents, copies of each other; removal may cut a code point, as bytes
are bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, bit_filter, nonnull_text, stage
from .suffix import common_prefixes, suffix_array

LENGTH = 400
K = 64
BLOCK = 32
SHARED = (LENGTH - BLOCK + 1) // BLOCK
HOT_PIECES = 1 << 14
BATCH_SYMBOLS = 1 << 17
SLICE = 1 << 19
SEEN = 1 << 19
_LOW = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15

KEY = ["anchor", "body", "n", "lead"]
PIECE = "anchor long, body long, n int, lead int"
PLACE = "doc long, tie long, start long, " + PIECE
FOUND = PIECE + ", low int, high int"


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def windows(raw: np.ndarray) -> np.ndarray:
    """The hash of every K bytes in a row, from hashes of half their length; K is a power of two."""
    h, length = _BYTES[raw], 1
    while length < K:
        h = h[:-length] * np.uint64(pow(_BASE, length, 1 << 64)) + h[length:]
        length *= 2
    return _mixed(h)


def pieces(raw: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(start, number of starts, distance to the anchor, anchor hash) of a text's pieces."""
    starts = len(raw) - LENGTH + 1
    span = LENGTH - K + 1
    for at in range(0, max(starts, 0), SLICE):
        part = raw[at : min(at + SLICE, starts) + LENGTH - 1]
        h = windows(part)
        m = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
        reach = 1
        while 2 * reach <= span:
            m = np.minimum(m[:-reach], m[reach:])
            reach *= 2
        if reach < span:
            m = np.minimum(m[: len(m) - (span - reach)], m[span - reach :])
        first = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
        count = np.diff(np.append(first, len(m)))
        anchor = (_LOW - (m[first] & _LOW)).astype(np.int64)
        yield from zip(
            (first + at).tolist(), count.tolist(), (anchor - first).tolist(), h[anchor].view(np.int64).tolist(), strict=True
        )


def _body(view: memoryview, start: int, n: int) -> int:
    value = xxhash.xxh3_64_intdigest(view[start : start + n - 1 + LENGTH])
    return value - (1 << 64) if value >> 63 else value


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for doc, tie, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = text.encode("utf-8")
            view = memoryview(data)
            out += [
                (doc, tie, start, anchor, _body(view, start, n), n, lead)
                for start, n, lead, anchor in pieces(np.frombuffer(data, dtype=np.uint8))
            ]
        if out:
            yield arrow_batch(PLACE, *zip(*out, strict=True))


def _wanted(filter_):
    """The bytes of the pieces whose anchor the bit filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = filter_.value
        seen: set[tuple[int, int, int, int]] = set()
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(0):
                data = text.as_py().encode("utf-8")
                view = memoryview(data)
                for start, n, lead, anchor in pieces(np.frombuffer(data, dtype=np.uint8)):
                    cell = anchor & (bits - 1)
                    if not int(words[cell >> 5]) >> (cell & 31) & 1:
                        continue
                    key = (anchor, _body(view, start, n), n, lead)
                    if key not in seen:
                        if len(seen) < SEEN:
                            seen.add(key)
                        out.append((*key, bytes(view[start : start + n - 1 + LENGTH])))
            if out:
                yield arrow_batch(PIECE + ", data binary", *zip(*out, strict=True))

    return run


def repeated_starts(group: list[tuple[bytes, int, int]]) -> list[np.ndarray]:
    """Which starts of each (bytes, starts, lead) piece occur in another place of the batch."""
    marks = [np.zeros(n, dtype=bool) for _, n, _ in group]
    blocks: list[bytes] = []
    owner: list[int] = []
    offset: list[int] = []
    for j, (data, _, lead) in enumerate(group):
        for at in range(lead % BLOCK, len(data) - BLOCK + 1, BLOCK):
            blocks.append(data[at : at + BLOCK])
            owner.append(j)
            offset.append(at)
        blocks.append(b"")
        owner.append(j)
        offset.append(-1)
    names: dict[bytes, int] = {}
    total = len(group)
    text = [total - 1 - o if not b else total + names.setdefault(b, len(names)) for b, o in zip(blocks, owner, strict=True)]
    sa = suffix_array(text)
    shared = common_prefixes(text, sa)
    i = 0
    while i < len(sa):
        j = i + 1
        while j < len(sa) and shared[j] >= SHARED:
            j += 1
        if j - i > 1:
            _mark(group, marks, [(owner[s], offset[s]) for s in sa[i:j]])
        i = j
    return marks


def _mark(group, marks, suffixes) -> None:
    """Mark the starts whose first whole block is one of these and whose bytes recur."""
    seen: dict[bytes, list[tuple[int, int]]] = {}
    for j, at in suffixes:
        data, n, _ = group[j]
        for x in range(max(0, at - BLOCK + 1), min(at, n - 1) + 1):
            seen.setdefault(xxhash.xxh3_128_digest(data[x : x + LENGTH]), []).append((j, x))
    for places in seen.values():
        if len(places) > 1:
            for j, x in places:
                marks[j][x] = True


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, marks.view(np.int8), 0]))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial repeats of pieces, several anchors to a suffix array; rows come sorted.

    Equal pieces, which may come from several tasks, count once: they repeat as a whole.
    """
    held: list[tuple] = []
    size = 0

    def solve() -> list[tuple]:
        marks = repeated_starts([(data, n, lead) for _, _, n, lead, data in held])
        return [(*row[:4], low, high) for row, m in zip(held, marks, strict=True) for low, high in _runs(m)]

    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= BATCH_SYMBOLS and held[-1][0] != row[0]:
                out += solve()
                held, size = [], 0
            if held and held[-1][:4] == row[:4]:
                continue
            held.append(row)
            size += len(row[4]) // BLOCK + 1
        if out:
            yield arrow_batch(FOUND, *zip(*out, strict=True))
    if held and (out := solve()):
        yield arrow_batch(FOUND, *zip(*out, strict=True))


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of a piece by two hashes."""
    names = PIECE + ", at int, x long, y long"
    for batch in batches:
        out: list[tuple] = []
        for anchor, body, n, lead, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            view = memoryview(data)
            for at in range(n):
                value = xxhash.xxh3_128_intdigest(view[at : at + LENGTH])
                x, y = (int(v) - (1 << 64) if v >> 63 else int(v) for v in (value >> 64, value & ((1 << 64) - 1)))
                out.append((anchor, body, n, lead, at, x, y))
                if len(out) >= 1 << 16:
                    yield arrow_batch(names, *zip(*out, strict=True))
                    out = []
        if out:
            yield arrow_batch(names, *zip(*out, strict=True))


def _hot(data: DataFrame) -> DataFrame:
    """Partial repeats of the pieces of crowded anchors, counted string by string."""
    strings = stage(data.mapInArrow(_single, PIECE + ", at int, x long, y long"), "strings")
    twice = strings.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("x", "y")
    return strings.join(twice, ["x", "y"], "left_semi").select(
        *KEY, F.col("at").alias("low"), F.col("at").alias("high")
    )


def _rows(docs: DataFrame) -> DataFrame:
    return nonnull_text(docs).select(
        F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("tie"), "text"
    )


def repeats(docs: DataFrame) -> DataFrame:
    """doc, tie and the intervals (low, high) of starts of repeated strings."""
    spark: SparkSession = docs.sparkSession
    rows = _rows(docs)
    long_rows = rows.where(F.octet_length("text") >= LENGTH)
    places = stage(long_rows.mapInArrow(_places, PLACE), "places")
    counted = places.groupBy(*KEY).agg(F.count(F.lit(1)).alias("c"))
    counted = stage(counted, "counted")
    anchors = counted.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("kinds"), F.min("c").alias("least")
    )
    partial = anchors.where("kinds > 1 AND least = 1").select("anchor", "kinds")
    needed = stage(counted.join(partial, "anchor"), "needed")
    expected = needed.select("anchor").distinct().count()
    wanted = spark.sparkContext.broadcast(bit_filter(needed, "anchor", expected))
    data = long_rows.select("text").mapInArrow(_wanted(wanted), PIECE + ", data binary")
    data = stage(data.join(needed, KEY).select(*KEY, "kinds", "data"), "pieces")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_anchor = data.where(F.col("kinds") <= HOT_PIECES).select(*KEY, "data")
    by_anchor = by_anchor.repartition(n, "anchor").sortWithinPartitions(*KEY)
    some = by_anchor.mapInArrow(_sorted_groups, FOUND).unionAll(
        _hot(data.where(F.col("kinds") > HOT_PIECES).select(*KEY, "data"))
    )
    whole = counted.where("c > 1").select(*KEY, F.lit(0).alias("low"), (F.col("n") - 1).alias("high"))
    once = counted.where("c = 1").select(*KEY)
    found = whole.unionAll(some.join(once, KEY, "left_semi"))
    return places.join(found, KEY).select(
        "doc", "tie", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high")
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for doc, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = text.encode("utf-8")
            kept, at, removed, runs = [], 0, 0, 0
            for span in sorted((s["low"], s["high"] + LENGTH) for s in spans or []):
                low, high = max(span[0], at), span[1]
                if span[0] > at or not runs:
                    runs += 1
                    kept.append(data[at : span[0]])
                removed += max(0, high - low)
                at = max(at, high)
            kept.append(data[at:])
            out.append((doc, len(data), removed, runs, b"".join(kept)))
        yield arrow_batch("doc long, n_bytes long, n_removed long, n_spans long, kept binary", *zip(*out, strict=True))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, byte counts, removed runs and the kept bytes of every document."""
    spans = repeats(docs).groupBy("doc", "tie").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    spans = stage(spans, "spans").select(F.col("doc").alias("d"), F.col("tie").alias("t"), "spans")
    joined = _rows(docs).join(spans, F.col("doc").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")), "left")
    cut = joined.select("doc", "text", "spans").mapInArrow(
        _cut, "doc long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
    return cut.withColumnRenamed("doc", "doc_id")


def report(docs: DataFrame) -> DataFrame:
    """The digest columns and the share of the bytes that went (0 for an empty text)."""
    share = F.when(F.col("n_bytes") > 0, F.col("n_removed") / F.col("n_bytes")).otherwise(F.lit(0.0))
    return dedup(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), share.alias("removed_share")
    )
