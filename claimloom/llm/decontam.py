"""Benchmark decontamination by the q-gram lemma and banded alignment.

A document contains a benchmark item if some region of it is within
``edits = floor(error_rate * m)`` edits of the whole item of m code points (both
lower-cased, white space collapsed to single blanks).  By the q-gram lemma such a
region shares at least ``m - q + 1 - edits * q`` q-grams with the item, all of them
on diagonals (document position minus item position) that differ by at most
``edits``.  So the shared q-grams are counted in overlapping bands of diagonals,
each band twice as wide as the step between bands; bands that meet the bound are
retained, and only there a banded alignment computes the edit distance.

The benchmark is dealt in blocks of bounded size; every block meets every whole
document in one map over the documents, so nothing is shuffled.

Defined cases: null texts are empty; an item shorter than ``min_chars`` after
normalisation has to occur without any edit, one shorter than a q-gram is no evidence; equal items are both reported;
repeated document rows are each reported; an empty table on either side gives no
rows; other columns are ignored (``clean`` keeps them as they are).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Q = 10
ERROR_RATE = 0.08
MIN_CHARS = 40
BLOCK_CHARS = 1 << 22
SLICE = 1 << 22
FILTER_BITS = 22
SCHEMA = "doc_id long, item_id long, start long, length long, edits long"
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def grams(x: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit polynomial hash of every q-gram, from those of half its length."""
    n = len(x) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h, length = x.astype(np.uint64), 1
    for bit in bin(q)[3:]:
        h = h[:-length] * np.uint64(pow(int(_A), length, 1 << 64)) + h[length:]
        length *= 2
        if bit == "1":
            h = h[:-1] * _A + x[length : length + len(h) - 1]
            length += 1
    h ^= h >> np.uint64(31)
    h *= _B
    h ^= h >> np.uint64(29)
    return h


def budget(m: int, q: int, rate: float) -> tuple[int, int]:
    """Allowed edits and the shared q-grams they leave; fewer edits where none were left."""
    edits = min(int(rate * m), (m - q) // q)
    return edits, m - q + 1 - edits * q


class Index:
    """The q-grams of a block of items, sorted, with a bit filter in front."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float, min_chars: int):
        kept = [(i, points(t)) for i, t in items if len(t) >= q]
        self.q = q
        self.ids = [i for i, _ in kept]
        self.items = [x for _, x in kept]
        bounds = [budget(len(x), q, rate if len(x) >= max(min_chars, 2 * q) else 0) for x in self.items]
        self.edits = np.array([b[0] for b in bounds], dtype=np.int64)
        self.need = np.array([b[1] for b in bounds], dtype=np.int64)
        self.reach = max((len(x) for x in self.items), default=0) + int(self.edits.max(initial=0))
        made = [grams(x, q) for x in self.items] or [np.zeros(0, dtype=np.uint64)]
        keys = np.concatenate(made)
        item = np.repeat(np.arange(len(made)), [len(g) for g in made])
        at = np.concatenate([np.arange(len(g)) for g in made])
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.at = keys[order], item[order], at[order]
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[self.keys >> np.uint64(64 - FILTER_BITS)] = True

    def hits(self, x: np.ndarray):
        """(item, document position, item position) of every shared q-gram."""
        h = grams(x, self.q)
        where = np.flatnonzero(self.filter[h >> np.uint64(64 - FILTER_BITS)])
        low = np.searchsorted(self.keys, h[where], "left")
        count = np.searchsorted(self.keys, h[where], "right") - low
        where, low, count = where[count > 0], low[count > 0], count[count > 0]
        total = int(count.sum())
        entry = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(total)
        return self.item[entry], np.repeat(where, count), self.at[entry]

    def regions(self, x: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, lowest, highest diagonal) of the bands that meet the bound, merged."""
        item, i, j = self.hits(x)
        if not len(item):
            return []
        step = self.edits[item] + 1
        diagonal = i - j
        band = np.floor_divide(diagonal, step)
        base = int(band.min()) - 1
        span = int(band.max()) - base + 1
        key = item * span + (band - base)
        key, count = np.unique(np.concatenate((key, key - 1)), return_counts=True)
        owner, band = key // span, key % span + base
        kept = count >= self.need[owner]
        found: list[tuple[int, int, int]] = []
        for k, b in zip(owner[kept].tolist(), band[kept].tolist(), strict=True):
            width = int(self.edits[k]) + 1
            low, high = b * width, (b + 2) * width - 1
            if found and found[-1][0] == k and low <= found[-1][2] + 1:
                found[-1] = (k, found[-1][1], high)
            else:
                found.append((k, low, high))
        return found

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, start, length, edits): the best region of each retained band group."""
        found = []
        x = points(text)
        for at in range(0, max(len(x), 1), SLICE):
            part = x[at : at + SLICE + 2 * self.reach]
            for k, low, high in self.regions(part):
                best = align(part, self.items[k], low, high, int(self.edits[k]))
                if best is not None:
                    found.append((self.ids[k], at + best[0], best[1], best[2]))
        return sorted(set(found))


def align(x: np.ndarray, item: np.ndarray, low: int, high: int, edits: int):
    """Least edits between the item and any region of x with diagonals in the band.

    Row j of the table is the item's first j code points, column d the diagonal
    low - edits + d.  Returns (start, length, edits) or None if over the budget.
    A region equal to the item needs no table.
    """
    for d in range(max(low, 0), min(high, len(x) - len(item)) + 1):
        if x[d] == item[0] and np.array_equal(x[d : d + len(item)], item):
            return d, len(item), 0
    low, high = low - edits, high + edits
    width = high - low + 1
    far = 1 << 30
    column = np.arange(width)
    here = low + column
    cost = np.where((here >= 0) & (here <= len(x)), 0, far)
    start = here.copy()
    for j in range(1, len(item) + 1):
        i = here + j
        inside = (i >= 1) & (i <= len(x))
        same = np.zeros(width, dtype=bool)
        same[inside] = x[i[inside] - 1] == item[j - 1]
        across = np.where(inside, cost + ~same, far)
        down = np.append(cost[1:] + 1, far)
        new = np.minimum(across, down)
        begin = np.where(across <= down, start, np.append(start[1:], 0))
        run = np.minimum.accumulate(new - column)
        source = np.maximum.accumulate(np.where(new - column == run, column, 0))
        better = run + column < new
        new = np.where(better, run + column, new)
        start = np.where(better, begin[source], begin)
        cost = np.where((i >= 0) & (i <= len(x)), new, far)
    at = int(np.argmin(cost))
    if cost[at] > edits:
        return None
    return int(start[at]), int(here[at] + len(item) - start[at]), int(cost[at])


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The items, a bounded number of characters at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where(F.col("text").isNotNull())
    for item, text in rows.toLocalIterator():
        block.append((item, normal(text)))
        size += len(text)
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def _finder(block, q, rate, min_chars, tell):
    held: list[Index] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Index(block, q, rate, min_chars))
        for batch in batches:
            yield from tell(held[0], batch)

    return run


def _rows(index: Index, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    doc, found = [], []
    for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        for match in index.matches(normal(text.as_py())):
            doc.append(d)
            found.append(match)
    columns = [doc, *([f[k] for f in found] for k in range(4))]
    names = ["doc_id", "item_id", "start", "length", "edits"]
    yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=names)


def _kept(index: Index, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts = batch.column(batch.schema.names.index("text"))
    yield batch.filter(pa.array([not index.matches(normal(t.as_py())) for t in texts], type=pa.bool_()))


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    q: int = Q,
    error_rate: float = ERROR_RATE,
    min_chars: int = MIN_CHARS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Every benchmark item found in a document.

    ``start`` and ``length`` are code points of the normalised text.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for block in _blocks(benchmark, block_chars):
        part = texts.mapInArrow(_finder(block, q, error_rate, min_chars, _rows), SCHEMA)
        found = part if found is None else found.unionAll(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], T._parse_datatype_string(SCHEMA))
    return found


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    q: int = Q,
    error_rate: float = ERROR_RATE,
    min_chars: int = MIN_CHARS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The documents in which no benchmark item is found, with all their columns."""
    for block in _blocks(benchmark, block_chars):
        docs = docs.mapInArrow(_finder(block, q, error_rate, min_chars, _kept), docs.schema)
    return docs
