"""Cost-balanced packing of tokenised documents into fixed-size sequences.

A document is tokenised, ends with one separator id and is cut into pieces.
Full-length pieces are sequences of their own.  The rest of a block of documents
goes, in descending order of cost, to the sequence with the lowest cost so far
that still has room for it; a piece that fits nowhere is cut over the cheapest
sequences.  The cost of a piece of n ids is ``linear * n + quadratic * n * n``,
the second term standing for attention inside the piece.

The room of a block equals its ids: as many full sequences as they fill, and the
remainder in sequences whose sizes are powers of two.  So no sequence is padded.

A block is a bounded number of ids inside one task, so nothing is shuffled, memory
does not depend on the size of a partition, and a lost task is redone by itself.
Sequence ids are (partition, running number): unique, gaps between partitions.

Defined cases: a null text is an empty one; an empty text is its separator alone;
repeated rows are separate documents; a null doc_id stays null; an empty table
gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import nonnull_text

MAX_LENGTH = 2048
SEPARATOR = 1
BLOCK_IDS = 1 << 20
CACHED_WORDS = 400_000
SPECIAL = "<|endoftext|>"
SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long"
)


def little(ids: list[int]) -> bytes:
    """Unsigned 32-bit, little-endian."""
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


class Odd(Exception):
    """A word that starts with white space or is empty: its bounds are not a token's."""


class Words(dict):
    """Ids of words that follow a single blank, encoded once and then looked up."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace():
            raise Odd
        found = self.encode(" " + word)
        if len(word) <= 64 and len(self) < CACHED_WORDS:
            self[word] = found
        return found


class Ids:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    A blank that is followed by no white space always starts a token of the
    byte-level vocabulary, so words are encoded once and looked up after that.
    Texts with other runs of white space are encoded as a whole, and texts with a
    control string of the vocabulary by its own tokenizer.
    """

    def __init__(self, vocabulary: str, ranks: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.words = tiktoken.Encoding(
            "words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
        )
        self.vocabulary, self.whole = vocabulary, None
        self.cache = Words(self.plain)

    def plain(self, text: str) -> bytes:
        return little(self.words.encode_ordinary(text))

    def special(self, text: str) -> bytes:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.vocabulary)
        return little(self.whole.encode(text, add_special_tokens=False).ids)

    def of(self, text: str) -> bytes:
        if SPECIAL in text:
            return self.special(text)
        first, *rest = text.split(" ")
        try:
            return self.plain(first) + b"".join(map(self.cache.__getitem__, rest))
        except Odd:
            return self.plain(text)


_LOADED: dict[tuple[str, str], Ids] = {}


def _ids(vocabulary: str, ranks: str) -> Ids:
    key = (vocabulary, ranks)
    if key not in _LOADED:
        _LOADED[key] = Ids(*key)
    return _LOADED[key]


def sequence_sizes(total: int, size: int) -> list[int]:
    """Full sequences, then powers of two that add up to what is left."""
    left = total % size
    return [size] * (total // size) + [1 << b for b in range(left.bit_length()) if left >> b & 1]


def place(lengths: list[int], size: int, linear: float, quadratic: float):
    """(item, start in item, length, sequence, offset) for every piece.

    Items go in descending cost to the cheapest sequence that has room for all of
    the item; if none has, its first part fills the cheapest one with any room.
    Ties go to the earlier item and the earlier sequence.
    """
    room = np.array(sequence_sizes(sum(lengths), size), dtype=np.int64)
    used = np.zeros(len(room), dtype=np.int64)
    cost = np.zeros(len(room))
    pieces = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[item]
        while left:
            fits = room >= left
            if not fits.any():
                fits = room > 0
            at = int(np.argmin(np.where(fits, cost, np.inf)))
            n = min(left, int(room[at]))
            pieces.append((item, start, n, at, int(used[at])))
            room[at] -= n
            used[at] += n
            cost[at] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return pieces


def _pack(vocabulary, ranks, size, separator, block, linear, quadratic):
    end = np.array([separator], dtype="<u4").tobytes()
    width = 4 * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(vocabulary, ranks)
        context = TaskContext.get()
        next_id = (context.partitionId() if context else 0) << 40
        out: list[list] = [[] for _ in range(7)]
        rest: list[tuple] = []
        held = written = 0

        def add(doc, start, data, total, sequence, offset):
            for column, value in zip(
                out, (doc, start, len(data) // 4, data, total, sequence, offset), strict=True
            ):
                column.append(value)

        def flush_rest():
            nonlocal next_id, rest, held
            lengths = [len(x[2]) // 4 for x in rest]
            for item, start, n, at, offset in place(lengths, size, linear, quadratic):
                doc, before, data, total = rest[item]
                add(doc, before + start, data[4 * start : 4 * (start + n)], total, next_id + at, offset)
            next_id += len(sequence_sizes(sum(lengths), size))
            rest, held = [], 0

        def batch():
            nonlocal out, written
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()] + [pa.int64()] * 3
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            made = pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(out, kinds, strict=True)], names=names
            )
            out, written = [[] for _ in range(7)], 0
            return made

        for rows in batches:
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                data = ids.of(text.as_py()) + end
                total, full = len(data) // 4, len(data) // width
                for k in range(full):
                    add(doc, k * size, data[k * width : (k + 1) * width], total, next_id, 0)
                    next_id += 1
                    written += size
                    if written >= block:
                        yield batch()
                if len(data) > full * width:
                    rest.append((doc, full * size, data[full * width :], total))
                    held += total - full * size
                if held >= block:
                    flush_rest()
                    yield batch()
        flush_rest()
        if out[0]:
            yield batch()

    return run


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    ranks: str | None = None,
    size: int = MAX_LENGTH,
    separator: int = SEPARATOR,
    block: int = BLOCK_IDS,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
) -> DataFrame:
    """One row per piece: its place in the document, its ids, its place in a sequence.

    ``vocabulary`` is a tokenizers file and ``ranks`` the same vocabulary as ranks;
    both lie at the same path on every executor.
    """
    import public_tokenizers

    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    run = _pack(str(vocabulary), str(ranks), size, separator, block, linear, quadratic)
    rows = nonnull_text(docs).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, SCHEMA)


def pieces(docs: DataFrame, **options) -> DataFrame:
    """The pieces with the checksum of their ids instead of the ids."""
    packed = pack(docs, **options)
    return packed.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
