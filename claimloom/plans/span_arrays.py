"""The spans of ``views`` for whole Arrow batches.

The rules are those of the span views in ``views.SQL``: a word is what lies between white
space, spans begin at long words and reach over one to three words.  A batch is taken
CHUNK_BYTES of text at a time; words are found on its bytes, positions count code points,
so the cost follows the length of the texts alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.constants import CLAIM_TYPES, OTHER_CLAIM, RARE_TYPES
from ..session import reach
from ..sources.ranges import bytes_of

CHUNK_BYTES = 1 << 20
SPAN = "struct<start:int,end:int,claim_type:string,text:string,idx:int,wl:int>"
KINDS = {
    "gold": f"array<{SPAN}>",
    "raw": f"array<{SPAN}>",
    "gt": "array<struct<start:int,end:int,claim_type:string,text:string>>",
    "pred": "array<struct<start:int,end:int,claim_type:string,text:string,confidence:double>>",
    "offsets": "array<struct<start:int,end:int>>",
}

NAMES = pa.array([*CLAIM_TYPES], pa.string())
COLLAPSED = pa.array([OTHER_CLAIM if t in RARE_TYPES else t for t in CLAIM_TYPES], pa.string())
#: The place of each collapsed name in text order.
RANK = np.searchsorted(np.unique(COLLAPSED.to_pylist()), COLLAPSED.to_pylist())

_BLANK = np.zeros(256, bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: White space beyond ASCII: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _blank(data: np.ndarray) -> np.ndarray:
    found = _BLANK[data]
    for seq in _WIDE:
        at = np.flatnonzero(data[: len(data) - len(seq) + 1] == seq[0]) if len(data) >= len(seq) else np.zeros(0, int)
        for k, b in enumerate(seq[1:], 1):
            at = at[data[at + k] == b]
        for k in range(len(seq)):
            found[at + k] = True
    return found


class Chunk:
    """Words of some rows: row, idx, start, end, wl, and the first and last byte."""

    def __init__(self, batch: pa.RecordBatch):
        doc, label = batch.column("doc_id"), batch.column("label")
        self.batch, self.n = batch, batch.num_rows
        self.data, self.at = bytes_of(batch.column("text"))
        data, at = self.data, self.at
        lead = (data & 0xC0) != 0x80
        before = np.concatenate(([0], np.cumsum(lead)))
        #: byte of every code point, and one past the last
        self.byte = np.append(np.flatnonzero(lead), len(data))
        self.base = before[at[:-1]]
        self.length = before[at[1:]] - self.base
        solid = ~_blank(data)
        opens, closes = solid.copy(), solid.copy()
        opens[1:] &= ~solid[:-1]
        closes[:-1] &= ~solid[1:]
        edge = at[(at > 0) & (at < len(data))]
        opens[edge], closes[edge - 1] = solid[edge], solid[edge - 1]
        first, last = np.flatnonzero(opens), np.flatnonzero(closes)
        self.first_of = np.searchsorted(first, at)
        self.words = np.diff(self.first_of)
        self.row = np.repeat(np.arange(self.n), self.words)
        self.idx = np.arange(len(first)) - self.first_of[self.row]
        self.start = before[first] - self.base[self.row]
        self.end = before[last + 1] - self.base[self.row]
        self.wl = self.end - self.start
        self.stop = np.isin(data[last], np.frombuffer(b".,", np.uint8))
        self.doc = doc.fill_null(0).to_numpy().astype(np.int64)
        self.known = doc.is_valid().to_numpy(zero_copy_only=False)
        self.ham = np.array([x == "ham" for x in label.to_pylist()], bool)

    def span(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the spans that begin at the words ``w``."""
        row = self.row[w]
        to = self.idx[w] + np.fmod(self.doc[row] + self.idx[w], 3)
        inside = self.known[row] & (to >= 0) & (to < self.words[row])
        return self.start[w], self.end[np.where(inside, self.first_of[row] + to, w)]

    def kind(self, w: np.ndarray) -> np.ndarray:
        return np.fmod(self.doc[self.row[w]] * 7 + self.idx[w] * 13, 12)

    def named(self, w: np.ndarray, kind: np.ndarray, names: pa.Array) -> pa.Array:
        none = (kind < 0) | ~self.known[self.row[w]]
        return names.take(pa.array(np.where(none, 0, kind), mask=none))

    def cut(self, w: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
        """The texts from start to end; '' for an end before the start."""
        base, most = self.base[self.row[w]], self.length[self.row[w]]
        a = self.byte[base + np.clip(start, 0, most)]
        size = np.maximum(self.byte[base + np.clip(end, 0, most)] - a, 0)
        ends = np.concatenate(([0], np.cumsum(size)))
        taken = self.data[np.arange(ends[-1]) + np.repeat(a - ends[:-1], size)]
        return pa.StringArray.from_buffers(len(w), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(taken)))

    def listed(self, row: np.ndarray, **fields: np.ndarray | pa.Array) -> pa.Array:
        """One list a row of the structs whose rows are given in order."""
        made = [x if isinstance(x, pa.Array) else pa.array(x.astype(np.int32)) for x in fields.values()]
        ends = np.searchsorted(row, np.arange(self.n + 1))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(made, names=[*fields]))

    def _spans(self, keep: np.ndarray, names: pa.Array, full: bool) -> pa.Array:
        w = np.flatnonzero(keep)
        start, end = self.span(w)
        more = {"idx": self.idx[w], "wl": self.wl[w]} if full else {}
        return self.listed(self.row[w], start=start, end=end, claim_type=self.named(w, self.kind(w), names), text=self.cut(w, start, end), **more)

    def gold(self) -> pa.Array:
        return self._spans((self.wl >= 9) & ~self.ham[self.row], NAMES, True)

    def gt(self) -> pa.Array:
        return self._spans((self.wl >= 9) & ~self.ham[self.row], COLLAPSED, False)

    def raw(self) -> pa.Array:
        return self._spans(self.wl >= 8, NAMES, True)

    def pred(self) -> pa.Array:
        w = np.flatnonzero(((self.wl >= 9) & (self.wl != 11) & ~self.ham[self.row]) | ((self.wl == 8) & self.stop))
        row, idx, short = self.row[w], self.idx[w], self.wl[w] == 8
        doc, known = self.doc[row], self.known[row]
        noise = np.where(short, 0, np.where(known, np.fmod(doc * 5 + idx * 11, 10), -1))
        base = self.kind(w)
        kind = np.where(short, np.fmod(doc + idx, 12), np.where(noise == 1, np.fmod(base + 1, 12), base))
        s, e = self.span(w)
        start = np.where(noise == 2, np.minimum(s + 2, e - 1), s)
        end = np.where(noise == 3, np.maximum(e - 1, s + 1), e)
        share = np.fmod(doc * 37 + idx * 101, 1000)
        none = (kind < 0) | ~known
        order = np.lexsort((np.where(known, share, -1000), np.where(none, -1, RANK[np.where(none, 0, kind)]), end, start, row))
        w, start, end, kind = w[order], start[order], end[order], kind[order]
        confidence = pa.array(share[order] / 1000.0, mask=~known[order])
        return self.listed(row[order], start=start, end=end, claim_type=self.named(w, kind, COLLAPSED), text=self.cut(w, start, end), confidence=confidence)

    def offsets(self) -> pa.Array:
        """Pieces of at most four letters per word, between special tokens, and one token past the end of the text."""
        n = (self.wl - 1) // 4 + 1
        w = np.repeat(np.arange(len(n)), n)
        j = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
        a = self.start[w] + j * 4
        b = np.minimum(a + 4, self.end[w])
        zero, rows = np.zeros(self.n, np.int64), np.arange(self.n)
        row = np.concatenate((rows, self.row[w], rows, rows))
        order = np.argsort(row, kind="stable")
        start = np.concatenate((zero, a, self.length + 5, zero))[order]
        end = np.concatenate((zero, b, self.length + 6, zero))[order]
        made = self.listed(row[order], start=start, end=end)
        gone = self.batch.column("text").is_null()
        return made.take(pa.array(rows, mask=gone.to_numpy(zero_copy_only=False))) if gone.true_count else made


def chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in order with about CHUNK_BYTES of text, one at least."""
    _, at = bytes_of(batch.column("text"))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(at, at[a] + CHUNK_BYTES, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def with_arrays(rows: DataFrame, *keep: str, **kinds: str) -> DataFrame:
    """Rows (doc_id, text, label and ``keep``) with the arrays asked for: name=kind, a key of KINDS."""
    reach(rows.sparkSession)
    fields = [*keep, *kinds]
    needed = dict.fromkeys([*keep, "doc_id", "text", "label"])
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    schema += "".join(f", `{name}` {KINDS[kind]}" for name, kind in kinds.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                made = Chunk(part)
                columns = [part.column(c) for c in keep] + [getattr(made, kind)() for kind in kinds.values()]
                yield pa.RecordBatch.from_arrays(columns, names=fields)

    return rows.select(*needed).mapInArrow(run, schema)
