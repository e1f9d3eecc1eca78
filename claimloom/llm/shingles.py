"""Sets of word shingles as sorted 64-bit hashes, computed for many texts at once.

Words are runs of bytes other than blank and 0x09-0x0D, after A-Z became a-z.  A
shingle is five words in a row; a text with fewer words is one shingle.  Words and
shingles are hashed to 64 bits, so two different shingles of one pair of texts are taken
for equal with odds below 1e-8 even for texts of a million words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

K = 5
GROUP_BYTES = 1 << 20
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def _numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_STEP) + np.uint64(seed))


_BYTE = _numbers(256, 1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_SPACE] = 0
_PLACE = _numbers(1 << 16, 2) | np.uint64(1)
_WORD = _numbers(K, 3) | np.uint64(1)


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word."""
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, np.zeros(0, dtype=np.uint64)
    inside = np.arange(len(raw)) - np.repeat(start, np.diff(np.append(start, len(raw))))[: len(raw)] if start[0] == 0 else None
    if inside is None:
        inside = np.zeros(len(raw), dtype=np.int64)
        inside[start[0] :] = np.arange(start[0], len(raw)) - np.repeat(start, np.diff(np.append(start, len(raw))))
    terms = _BYTE[raw] * _PLACE[inside & 0xFFFF]
    return start, mix(np.add.reduceat(terms, start) + (end - start).astype(np.uint64))


def _group(texts: list[bytes]) -> list[np.ndarray]:
    raw = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    if not len(raw):
        return [np.zeros(0, dtype=np.uint64) for _ in texts]
    start, word = _word_hashes(raw)
    ends = np.cumsum([len(t) + 1 for t in texts])
    first = np.searchsorted(start, np.r_[0, ends[:-1]])
    last = np.searchsorted(start, ends)
    runs = np.zeros(max(len(word) - K + 1, 0), dtype=np.uint64)
    for j in range(K):
        runs += word[j : len(word) - K + 1 + j] * _WORD[j]
    runs = mix(runs)
    made = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= K:
            one = np.sort(runs[a : b - K + 1])
            keep = np.ones(len(one), dtype=bool)
            np.not_equal(one[1:], one[:-1], out=keep[1:])
            made.append(one[keep])
        elif b > a:
            made.append(mix(np.array([(word[a:b] * _WORD[: b - a]).sum() + np.uint64(b - a)], dtype=np.uint64)))
        else:
            made.append(np.zeros(0, dtype=np.uint64))
    return made


def sets(texts: Iterator[str | None]) -> Iterator[np.ndarray]:
    """The shingle set of every text in order, as sorted hashes; empty without words."""
    held, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "replace")
        if held and size + len(raw) > GROUP_BYTES:
            yield from _group(held)
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield from _group(held)
