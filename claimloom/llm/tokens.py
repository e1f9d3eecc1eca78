"""Tokens of many texts at once: runs of chosen bytes as 64-bit hashes, ASCII letters lower-cased.

Two different tokens of a table with n distinct ones are taken for equal with odds of
about n * n / 2**65, 4e-7 for four million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .shingles import mix

GROUP_BYTES = 1 << 20
SLICE_BYTES = 1 << 22
_STEP = 0x9E3779B97F4A7C15


def _numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_STEP) + np.uint64(seed))


_BYTE = _numbers(256, 11)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = _numbers(1 << 16, 12) | np.uint64(1)


def byte_set(outside: list[int]) -> np.ndarray:
    """Marks the bytes that tokens are made of: all but those given; a line feed must be outside."""
    made = np.ones(256, dtype=bool)
    made[outside] = False
    return made


#: Words: anything but the blank and 0x09-0x0D.
WORDS = byte_set([0x20, *range(0x09, 0x0E)])
#: Terms: ASCII letters and digits, and whatever is not ASCII.
TERMS = byte_set([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def _slices(text: bytes, inside: np.ndarray) -> Iterator[bytes]:
    """A text in parts that end between tokens, so a very long one is held in parts."""
    at = 0
    while len(text) - at > SLICE_BYTES:
        end = at + SLICE_BYTES
        while end < len(text) and inside[text[end]]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def groups(texts: list[bytes | None], inside: np.ndarray) -> Iterator[tuple[list[int], list[bytes]]]:
    """Numbers of texts and their parts, about a megabyte at a time, in order."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        for part in _slices(text or b"", inside):
            if parts and size + len(part) > GROUP_BYTES:
                yield rows, parts
                rows, parts, size = [], [], 0
            rows.append(row)
            parts.append(part)
            size += len(part)
    if parts:
        yield rows, parts


def hashed(parts: list[bytes], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens in order: part number, hash, last byte and last but one (0 if none)."""
    raw = np.frombuffer(b"\n".join(parts), dtype=np.uint8)
    mask = inside[raw]
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint8), none.astype(np.uint8)
    length = end - start
    first = np.cumsum(length) - length
    at = np.flatnonzero(mask)
    place = np.arange(len(at)) - np.repeat(first, length)
    values = _BYTE[raw[at]] * _PLACE[place & 0xFFFF]
    sums = mix(np.add.reduceat(values, first) + length.astype(np.uint64))
    ends = np.cumsum([len(p) + 1 for p in parts])
    part = np.searchsorted(ends, start, side="right")
    return part, sums, raw[end - 1], np.where(length > 1, raw[np.maximum(end - 2, 0)], 0).astype(np.uint8)


class Lookup:
    """Positions of 64-bit keys in a sorted array by their leading bits; -1 for absent keys."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = min(max(int(len(keys)).bit_length() + 2, 4), 22)
        cells = keys >> np.uint64(64 - self.bits)
        self.first = np.searchsorted(cells, np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        found = np.full(len(wanted), -1, dtype=np.int32)
        cell = (wanted >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[cell], self.first[cell + 1]
        left = np.flatnonzero(at < end)
        at, end, wanted = at[left], end[left], wanted[left]
        while len(left):
            hit = self.keys[at] == wanted
            found[left[hit]] = at[hit]
            at = at + 1
            more = ~hit & (at < end)
            left, at, end, wanted = left[more], at[more], end[more], wanted[more]
        return found
