"""Suffix arrays by linear grouping: no recursion, no renaming.

Suffixes are grouped by a Lyndon word they start with, at first their first symbol.
Groups are taken in descending order.  Each suffix of a group points to the nearest
suffix on its left that lies in a lower group; those pointed to, extended by the
group's word as often as they are pointed to, move to new groups right above
their old ones.  In the end every group holds the suffixes with the same longest Lyndon
prefix.  The order inside the groups is then emitted from the left: after a suffix
come, each in its group's next place, the suffixes that end their Lyndon prefix
where it starts, which the pointers list.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: list[int] | np.ndarray) -> list[int]:
    """The order of the suffixes; the last symbol must be the one smallest symbol."""
    symbols = np.asarray(text)
    n = len(symbols)
    if n < 2:
        return list(range(n))
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    first = np.r_[True, ranked[1:] != ranked[:-1]]
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    group = np.empty(n, dtype=np.int64)
    group[order] = starts
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    back, size = _grouped(order.tolist(), place.tolist(), group.tolist(), np.bincount(starts, minlength=n).tolist())
    return _emitted(back, size, n)


def _grouped(sa: list[int], place: list[int], group: list[int], size: list[int]):
    """Pointer and final group start of every suffix."""
    n = len(sa)
    back = [-1] * n
    top = n
    while top > 0:
        start = group[sa[top - 1]]
        members = sa[start:top]
        if len(members) > 1:
            members.sort()
        times: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = back[p]
            back[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        top = start
        if not times:
            continue
        levels: dict[int, list[int]] = {}
        for p, k in times.items():
            levels.setdefault(k, []).append(p)
        for k in sorted(levels, reverse=True):
            moved: dict[int, int] = {}
            for p in levels[k]:
                g = group[p]
                end = g + size[g] - 1
                size[g] -= 1
                moved[g] = moved.get(g, 0) + 1
                q, at = sa[end], place[p]
                sa[at], sa[end] = q, p
                place[q], place[p] = at, end
            for g, m in moved.items():
                fresh = g + size[g]
                if fresh != g:
                    size[fresh] = m
                    for i in range(fresh, fresh + m):
                        group[sa[i]] = fresh
                else:
                    size[g] = m
    return back, group


def _emitted(back: list[int], group: list[int], n: int) -> list[int]:
    out = [-1] * n
    placed = bytearray(n)
    free = list(range(n))
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = back[s]
    return out


def common_prefixes(text: list[int], sa: list[int]) -> list[int]:
    """Symbols that each suffix shares with the one before it in the order."""
    n = len(sa)
    before = [-1] * n
    for a, b in zip(sa, sa[1:], strict=False):
        before[b] = a
    shared = [0] * n
    h = 0
    for i in range(n):
        j = before[i]
        if j < 0:
            h = 0
            continue
        while i + h < n and j + h < n and text[i + h] == text[j + h]:
            h += 1
        shared[i] = h
        if h:
            h -= 1
    return [shared[i] for i in sa]
