"""Plain versions of the operators, quadratic where that is simplest."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard_components(rows):
    """row number -> smallest doc_id reachable by links."""
    made = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(made):
        for j in range(i):
            b = made[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [doc if not made[i] else least.get(find(i)) for i, (doc, _) in enumerate(rows)]


def line_dedup(rows, width=3):
    """Kept lines of every (doc_id, text) row."""
    seen, gone = set(), {}
    for doc, text in sorted(set((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = text.split("\n")
        for at in range(len(lines) - width + 1):
            window = tuple(lines[at : at + width])
            if not "".join(window).strip(" "):
                continue
            if window in seen:
                gone.setdefault((doc, text), set()).update(range(at, at + width))
            seen.add(window)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        cut = gone.get((doc, text or ""), set())
        out.append([x for i, x in enumerate(lines) if i not in cut])
    return out


def substring_dedup(texts, length=400):
    """(bytes, removed, runs, kept) of every text."""
    data = [(t or "").encode() for t in texts]
    times = {}
    for b in data:
        for x in range(len(b) - length + 1):
            times[b[x : x + length]] = times.get(b[x : x + length], 0) + 1
    out = []
    for b in data:
        covered = [False] * len(b)
        for x in range(len(b) - length + 1):
            if times[b[x : x + length]] > 1:
                covered[x : x + length] = [True] * length
        runs = sum(c and (i == 0 or not covered[i - 1]) for i, c in enumerate(covered))
        kept = bytes(v for v, c in zip(b, covered, strict=True) if not c)
        out.append((len(b), sum(covered), runs, kept))
    return out


def least_edits(item, text):
    """Edits between the item and the nearest substring of the text."""
    row = [0] * (len(text) + 1)
    for j, c in enumerate(item, 1):
        new = [j]
        for i, d in enumerate(text, 1):
            new.append(min(row[i - 1] + (c != d), row[i] + 1, new[i - 1] + 1))
        row = new
    return min(row)
