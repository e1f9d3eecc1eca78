"""Spans made in Arrow batches against plain loops, and queries that derive them once."""

import math
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from claimloom.functions.constants import CLAIM_TYPES, OTHER_CLAIM, RARE_TYPES
from claimloom.plans import span_arrays as sa
from claimloom.plans.catalog import QUERIES

BLANKS = [" ", "  ", *map(chr, (0x09, 0x0A, 0x0B, 0x1C, 0x1F, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x205F, 0x3000))]
LETTERS = [*"abcdefgh", *map(chr, (0xC5, 0xE9, 0x6F22, 0x1F600, 0x200B, 0xFEFF, 0x2010, 0x3001))]


def text_of(rng, n):
    word = lambda: "".join(rng.choices(LETTERS, k=rng.choice([1, 2, 4, 8, 8, 9, 10, 11, 12, 15]))) + rng.choice(["", "", ".", ",", "!"])
    return "".join(rng.choice(BLANKS) + word() for _ in range(n)) + rng.choice(["", "\u3000"])


def messages(n=120, seed=4):
    rng = random.Random(seed)
    made = [(rng.choice([i, -i, 10**12 + i]), text_of(rng, rng.randrange(30)), rng.choice(["ham", "smish", None])) for i in range(n)]
    return [*made, (None, text_of(rng, 20), None), (5, None, None), (6, "", None), (7, " \x85", "ham"), (8, text_of(rng, 400), "smish")]


def rem(a, b):
    return int(math.fmod(a, b)) if abs(a) < 2**50 else a % b


def named(k, final=False):
    kind = None if k is None or k < 0 else CLAIM_TYPES[k]
    return OTHER_CLAIM if final and kind in RARE_TYPES else kind


def expected(doc, text, label):
    words, at = [], 0
    for w in (text or "").split():
        at = text.index(w, at)
        words.append((at, at + len(w)))
        at += len(w)
    raw, pred = [], []
    for i, (s, e) in enumerate(words):
        n = e - s
        to = None if doc is None else i + rem(doc + i, 3)
        end = words[to][1] if to is not None and 0 <= to < len(words) else e
        base = None if doc is None else rem(doc * 7 + i * 13, 12)
        if n >= 8:
            raw.append((s, end, named(base), text[s : max(s, end)], i, n))
        if (n >= 9 and n != 11 and label != "ham") or (n == 8 and text[e - 1] in ".,"):
            h = 0 if n == 8 else None if doc is None else rem(doc * 5 + i * 11, 10)
            k = None if doc is None else rem(doc + i, 12) if n == 8 else rem(base + 1, 12) if h == 1 else base
            a = min(s + 2, end - 1) if h == 2 else s
            b = max(end - 1, s + 1) if h == 3 else end
            pred.append((a, b, named(k, True), text[a : max(a, b)], None if doc is None else rem(doc * 37 + i * 101, 1000) / 1000))
    gold = [] if label == "ham" else [x for x in raw if x[5] >= 9]
    pieces = [(s + j, min(s + j + 4, e)) for s, e in words for j in range(0, e - s, 4)]
    offsets = None if text is None else [(0, 0), *pieces, (len(text) + 5, len(text) + 6), (0, 0)]
    return raw, gold, [(s, e, OTHER_CLAIM if t in RARE_TYPES else t, x) for s, e, t, x, *_ in gold], sorted(pred, key=lambda p: (p[0], p[1], p[2] or "", p[4] or 0)), offsets


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_arrays_equal_plain_loops(most, monkeypatch):
    monkeypatch.setattr(sa, "CHUNK_BYTES", most)
    rows = messages()
    whole = pa.record_batch({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows]), "label": pa.array([r[2] for r in rows], pa.string())})
    got = []
    for batch in (whole.slice(0, 50), whole.slice(50, 0), whole.slice(50)):
        for part in sa.chunks(batch):
            made = [getattr(sa.Chunk(part), k)().to_pylist() for k in ("raw", "gold", "gt", "pred", "offsets")]
            got += zip(*made, strict=True)
    plain = [tuple(None if xs is None else [tuple(x.values()) for x in xs] for xs in row) for row in got]
    assert plain == [expected(*r) for r in rows]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """documents and labels of own rows, with two copies of one message."""
    rng, folder = random.Random(9), tmp_path_factory.mktemp("tables")
    ids = [*range(80), 7]
    texts = [text_of(rng, rng.randrange(60)) for _ in ids]
    plain = {"lang": ["en"] * len(ids), "source": ["s"] * len(ids), "n_chars": [len(t) for t in texts]}
    pq.write_table(pa.table({"doc_id": ids, "text": texts, **plain}), folder / "documents.parquet")
    marked = range(0, 80, 3)
    pq.write_table(pa.table({"doc_id": [*marked], "quality": [i % 2 for i in marked], "toxic": [i // 3 % 2 for i in marked]}), folder / "labels.parquet")
    return str(folder)


def derived(df):
    """Whether a query still has to derive spans from the documents."""
    return any("documents.parquet" in f for f in df.inputFiles())


def test_predicted_and_gold_spans_are_derived_once(spark, tables):
    flat = QUERIES["pred_gt_overlap_flat"](spark, tables).where("message_id <> '7'")
    assert not derived(flat)
    arrays = QUERIES["pred_gt_overlap"](spark, tables).where("message_id <> '7'")
    assert flat.columns == arrays.columns and flat.count() > 100
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, arrays.collect()))


def test_raw_spans_are_derived_once(spark, tables):
    flat = QUERIES["span_overlap_flat"](spark, tables).where("message_id <> '7'")
    assert not derived(flat)
    arrays = QUERIES["span_overlap_pairs"](spark, tables).where("message_id <> '7'")
    assert flat.columns == arrays.columns and flat.count() > 100
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, arrays.collect()))
