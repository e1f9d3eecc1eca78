"""Language model, ranked search and vector codes against plain versions and their defined cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from claimloom.llm import codes, lm, ranked
from claimloom.llm.common import reach
from claimloom.llm.tokens import TERMS, WORDS, Lookup, groups, hashed

CLASHES = "row, hash, cls, times, block, bundle, terms, docs, sums, w, top, owner, units, rare, n".split(", ")


def frame(spark, rows, key="doc_id", parts=3):
    reach(spark)
    schema = f"{key} long, text string, " + ", ".join(f"{c} string" for c in CLASHES)
    made = spark.createDataFrame([(d, t, *["x"] * len(CLASHES)) for d, t in rows], schema)
    return made.repartition(parts) if rows else made


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# tokens


@pytest.mark.parametrize(
    ("inside", "pattern"),
    [(WORDS, r"[^\x20\x09-\x0D]+"), (TERMS, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")],
)
def test_tokens_are_the_pattern_matches(inside, pattern):
    texts = ["", None, "A b\tc", "é-Ünd x1_2\n\n", "\x00\x7f|", "中文 字", "last"]
    raw = [t.encode() if t is not None else None for t in texts]
    found = {}
    for rows, parts in groups(raw, inside):
        part, keys, _, _ = hashed(parts, inside)
        for p, k in zip(part, keys, strict=True):
            found.setdefault(rows[p], []).append(int(k))
    words = {i: re.findall(pattern, lowered(t)) for i, t in enumerate(texts)}
    assert {i: len(w) for i, w in words.items() if w} == {i: len(k) for i, k in found.items()}
    names = {}
    for i, keys in found.items():
        for word, key in zip(words[i], keys, strict=True):
            assert names.setdefault(key, word) == word
    assert len(names) == len({w for ws in words.values() for w in ws})


def test_a_text_over_the_slice_size_keeps_its_tokens():
    text = b" ".join(b"word%d" % (i % 1000) for i in range(900_000))
    assert len(text) > 1 << 22
    total, distinct = 0, set()
    for _, parts in groups([text], WORDS):
        _, keys, _, _ = hashed(parts, WORDS)
        total += len(keys)
        distinct |= set(keys.tolist())
    assert (total, len(distinct)) == (900_000, 1000)


def test_lookup_finds_exactly_the_keys():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    wanted = np.concatenate((keys[::3], keys[::5] + np.uint64(1), np.array([0, (1 << 64) - 1], dtype=np.uint64)))
    where = {int(k): i for i, k in enumerate(keys)}
    assert Lookup(keys)(wanted).tolist() == [where.get(int(w), -1) for w in wanted]
    assert Lookup(keys[:0])(wanted).tolist() == [-1] * len(wanted)


# language model


@pytest.fixture(scope="module")
def sentences():
    """Texts in which a word tells the next one; empty, null and repeated rows, a null id."""
    rng = random.Random(2)
    after = {f"w{i}": [f"w{(7 * i + j) % 40}" for j in range(2)] for i in range(40)}
    rows = [(None, "w1 w7"), (1000, None), (1001, ""), (1002, "\t "), (1003, "W1 W7 w9"), (1003, "W1 W7 w9")]
    for i in range(260):
        word, text = f"w{rng.randrange(40)}", []
        for _ in range(rng.randrange(5, 200)):
            word = rng.choice(after[word])
            text.append(word)
        if i % 10 == 0:
            text.append(f"only{i}")
        rows.append((i, " ".join(text)))
    return rows


def test_language_model_fields_and_base_scores(spark, sentences):
    got = lm.report(frame(spark, sentences)).collect()
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2 for d, _ in sentences]
    words = [re.findall(r"[^\x20\x09-\x0D]+", lowered(t)) + [None] for _, t in sentences]
    counts = {}
    for out, ws in zip(held, words, strict=True):
        for w in ws if not out else []:
            counts[w] = counts.get(w, 0) + 1
    total, kinds = sum(counts.values()), len(counts)
    plain = sorted(
        (-1 if d is None else d, out, len(ws), sum(w in counts for w in ws), total,
         round(sum(math.log10((counts.get(w, 0) + 1) / (total + kinds + 1)) for w in ws), 6))
        for (d, _), out, ws in zip(sentences, held, words, strict=True)
    )
    assert plain == sorted(
        (-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got
    )
    far = [r for r in got if r.held_out and r.n_tokens > 20]
    assert far and sum(r.score for r in far) > sum(r.base_score for r in far)
    assert len({r.score for r in got if r.doc_id == 1003}) == 1
    assert {r.score for r in got if r.doc_id in (1000, 1001, 1002)} == {r.score for r in got if r.doc_id == 1000}


def test_probabilities_sum_to_one(spark, sentences):
    rows = lm.parted(frame(spark, sentences))
    vocab = lm.vocabulary(rows)
    model = lm.train(lm.encode(rows, vocab), vocab)
    one, two = np.array([lm.UNITS, 3, 5]), np.array([lm.UNITS, lm.UNITS, 4])
    hidden = model.context[one] @ model.place[: lm.WIDTH] + model.context[two] @ model.place[lm.WIDTH :]
    logits = (hidden @ model.target.T + model.bias).astype(np.float64)
    assert np.allclose(np.exp(logits - model.log_sums(one, two)[:, None]).sum(1), 1, atol=1e-4)
    times = np.concatenate((vocab.times[vocab.unit == 0], [r.times for r in vocab.counts.collect()]))
    known = sum(times - vocab.discount) if len(times) else 0
    freed = sum(10 ** lm._freed(vocab, c) for c in range(lm.CLASSES) if vocab.class_words[c])
    assert known + freed == pytest.approx(vocab.class_tokens.sum())


def test_language_model_without_training_rows_or_rows(spark):
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm.report(frame(spark, [(alone, "a b")])).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
    assert row.score == pytest.approx(3 * math.log10(1 / lm.UNITS), abs=0.6)
    assert lm.report(frame(spark, [])).collect() == []


# ranked search


def plain_search(docs, items, k):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    bags = [pattern.findall(lowered(t)) for _, t in docs]
    big_n, big_l = sum(bool(b) for b in bags), sum(map(len, bags))
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(pattern.findall(lowered(text)))
    out = []
    for item, terms in asked.items():
        sums = [0] * len(docs)
        for term in terms:
            df = sum(term in b for b in bags)
            if df:
                w = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df + 1)))
                for i, bag in enumerate(bags):
                    if tf := bag.count(term):
                        m = 100 - 50 + (50 * len(bag) * big_n) // big_l
                        sums[i] += w * (1000000000 * tf // (1000 * tf + 20 * m))
        best = sorted((-s, docs[i][0] is None, docs[i][0] or 0, i) for i, s in enumerate(sums) if s > 0)[:k]
        out += [(item, r + 1, docs[i][0], -s) for r, (s, _, _, i) in enumerate(best)]
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize(("k", "parts"), [(50, 1), (3, 1), (5, 4)])
def test_ranked_search_equals_full_sums(spark, k, parts):
    rng = random.Random(k)
    vocabulary = [f"t{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 60)))) for i in range(300)]
    docs += [(500, docs[3][1]), (400, docs[3][1]), (400, docs[3][1]), (None, docs[3][1]), (600, None), (601, ""), (602, "- !")]
    docs += [(700, "T0 t0-t5_t7 " * 4000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 15)))) for i in range(12)]
    items += [(20, None), (21, "zz absent"), (None, "t3 t50"), (22, docs[3][1]), (3, "t9, T9; t100"), (23, "t0")]
    made = ranked.search(frame(spark, docs, parts=parts), frame(spark, items, "item_id"), k)
    assert ordered((r.item_id, r.rank, r.doc_id, r.score) for r in made.collect()) == ordered(plain_search(docs, items, k))


def test_ranked_search_of_empty_tables(spark):
    some = [(1, "a b"), (2, "b c")]
    for docs, items in (([], some), (some, []), ([], [])):
        assert ranked.search(frame(spark, docs), frame(spark, items, "item_id")).collect() == []


def test_lengths_beyond_64_bits():
    n = np.array([3, 10**12], dtype=np.int64)
    assert ranked.lengths(n, 10**10, 10**17).tolist() == [50 + 50 * 3 * 10**10 // 10**17, 50 + 50 * 10**22 // 10**17]


# vector codes


def plain_codes(rows, rounds=6):
    kept = [r for r in rows if r[1] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    size = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == size]
    whole = [[math.floor(4096 * float(np.float32(x))) for x in r[1]] + [0] * (-size % 8) for r in kept]
    each = len(whole[0]) // 8
    parts = [[v[p * each : (p + 1) * each] for p in range(8)] for v in whole]
    books = [[list(v[p]) for v in parts[:16]] for p in range(8)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        new = []
        for p in range(8):
            own = [near(v[p], books[p])[1] for v in parts]
            book = []
            for e, old in enumerate(books[p]):
                mine = [v[p] for v, o in zip(parts, own, strict=True) if o == e]
                book.append([sum(c) // len(mine) for c in zip(*mine, strict=True)] if mine else old)
            new.append(book)
        books = new
    found = [[near(v[p], books[p]) for p in range(8)] for v in parts]
    errors = [min(sum(d for d, _ in f), codes.MOST) for f in found]
    by = {}
    for r, e in zip(kept, errors, strict=True):
        by[r[2]] = by.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(
        (-1 if r[0] is None else r[0], "".join(f"{e:02x}" for _, e in f), d, min(by[r[2]], codes.MOST), digest)
        for r, f, d in zip(kept, found, errors, strict=True)
    )


def vectors(spark, rows):
    reach(spark)
    made = spark.createDataFrame([(i, v, c, "x", "y") for i, v, c in rows], "vec_id long, embedding array<float>, label int, v string, parts string")
    return made.repartition(3) if rows else made


def codes_of(spark, rows):
    return sorted(
        (-1 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)
        for r in codes.report(vectors(spark, rows)).collect()
    )


@pytest.mark.parametrize("size", [16, 10])
def test_codes_equal_plain_distances(spark, size):
    rng = random.Random(size)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(size)], rng.choice([None, 1, 2])) for i in range(90)]
    rows += [(200, rows[5][1], 1), (200, rows[5][1], 1), (None, rows[6][1], None), (201, [0.5] * size, 2)]
    rows += [(-5, None, 1), (-4, [], 1), (-3, [float("nan")] * size, 1), (-2, [float("inf")] * size, 1), (-1, [None] * size, 1), (300, [0.25] * (size + 1), 3)]
    assert codes_of(spark, rows) == plain_codes(rows)


def test_codes_of_few_equal_and_huge_vectors(spark):
    few = [(i, [float(i % 2)] * 8, None) for i in range(5)]
    assert codes_of(spark, few) == plain_codes(few)
    huge = [(i, [3e38 * (-1) ** i, 1.0, *[float(i)] * 14], i % 2) for i in range(20)]
    assert codes_of(spark, huge) == plain_codes(huge)
    assert codes_of(spark, []) == []


def test_pivot_bounds_save_distances():
    rng = np.random.default_rng(4)
    centres = rng.integers(-3000, 3000, (16, 8))
    part = centres[rng.integers(0, 16, 2000)] + rng.integers(-60, 60, (2000, 8))
    pivots = part[:4]
    far = np.stack([codes.roots(codes.squared(part, p[None])) for p in pivots], axis=-1)
    between = np.stack([codes.roots(codes.squared(p[None], centres)) for p in pivots])
    own, best, made = codes.nearest(part, far, centres, between)
    every = codes.squared(part[:, None], centres[None])
    assert (own == every.argmin(1)).all() and (best == every.min(1)).all()
    assert made < 0.4 * every.size
