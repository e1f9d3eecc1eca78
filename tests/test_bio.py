import random
import time

from conftest import SPAN
from pyspark.sql import functions as F

from claimloom.functions import bio
from claimloom.functions.arrays import count_below
from claimloom.operators import bio as ob

TOKENS = "array<struct<idx:int,start:int,end:int,label:string,confidence:double>>"


def test_word_example(spark):
    text = "Your Amazon package is delayed. Click here urgently."
    spans = [
        (5, 11, "IDENTITY_CLAIM", "Amazon"),
        (12, 30, "DELIVERY_CLAIM", "package is delayed"),
        (32, 42, "ACTION_CLAIM", "Click here"),
        (43, 51, "URGENCY_CLAIM", "urgently"),
    ]
    df = spark.createDataFrame([("1", text, spans)], f"message_id string, text string, spans {SPAN}")
    tags = [r.tag for r in ob.bio_encode_words(df).orderBy("idx").collect()]
    assert tags == [
        "O", "B-IDENTITY_CLAIM", "B-DELIVERY_CLAIM", "I-DELIVERY_CLAIM", "I-DELIVERY_CLAIM",
        "B-ACTION_CLAIM", "I-ACTION_CLAIM", "B-URGENCY_CLAIM",
    ]


def test_words_equal_loop(spark):
    rng = random.Random(2)
    rows = []
    for i in range(200):
        text = "".join(rng.choice(["ab", "c", "😀x", " ", "\t", "\n ", " "]) for _ in range(rng.randint(0, 40)))
        spans = []
        for _ in range(rng.randint(0, 5)):
            s = rng.randint(0, max(len(text) - 1, 0))
            spans.append((s, s + rng.randint(1, 12), rng.choice("AB"), "x"))
        rows.append((str(i), text, spans))
    df = spark.createDataFrame(rows, f"message_id string, text string, spans {SPAN}")
    got = {}
    for r in ob.bio_encode_words(df).orderBy("message_id", "idx").collect():
        got.setdefault(r.message_id, []).append((r.word, r.tag))
    for mid, text, spans in rows:
        want, at = [], 0
        for word in text.split():
            a = text.find(word, at)
            b = at = a + len(word)
            tag = "O"
            for s, e, kind, _ in spans:
                if not (b <= s or a >= e):
                    goes_on = want and want[-1][1][2:] == kind and want[-1][1] != "O"
                    tag = ("B-" if a <= s < b or not goes_on else "I-") + kind
                    break
            want.append((word, tag))
        assert got.get(mid, []) == want


def decode_loop(tokens, pairwise):
    out, cur = [], None
    for _, s, e, label, c in tokens:
        if s == 0 and e == 0:
            continue
        if label.startswith("B-"):
            if cur:
                out.append(cur)
            cur = [s, e, label[2:], c, 1]
        elif label.startswith("I-") and cur:
            if label[2:] == cur[2]:
                cur[1], cur[4] = e, cur[4] + 1
                cur[3] = (cur[3] + c) / 2 if pairwise else (cur[3] * (cur[4] - 1) + c) / cur[4]
        elif label == "O" and cur:
            out.append(cur)
            cur = None
    if cur:
        out.append(cur)
    return [(s, e, t, round(c, 9)) for s, e, t, c, _ in out]


def test_decode_equals_loop(spark):
    rng = random.Random(7)
    labels = ["O", "B-A", "I-A", "I-B", "B-B"]
    rows = []
    for i in range(200):
        toks = [(0, 0, 0, "B-A", 0.5)]
        toks += [(j + 1, j * 2 + 1, j * 2 + 3, rng.choice(labels), rng.random()) for j in range(rng.randint(0, 40))]
        rows.append((str(i), toks))
    df = spark.createDataFrame(rows, f"message_id string, tokens {TOKENS}")
    for mode in ("mean", "pairwise"):
        got = {}
        for r in ob.bio_decode(df, mode).orderBy("message_id", "claim_id").collect():
            got.setdefault(r.message_id, []).append((r.start, r.end, r.claim_type, round(r.confidence, 9)))
        for mid, toks in rows:
            want = decode_loop(toks, mode == "pairwise")
            assert [g[:3] for g in got.get(mid, [])] == [w[:3] for w in want]
            assert all(abs(g[3] - w[3]) < 1e-8 for g, w in zip(got.get(mid, []), want))


def test_char_tags(spark):
    spans = [(2, 6, "A", "cdef"), (9, 10, "B", "j")]
    df = spark.createDataFrame([("1", "a bcdef ij kl", spans)], f"message_id string, text string, spans {SPAN}")
    got = [(r.word, r.tag) for r in ob.bio_encode_chars(df).orderBy("idx").collect()]
    # a span that starts inside a word does not tag that word
    assert got == [("a", "O"), ("bcdef", "B-A"), ("ij", "O"), ("kl", "O")]


def test_entity_chunks(spark):
    tags = ["I-A", "I-A", "I-B", "O", "B-A", "B-A", "I-A", "O", "I-B"]
    df = spark.createDataFrame([(tags,), ([],)], "t array<string>")
    got = [[tuple(x) for x in r.c] for r in df.select(bio.entity_chunks(F.col("t")).alias("c")).collect()]
    assert got[0] == [("A", 0, 1), ("B", 2, 2), ("A", 4, 4), ("A", 5, 6), ("B", 8, 8)]
    assert got[1] == []


def test_strict_scores(spark):
    rows = [(["B-A", "I-A", "O"], ["B-A", "I-A", "O"]), (["B-B", "O"], ["O", "B-B"])]
    df = spark.createDataFrame(rows, "true_tags array<string>, pred_tags array<string>")
    got = {r.claim_type: r for r in ob.strict_entity_prf(df).collect()}
    assert got["A"].f1 == 1.0 and got["B"].f1 == 0.0
    assert got["_micro"].precision == 0.5 and got["_macro"].f1 == 0.5
    assert abs(got["A"].token_accuracy - 0.6) < 1e-9


def test_positions_in_any_order_under_a_chain_of_spans(spark):
    """One chain of overlaps over the whole text; the cost must not follow positions times spans."""
    rng = random.Random(2)
    spans = [(8 * i, 8 * i + 11, "AB"[i % 2], "") for i in range(6000)]
    positions = [rng.randrange(50_000) for _ in range(48_000)] + [0, 0, 7, 49_999]
    df = spark.createDataFrame([(positions, spans)], f"p array<int>, spans {SPAN}")
    began = time.monotonic()
    got = df.select(bio.tags_at(F.col("p"), F.col("spans")).alias("t")).first().t
    assert time.monotonic() - began < 15
    for p, tag in zip(positions, got, strict=True):
        last = max((i for i in range(p // 8 - 1, p // 8 + 1) if 0 <= i < 6000 and 8 * i <= p < 8 * i + 11), default=None)
        assert tag == ("O" if last is None else f"{'B' if p == 8 * last else 'I'}-{'AB'[last % 2]}")


def test_count_below_equals_a_plain_count(spark):
    rng = random.Random(5)
    rows = [(sorted(rng.choices(range(40), k=n)), v) for n in range(34) for v in (-1, 0, 13, 39, 40)]
    df = spark.createDataFrame([*rows, ([1, 2], None)], "o array<int>, v int")
    got = df.select("o", "v", count_below(F.col("o"), F.col("v")).alias("n")).collect()
    assert all(r.n == sum(x < r.v for x in r.o) for r in got if r.v is not None)
