import hashlib
import re

from pyspark.sql import functions as F

from claimloom.functions import responses as rs
from claimloom.functions import text as tx


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).head().x


def test_fingerprint(spark):
    for t in ["  Hello,  WORLD!! ", "Ünïcode — ok_now x", "", "!!!"]:
        norm = " ".join(re.sub(r"[^\w\s]", "", t.lower()).split())
        assert one(spark, t, tx.fingerprint) == hashlib.md5(norm.encode()).hexdigest()


def test_words_and_offsets(spark):
    text = " \t😀 ab\n\ncd e  "
    row = tx.with_words(spark.createDataFrame([(text,)], "text string")).head()
    assert list(row.w) == text.split()
    assert [text[s : s + len(w)] for w, s in zip(row.w, row.ws)] == text.split()


def test_device_metadata(spark):
    t = "<+1 555>\nText Message\nMar 3, 10:15 AM\nYour Market visit\n  Hello  \n+44 7\n\nbye"
    assert one(spark, t, tx.strip_device_metadata) == "Your Market visit Hello bye"


def test_urgency_order(spark):
    assert one(spark, "Act NOW, it is urgent", tx.urgency_keyword) == "urgent"
    assert one(spark, "I know", tx.urgency_keyword) == "now"
    assert one(spark, "later", tx.urgency_keyword) is None


def test_pattern_offsets(spark):
    text = "x12345678901234567890 12345678 😀 a@b.co 12345678"
    got = one(spark, text, lambda c: tx.pattern_matches(c, r"[0-9]{8,17}"))
    assert [(m.start, m.end, m.text) for m in got] == [
        (m.start(), m.end(), m.group()) for m in re.finditer(r"[0-9]{8,17}", text)
    ]


def test_good_span(spark):
    rows = [("From", 0.9), ("go", 0.9), ("...!", 0.9), ("call us", 0.49), (" call ", 0.5)]
    df = spark.createDataFrame(rows, "t string, c double")
    assert [r.x for r in df.select(tx.good_span(F.col("t"), F.col("c")).alias("x")).collect()] == [
        False, False, False, False, True,
    ]


def test_code_fence(spark):
    for t in ["```json\n[1]\n```", " ```\n[1]```", "[1]", "```json```[1]"]:
        c = t.strip()
        c = c[7:] if c.startswith("```json") else c
        c = c[3:] if c.startswith("```") else c
        c = c[:-3] if c.endswith("```") else c
        assert one(spark, t, rs.strip_code_fence) == c.strip()


def test_claim_list(spark):
    spans = "array<struct<claim_id:int,claim_type:string>>"
    reply = '[{"claim_id": 2, "slots": {"a": 5.0, "b": null}}, {"claim_id": 3}, {"claim_id": 0}, {}]'
    rows = [(reply,), ('{"claim_id": 1}',), ("[{]",), ("nope",)]
    df = spark.createDataFrame(rows, "r string").withColumn(
        "s", F.from_json(F.lit('[{"claim_id":0,"claim_type":"A"},{"claim_id":4,"claim_type":"B"}]'), spans)
    )
    got = [r.p for r in df.select(rs.parse_claim_list(F.col("r"), F.col("s")).alias("p")).collect()]
    assert len(got[0]) == 1 and got[0][0].span.claim_id == 4
    assert got[0][0].canonical_form == "" and got[0][0].slots == {"a": "5.0", "b": None}
    assert all(not g for g in got[1:])


def test_kv_output(spark):
    t = "canonical= a b ; x=1; y=N/A; x= 2=3 ;z=none"
    got = one(spark, t, rs.parse_kv_output)
    assert got.canonical_form == "a b" and got.slots == {"x": "2=3", "y": None, "z": None}


def test_pipe_output(spark):
    got = one(spark, 'canonical: hi there | slots: {"a": "x | y"}', rs.parse_pipe_output)
    assert got.canonical_form == "hi there" and got.slots == {"a": "x | y"}
    assert one(spark, " canonical: hi ", rs.parse_pipe_output).canonical_form == "canonical: hi"
    assert one(spark, "a | [1]", rs.parse_pipe_output).slots == {}


def test_spot_shapes(spark):
    item = '{"claim_type": "A", "spot": {"subject": "s", "time": null}}'
    for t, n in [(f'{{"claims": [{item}, {item}]}}', 2), (f"[{item}]", 1), (item, 1)]:
        got = one(spark, t, rs.parse_spot)
        assert len(got) == n and got[0].subject == "s" and got[0].time is None
    assert not one(spark, "broken", rs.parse_spot)
