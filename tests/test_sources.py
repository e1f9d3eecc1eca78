import json

import pandas as pd
import pytest

from claimloom.operators import adapters, labels, quality, spans
from claimloom.operators import evaluate as ev
from claimloom.session import scratch_dir
from claimloom.sources import annotations as an
from claimloom.sources import sinks, tabular

DOCS = [
    {"id": 7, "data": {"text": "Pay now"}, "meta": {"label": "smish"}, "annotations": [{"result": [
        {"value": {"start": 0, "end": 3, "text": "Pay", "labels": []}},
        {"value": {"start": 4, "end": 7, "text": "now", "labels": ["URGENCY_CLAIM", "IDENTITY_CLAIM"]}},
        {"value": {"text": "x", "labels": ["ACTION_CLAIM"]}}]}]},
    {"id": "aug_1", "data": {"text": "hi"}, "meta": {"label": "ham"}, "annotations": []},
    {"data": {}},
]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("ann")
    (path / "a.json").write_text(json.dumps(DOCS))
    return an.read_annotations(spark, str(path), one_array=True)


def test_flatten_and_explode(docs):
    flat = {r.message_id: r for r in an.flatten_messages(docs).collect()}
    assert set(flat) == {"7", "aug_1", ""} and flat[""].text == "" and flat["7"].label == "smish"
    got = [(r.claim_id, r.claim_type, r.start, r.end) for r in an.explode_spans(docs).orderBy("claim_id").collect()]
    assert got == [(1, "URGENCY_CLAIM", 4, 7), (2, "ACTION_CLAIM", 0, 0)]


def test_missing_path(spark):
    with pytest.raises(Exception):
        an.read_annotations(spark, "/nowhere/at/all").count()


def test_queues_and_issues(docs):
    assert labels.identity_review_queue(docs).count() == 1
    assert labels.common_review_queue(docs).count() == 2
    issues = {(r.message_id, r.issue) for r in quality.structure_issues(docs).collect()}
    assert (None, "missing annotations field") in issues and ("7", "result 2 missing start/end") in issues


def test_raw_csv_index(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Message,type\n" one, two ",HAM\n"line\nbreak",\nthree,Spam\n')
    (tmp_path / "b.csv").write_text("Message,type\n,ham\nfour,smishing\n")
    got = [tuple(r) for r in tabular.read_raw_csv(spark, str(tmp_path)).orderBy("message_id").collect()]
    assert got == [("msg_000000", "one, two", "ham"), ("msg_000002", "three", "spam"), ("msg_000004", "four", "smishing")]


def test_index_over_many_files(spark):
    path = scratch_dir(spark, "many")
    spark.range(1000).repartitionByRange(13, "id").sortWithinPartitions("id").write.parquet(path)
    rows = tabular.with_source_index(spark.read.parquet(path))
    assert rows.where("id != row_index").count() == 0 and rows.count() == 1000


def test_encoding_fallback(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("id,sms\n1,café\n2,\n".encode("latin-1"))
    assert [r.text for r in tabular.read_text_csv(spark, str(tmp_path)).collect()] == ["café"]


def test_lookup(docs):
    m = an.flatten_messages(docs)
    assert labels.lookup_message(m, "7").head().text == "Pay now"
    assert labels.lookup_message(m, "zz", strict=False).count() == 0
    with pytest.raises(Exception):
        labels.lookup_message(m, "zz").collect()


def test_parsed_round_trip(spark):
    rows = [("1", "smish", 0, "A", "c", {"x": None, "y": "2"}, "t"), ("1", "smish", 1, "B", "c", None, "t")]
    df = spark.createDataFrame(rows, an.PARSED_SCHEMA)
    path = scratch_dir(spark, "rt")
    sinks.sink_parsed_claims(df, path, "silver_label")
    back = {r.claim_id: r for r in an.read_parsed_claims(spark, path).collect()}
    assert back[1].slots == {} and back[0].slots["y"] == "2"


def parsed(spark, rows):
    return spark.createDataFrame(rows, "message_id string, claim_id int, claim_type string, canonical_form string, slots map<string,string>, i int")


def test_slot_rules(spark):
    gold = parsed(spark, [("1", 0, "A", "Hi", {"a": "5", "b": None, "c": "X "}, 0), ("1", 1, "A", "", {"a": "1"}, 0), ("2", 0, "B", "y", {"q": "1"}, 0)])
    pred = parsed(spark, [("1", 0, "A", "old", {}, 0), ("1", 0, "A", " hi", {"a": "5.0", "b": None, "c": "x"}, 1), ("1", 1, "A", "z", {"a": None}, 0), ("9", 0, "C", "z", {"a": "1", "b": "2"}, 0)])
    got = {r.claim_type: r for r in ev.slot_prf(gold, pred, "i").collect()}
    assert (got["A"].gold_slots, got["A"].pred_slots, got["A"].correct_slots) == (4, 4, 2)
    assert (got["B"].gold_slots, got["B"].pred_slots, got["C"].pred_slots) == (1, 0, 2)
    assert got["_overall"].slot_precision == 2 / 6 and got["C"].slot_f1 == 0.0
    c = ev.canonical_match(gold, pred, "i").head()
    assert (c.exact, c.total) == (1, 2)  # one aligned pair, one lost prediction


def test_review(spark):
    s = spark.createDataFrame(
        [("1", i, "A", "abc", 2, 5) for i in range(4)], "message_id string, claim_id int, claim_type string, text string, start int, end int"
    )
    d = spark.createDataFrame(
        [("1", 0, "reject", None, None), ("1", 1, "edit", "abcdef", None), ("1", 2, "edit", None, "B")],
        "message_id string, claim_id int, action string, new_text string, new_type string",
    )
    got = {r.claim_id: r for r in spans.apply_review(s, d).collect()}
    assert set(got) == {1, 2, 3} and got[1].end == 8 and got[2].claim_type == "B" and got[3].result_count == 3
    assert {r.claim_id: r.end for r in spans.apply_review(s, d, move_end=False).collect()}[1] == 5


def test_near_duplicates(spark):
    rows = [(i, t) for i, t in enumerate(["Hi there!", "hi  there", "bye", "HI, THERE"] + ["same"] * 50)]
    got = quality.near_dup_hash(spark.createDataFrame(rows, "id int, text string"), "id")
    assert sorted(r.id for r in got.collect()) == [1, 3] + list(range(5, 54))


def test_cross_check_repeated_id(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y"), ("2", "y")], "id string, text string")
    b = spark.createDataFrame([("2", "z"), ("3", "w")], "id string, text string")
    assert tuple(quality.cross_check(a, b).head()) == (1, 1, 1, 1)


def test_adapter(spark):
    def predict(batch):
        return pd.DataFrame({"canonical_form": batch["text"].str.upper(), "slots": [{"n": "1"}] * len(batch)})

    adapters.register_parser("upper", adapters.model_parser(predict))
    rows = spark.createDataFrame(
        [("1", "ham", "msg", 0, "A", "abc", 0, 3)],
        "message_id string, message_label string, message string, claim_id int, claim_type string, text string, start int, end int",
    )
    got = adapters.predict_batch("upper", rows).head()
    assert got.canonical_form == "ABC" and got.slots == {"n": "1"}
    with pytest.raises(ValueError):
        adapters.predict_batch("nobody", rows)


def test_verdict(docs):
    v = quality.dataset_quality_verdict(quality.claim_rows(docs)).head()
    assert v.total_messages == 3 and v.smish_messages == 1 and "rare_types" in v.issues
    b = quality.balance_metadata(docs).head()
    assert b.balance_ratio == "2:1"
