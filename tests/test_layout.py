"""Frequent values, pruned and bucketed layouts, copies reduced before the stream's state."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimloom.operators import evaluate, frequent, quality
from claimloom.sources.layout import SplitLayout
from claimloom.streaming.streams import _latest_copies


def plain_top(rows, k):
    want = set()
    for group in {g for g, _ in rows}:
        counts = Counter(v for g, v in rows if g == group)
        first = sorted(counts.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))[:k]
        want |= {(group, value, n, i + 1) for i, (value, n) in enumerate(first)}
    return want


@pytest.mark.parametrize("cells", [1 << 14, 8])
def test_frequent_values_equal_a_plain_count(spark, cells):
    draw = random.Random(3)
    rows = [(g, f"v{int(draw.paretovariate(0.7))}") for g in ("a", "b", None) for _ in range(3000)]
    rows += [("a", None)] * 40 + [("flat", f"x{i}") for i in range(300)] + [("few", "one"), ("few", "")]
    df = spark.createDataFrame(rows, "g string, v string").repartition(5)
    got = frequent.top_values(df, ["g"], "v", 7, tracked=64, cells=cells)
    assert got.columns == ["g", "v", "n", "rank"]
    assert {tuple(r) for r in got.collect()} == plain_top(rows, 7)


def test_rare_values_are_left_out_before_the_shuffle(spark, monkeypatch):
    df = spark.range(40000).select(F.when(F.col("id") % 2 == 0, F.col("id") % 10).otherwise(F.col("id")).cast("string").alias("v"))
    seen = {}
    real = frequent.stage

    def counted(rows, name):
        made = real(rows, name)
        seen[name] = made.count()
        return made

    monkeypatch.setattr(frequent, "stage", counted)
    got = quality.freq_desc(df, "v", 5).collect()
    assert [(r.v, r.n) for r in got] == [(str(d), 4000) for d in (0, 2, 4, 6, 8)]
    assert seen["frequent_cells"] <= 10


def test_empty_input_has_no_frequent_values(spark):
    none = spark.createDataFrame([], "g string, v string")
    assert frequent.top_values(none, ["g"], "v", 3).count() == 0
    assert quality.freq_desc(none, "v", 3).count() == 0


def read_files(df):
    return {r.f for r in df.select(F.input_file_name().alias("f")).distinct().collect()}


def test_layout_skips_other_splits_and_ranges(spark, tmp_path):
    rows = spark.range(2000).select(
        F.format_string("m%05d", "id").alias("message_id"),
        F.when(F.col("id") % 3 == 0, "test").when(F.col("id") % 7 == 0, None).otherwise("01").alias("split"),
        F.col("id").alias("n"),
    )
    rows = rows.unionByName(spark.createDataFrame([(None, "01", -1)], "message_id string, split string, n long"))
    laid = SplitLayout.write(rows, str(tmp_path / "laid"), ranges=16, rows_per_file=20)
    every = read_files(laid.rows())
    assert sorted(r.n for r in laid.split("test").collect()) == list(range(0, 2000, 3))
    assert {r.split for r in laid.rows().select("split").distinct().collect()} == {"test", "01", None}
    one = read_files(laid.split("test"))
    assert one and all("split=test" in f for f in one) and len(one) < len(every) / 2
    ids = spark.createDataFrame([("m00010",), ("m00011",), ("m00011",), ("none",), (None,)], "message_id string")
    found = laid.by_ids(ids)
    assert sorted(r.n for r in found.collect()) == [10, 11]
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "id_range" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert laid.by_ids(ids.limit(0)).count() == 0


def test_empty_layout(spark, tmp_path):
    none = spark.createDataFrame([], "message_id string, split string, n int")
    laid = SplitLayout.write(none, str(tmp_path / "none"))
    assert laid.split("test").count() == 0 and laid.by_ids(none).count() == 0


def test_bucketed_sides_join_without_an_exchange(spark):
    claims = "message_id string, claim_id int, claim_type string, canonical_form string, slots map<string,string>, run int"
    gold = spark.createDataFrame([(f"m{i}", 0, "A", f"g{i}", {"x": str(i)}, 0) for i in range(50)], claims)
    runs = [(f"m{i}", 0, "A", f"run{r}", {"x": str(i * r)}, r) for i in range(5, 60) for r in (1, 3, 2) if (i + r) % 4]
    pred = spark.createDataFrame(runs, claims)
    sides = evaluate.bucketed_claims(gold, 4), evaluate.bucketed_claims(pred, 4, "run")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = evaluate.align_gold_pred(*sides)
        got = {r.message_id: r.pred and r.pred.canonical_form for r in a.collect()}
        assert "Exchange" not in a._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    last = {}
    for message, _, _, form, _, run in sorted(runs, key=lambda r: r[5]):
        last[message] = form
    assert got == {f"m{i}": last.get(f"m{i}") for i in range(60)}
    assert evaluate.slot_prf(*sides).collect() == evaluate.slot_prf(gold, pred, "run").collect()


def batches(rows, size):
    for i in range(0, len(rows), size):
        part = rows[i : i + size]
        yield pa.record_batch({"ts": [t for t, _ in part], "fingerprint": [f for _, f in part]})


def test_a_task_hands_on_the_latest_copy_only():
    draw = random.Random(5)
    rows = [(draw.randrange(1000), "hot" if draw.random() < 0.8 else draw.choice(["a", "b", None])) for _ in range(5000)]
    got = [r for b in _latest_copies("ts", 1 << 20)(batches(rows, 100)) for r in b.to_pylist()]
    assert {(r["fingerprint"], r["ts"]) for r in got} == {(f, max(t for t, g in rows if g == f)) for f in {"hot", "a", "b", None}}
    assert len(got) == 4


def test_a_task_that_is_full_hands_rows_on_early():
    rows = [(i, f"text {i % 700}") for i in range(3000)]
    got = [r for b in _latest_copies("ts", 4096)(batches(rows, 50)) for r in b.to_pylist()]
    assert {r["fingerprint"] for r in got} == {f for _, f in rows} and max(r["ts"] for r in got) == 2999
    assert list(_latest_copies("ts", 10)(iter([]))) == []
