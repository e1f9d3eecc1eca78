"""Streaming counterparts: expiry, late rows, and batch operators not run by queries."""

import datetime as dt

from pyspark.sql import functions as F

from claimloom.operators import quality, spans
from claimloom.sources import tabular
from claimloom.streaming import streams

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def run(spark, tmp_path, chunks, query, out_schema):
    for i, rows in enumerate(chunks):
        df = spark.createDataFrame([(START + dt.timedelta(minutes=m), t) for m, t in rows], "ts timestamp, text string")
        df.write.parquet(f"{tmp_path}/in/chunk{i}")
        stream = spark.readStream.schema("ts timestamp, text string").parquet(f"{tmp_path}/in/*")
        streams.run_available(query(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    return spark.read.schema(out_schema).parquet(f"{tmp_path}/out").collect()


def test_a_repeat_after_the_delay_comes_back(spark, tmp_path):
    chunks = [[(0, "same text"), (5, "Same  text")], [(30, "same text"), (300, "other")], [(301, "other"), (302, "same text")]]
    got = run(spark, tmp_path, chunks, lambda s: streams.stream_dedup(s).select("text"), "text string")
    assert sorted(r.text.lower().split()[0] for r in got) == ["other", "same", "same"]


def test_windows_close_and_late_rows_are_dropped(spark, tmp_path):
    chunks = [[(0, "a"), (30, "a"), (200, "b")], [(10, "a"), (201, "b")], [(600, "a")]]
    got = run(
        spark,
        tmp_path,
        chunks,
        lambda s: streams.stream_type_counts(s.withColumnRenamed("text", "claim_type")),
        "window_start timestamp, claim_type string, n long",
    )
    assert {(r.claim_type, r.n) for r in got} == {("a", 2), ("b", 2)}


def test_a_literal_replacement_character_does_not_change_the_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("MainText\ncafé\nodd � sign\n".encode())
    (tmp_path / "b.csv").write_bytes("MainText\ncafé au lait\n".encode("ISO-8859-1"))
    got = tabular.read_text_csv(spark, str(tmp_path))
    assert sorted(r.text for r in got.collect()) == ["café", "café au lait", "odd � sign"]


def test_one_crowded_text_is_spread_over_keys(spark):
    rows = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Same").otherwise(F.col("id").cast("string")).alias("text"))
    got = quality.near_dup_hash(rows, "doc_id", rows_per_key=4).collect()
    assert sorted(r.id for r in got) == list(range(3, 60, 3)) and {(r.first_id, r.copies) for r in got} == {(0, 20)}


def test_identity_review_keeps_the_bounds(spark):
    found = spark.createDataFrame(
        [("m", 0, "IDENTITY_CLAIM", "bank", 3, 7), ("m", 1, "IDENTITY_CLAIM", "x", 9, 10)],
        "message_id string, claim_id int, claim_type string, text string, start int, end int",
    )
    decided = spark.createDataFrame(
        [("m", 0, "edit", "the bank", None), ("m", 1, "reject", None, None)],
        "message_id string, claim_id int, action string, new_text string, new_type string",
    )
    row = spans.apply_review(found, decided, move_end=False).first()
    assert (row.text, row.start, row.end, row.result_count) == ("the bank", 3, 7, 1)
    assert spans.apply_review(found, decided).first().end == 11


def test_replies_over_several_batches(spark, tmp_path):
    asked = "custom_id string, requested_at timestamp"
    given = "custom_id string, answered_at timestamp, error string, content string"
    day = "2024-01-0{} {}:00:00"
    batches = [
        ([("a", day.format(1, 10)), ("b", day.format(1, 10)), ("c", day.format(1, 11)), ("d", day.format(1, 11))], [("a", day.format(1, 11), "", "A")]),
        ([], [("b", day.format(2, "09"), None, "B"), ("c", day.format(1, 12), "failed", "C"), ("a", day.format(1, 12), "", "A again")]),
        ([("e", day.format(3, 10))], [("d", day.format(3, 10), "", "too late"), ("zz", day.format(3, 10), "", "no request")]),
        ([("end", day.format(9, 10))], [("end", day.format(8, 10), "", "")]),
    ]
    seen = []
    for i, (left, right) in enumerate(batches):
        for name, rows, schema in (("asked", left, asked), ("given", right, given)):
            made = spark.createDataFrame(rows, schema.replace("timestamp", "string"))
            time = "requested_at" if name == "asked" else "answered_at"
            made.withColumn(time, F.to_timestamp(time)).coalesce(1).write.parquet(f"{tmp_path}/{name}/{i}")
        out = streams.stream_attach_responses(
            spark.readStream.schema(asked).parquet(f"{tmp_path}/asked/*"), spark.readStream.schema(given).parquet(f"{tmp_path}/given/*")
        )
        streams.run_available(out, f"{tmp_path}/out", f"{tmp_path}/state")
        rows = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()
        seen.append({(r.custom_id, r.content, r.retry) for r in rows})
    assert seen[0] == {("a", "A", False)}
    assert seen[1] - seen[0] == {("b", "B", False)}
    assert {("c", None, True), ("d", None, True)} <= seen[3]
    assert seen[3] == {("a", "A", False), ("b", "B", False), ("c", None, True), ("d", None, True), ("e", None, True)}
