"""Benchmark items of few characters are matched exactly; the share that substring dedup removes."""

from claimloom.llm import decontam, substrings

from .test_operators import frame


def test_short_items_are_found_exactly(spark):
    items = spark.createDataFrame([(1, "what is a rolling hash"), (2, "eleven char"), (3, "tiny"), (4, None)], "item_id long, text string")
    docs = [
        (10, "so, What is  a rolling hash exactly"),
        (11, "so, what is a roling hash exactly"),
        (12, "has eleven char inside"),
        (13, "nothing of it, tiny"),
        (14, "what is a rolling hash"),
    ]
    found = {(r.doc_id, r.item_id) for r in decontam.find(frame(spark, docs), items).collect()}
    assert found == {(10, 1), (12, 2), (14, 1)}
    kept = {r.doc_id for r in decontam.clean(frame(spark, docs), items).collect()}
    assert kept == {11, 13}


def test_removed_share(spark):
    passage = " ".join(f"word{i}" for i in range(120))
    rows = [(1, passage), (2, passage + " and a tail of its own"), (3, "short"), (4, None)]
    got = {r.doc_id: r for r in substrings.report(frame(spark, rows)).collect()}
    assert got[1].removed_share == 1 and 0.9 < got[2].removed_share < 1
    assert got[3].removed_share == got[4].removed_share == 0
