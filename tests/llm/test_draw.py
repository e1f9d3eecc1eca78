"""The language sample is a draw by hash, whatever the texts look like."""

import numpy as np
from pyspark.sql import functions as F

from claimloom.llm import langid


def test_the_smallest_draws_of_each_language_are_learnt(spark, monkeypatch):
    rows = [(i, f"some {'long ' * (i % 9)}text number {chr(97 + i % 26)}{chr(97 + i // 26)}", "ab"[i % 2]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1 << 30))
    drawn = sorted((r.lang, r.draw, r.text) for r in docs.withColumn("draw", draw).collect())
    expected = [t for lang in "ab" for t in [t for x, _, t in drawn if x == lang][:20]]
    learnt = []
    monkeypatch.setattr(langid, "train", lambda rows, k, slack: learnt.extend(rows))
    langid.fit(docs, per_language=20)
    assert [lang for lang, _ in learnt] == ["a"] * 20 + ["b"] * 20
    assert np.array_equal(np.stack([c for _, c in learnt]), langid.counts(expected))
