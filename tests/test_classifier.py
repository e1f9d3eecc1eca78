"""The text classifier on classes of unequal size that follow from the words."""

from pyspark.sql import functions as F

from claimloom.operators import classifier


def test_it_beats_the_larger_class_and_finds_both(spark):
    i = F.col("id")
    smish = (i % 4) == 0
    odd = F.element_at(F.array(*[F.lit(w) for w in ("parcel", "account", "prize")]), (F.pmod(F.xxhash64(i), F.lit(3)) + 1).cast("int"))
    rows = spark.range(400).select(
        F.concat(F.lit("m"), i).alias("message_id"),
        F.when(smish, F.concat(F.lit("your "), odd, F.lit(" is held, pay at once")))
        .otherwise(F.concat(F.lit("see you at "), i % 12, F.lit(" then, about the "), odd))
        .alias("text"),
        F.when(smish, "SMISH").otherwise("HAM").alias("class"),
    )
    report = classifier.ham_smish_classifier(rows).first()
    assert report.tp + report.fn == 20 and report.tn + report.fp == 60
    assert report.accuracy > 60 / 80 + 0.1
    assert report.smish_recall > 0.8 and report.ham_recall > 0.8
