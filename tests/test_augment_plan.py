"""The draws of the augmentation are joined by shuffle, as they are as many as the examples."""

from claimloom.operators import training as tr


def test_draws_are_not_sent_to_the_driver(spark):
    rows = spark.range(3000).selectExpr(
        "concat('e', id) AS example_id", "concat('urgent ', id) AS input", "'Amazon' AS output", "'A' AS claim_type", "concat('m', id) AS message_id"
    )
    out = tr.augment_substitute(rows.repartition(4), 3)
    ran = out._jdf.queryExecution()
    assert ran.toRdd().count() == 9000
    plan = ran.executedPlan().toString().split("Initial Plan")[0]
    joins = [line for line in plan.splitlines() if "Join [" in line and "rank#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    draws = sorted(r.draw for r in out.where("draw IS NOT NULL").select("draw").collect())
    assert draws == list(range(6000))
