import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimloom.operators import retrieval as rt
from claimloom.operators import sampling as sm
from claimloom.operators import training as tr
from claimloom.operators.quantiles import exact_quantiles


def key(seed, mid):
    return hashlib.md5(f"{seed}:{mid}".encode()).hexdigest()


def people(spark, ham, smish, other=0):
    labels = ["ham"] * ham + ["smish"] * smish + [None] * other
    return spark.createDataFrame([(str(i), x) for i, x in enumerate(labels)], "message_id string, label string")


def sizes(df, *cols):
    return {tuple(r[:-1]): r[-1] for r in df.groupBy(*cols).count().collect()}


def test_published_split_sizes(spark):
    got = sizes(sm.stratified_split(people(spark, 995, 1005)), "label", "split")
    assert got == {("ham", "train"): 796, ("ham", "test"): 199, ("smish", "train"): 804, ("smish", "test"): 201}


def test_unlabelled_variants(spark):
    df = people(spark, 10, 20, 7)
    assert sizes(sm.stratified_split(df), "split")[("test",)] == 2 + math.ceil(27 * 0.2)
    got = sizes(sm.stratified_split(df, unlabelled="train"), "label", "split")
    assert got[(None, "train")] == 7 and got[("smish", "test")] == 4
    none = sizes(sm.stratified_split(people(spark, 0, 0, 11), unlabelled="train"), "split")
    assert none == {("train",): 8, ("test",): 3}


def test_three_way_sizes(spark):
    assert sizes(sm.three_way_split(people(spark, 510, 0)), "split") == {
        ("train",): 341, ("val",): 86, ("test",): 83,
    }


def test_kfold(spark):
    got = sizes(sm.kfold_assign(people(spark, 52, 23), "label"), "label", "fold")
    assert sorted(v for k, v in got.items() if k[0] == "ham") == [10, 10, 10, 11, 11]


def test_sample_is_hash_prefix(spark):
    df = people(spark, 300, 0)
    want = sorted((str(i) for i in range(300)), key=lambda m: key(42, m))[:37]
    assert {r.message_id for r in sm.sample_n(df, 37).collect()} == set(want)
    assert sm.sample_n(df, 999).count() == 300


@pytest.mark.parametrize("target", [0, 6, 40])
def test_quota_equals_loop(spark, target):
    rows, spans = [], []
    for i in range(60):
        rows.append((str(i), ["ham", "smish", None][i % 3]))
        spans += [(str(i), t) for j, t in enumerate("ABC") if (i * 7 + j * 5) % 4 == 0]
    quotas = {"A": 4, "B": 20, "C": 3, "Z": 2}
    got = sm.gold_quota_sample(
        spark.createDataFrame(rows, "message_id string, label string"),
        spark.createDataFrame(spans, "message_id string, claim_type string"),
        target,
        quotas,
    )
    chosen = []
    for t, q in quotas.items():
        free = sorted({m for m, k in spans if k == t} - set(chosen), key=lambda m: key(42, m))
        chosen += free[:q]
    room = max(target - len(chosen), 0)
    for label, n in (("ham", room // 2), ("smish", room - room // 2)):
        free = sorted((m for m, k in rows if k == label and m not in chosen), key=lambda m: key(42, m))
        chosen += free[:n]
    assert sorted(r.message_id for r in got.collect()) == sorted(chosen)


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(rt, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(1)
    kinds = ["A"] * 100 + ["B"] * 20
    pdf = pd.DataFrame({"id": range(120), "claim_type": kinds, "embedding": rng.normal(size=(120, 8)).tolist()})
    ex = spark.createDataFrame(pdf[pdf.id % 4 != 0], "id long, claim_type string, embedding array<double>")
    qs = spark.createDataFrame(pdf[pdf.id % 4 == 0], "id long, claim_type string, embedding array<double>")
    got = {}
    for r in rt.example_topk(ex, qs, 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.example_id
    for q in pdf[pdf.id % 4 == 0].itertuples():
        same = pdf[(pdf.id % 4 != 0) & (pdf.claim_type == q.claim_type)]
        scored = sorted(
            (-round(float(np.dot(e.embedding, q.embedding)), 6), e.id) for e in same.itertuples()
        )
        assert [got[q.id][i + 1] for i in range(5)] == [i for _, i in scored[:5]]


def test_quantiles_with_skew(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.exponential(size=900)] + [("a", 1e12), ("b", 5.0), ("c", None)]
    rows += [("b", 7.0)] * 500
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"p50": 0.5, "p99": 0.99}).collect()}
    for k in "ab":
        x = [v for kk, v in rows if kk == k]
        assert np.isclose(got[k].p50, np.percentile(x, 50)) and np.isclose(got[k].p99, np.percentile(x, 99))
    assert "c" not in got


def test_substitution_chain(spark):
    df = spark.createDataFrame(
        [("e1", "Amazon urgent", "Amazon", "A", "m1")],
        "example_id string, input string, output string, claim_type string, message_id string",
    )
    out = tr.augment_substitute(df, 3).where(F.col("draw").isNotNull()).collect()
    assert len(out) == 2 and all(r.message_id == "m1_aug" for r in out)
    for r in out:
        assert "Amazon" not in r.input or "PayPal" not in r.input
        assert "urgent" not in r.input.split() and r.output in r.input
    assert tr.augment_substitute(df, 1).count() == 1


def test_curriculum(spark):
    df = spark.createDataFrame([("ACTION_CLAIM",), ("DELIVERY_CLAIM",), ("OTHER_CLAIM",)], "claim_type string")
    assert sizes(tr.curriculum_phases(df), "phase") == {(1,): 1, (2,): 2, (3,): 3}
