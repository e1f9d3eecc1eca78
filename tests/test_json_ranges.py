"""JSON arrays in ranges against the plain parser."""

import json
import random

import pyarrow as pa
import pytest

from claimloom.sources import annotations as an
from claimloom.sources import json_ranges

SCHEMA = "id long, text string, inner array<struct<k:string,v:map<string,string>>>"


def element(rng, i):
    def word():
        return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", "é", "x", "\n", '\\"', " "]) for _ in range(rng.randrange(12)))

    inner = [{"k": word(), "v": {word(): word() for _ in range(rng.randrange(3))}} for _ in range(rng.randrange(4))]
    return {"id": i, "text": word() * rng.choice([1, 1, 20]), "inner": inner}


def read(spark, path, size):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = json_ranges.read(spark, path, SCHEMA)
        return sorted(((r.id, r.text, [(x.k, sorted(x.v.items())) for x in r.inner or []]) for r in rows.collect()), key=str)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def plain(elements):
    return sorted(((e["id"], e["text"], [(x["k"], sorted(x["v"].items())) for x in e["inner"]]) for e in elements), key=str)


@pytest.mark.parametrize(("size", "indent"), [(40, None), (200, 1), (1 << 20, None)])
def test_arrays_equal_the_plain_parser(spark, tmp_path, size, indent):
    rng = random.Random(size)
    some = [element(rng, i) for i in range(40)]
    (tmp_path / "a.json").write_text(json.dumps(some[:25], indent=indent, ensure_ascii=bool(indent)))
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.json").write_text("")
    (tmp_path / "d.json").write_text("\n".join(json.dumps(e) for e in some[25:35]))
    (tmp_path / "e.json").write_text("\n " + json.dumps(some[35:38]) + "\n" + json.dumps(some[38:]))
    assert read(spark, str(tmp_path), size) == plain(some)


def test_one_large_array_gives_many_tasks_and_the_same_rows(spark, tmp_path):
    docs = [{"id": str(i), "data": {"text": f"text {i} }}]"}, "meta": {"label": "ham", "claim_types": ["A"]}} for i in range(3000)]
    (tmp_path / "x.json").write_text(json.dumps(docs))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = an.read_annotations(spark, str(tmp_path), one_array=True)
        whole = spark.read.schema(an.ANNOTATION_SCHEMA).option("multiLine", True).json(str(tmp_path))
        assert sorted(got.collect(), key=str) == sorted(whole.collect(), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_a_cut_object_is_dropped_and_a_bad_one_is_null(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"id": 1, "text": "a", "inner": []}, 7, {"id": oops}, {"id": 3, "text": "cut')
    assert [(r[0], r[1]) for r in read(spark, str(tmp_path), 1 << 20)] == [(1, "a"), (None, None)]


def test_effects_of_pieces_equal_a_plain_walk():
    rng = random.Random(8)
    texts = ["".join(rng.choices(['"', "\\", "{", "[", "]", "a", "\xe9"], k=rng.randrange(14))) for _ in range(3000)]
    got = json_ranges._effects(pa.array(["x", *texts]).slice(1))
    for name, start in (("zero", 0), ("one", 1)):
        ends, depths = got[name].to_pylist(), got[f"depth_{name}"].to_pylist()
        for text, end, depth in zip(texts, ends, depths, strict=True):
            inside, change, run = start, 0, 0
            for c in text:
                if c == '"':
                    inside = 1 if not inside or run % 2 else 0
                elif not inside:
                    change += {"{": 1, "[": 1, "]": -1}.get(c, 0)
                run = run + 1 if c == "\\" else 0
            assert (end, depth) == (inside, change - (not inside)), text
    assert all(len(x) == 0 for x in json_ranges._effects(pa.array([], pa.string())).values())
