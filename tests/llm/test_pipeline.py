"""The pipeline, stage by stage and as a whole, against plain versions."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from claimloom.llm import decontam, langid

from . import brute

LETTERS = {"en": "abcdefgh", "fr": "ijklmnop"}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(LETTERS[lang], k=rng.randrange(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    bench = [(i, prose(rng, "en", 25)) for i in range(4)]
    shared = "\n".join(prose(rng, "fr", 9) for _ in range(4))
    docs = []

    def add(text, lang="en"):
        docs.append((len(docs), text, lang, f"src{len(docs) % 3}", len(text or "")))

    for i in range(120):
        lang = ("en", "fr")[i % 2]
        add("\n".join(prose(rng, lang, rng.randrange(6, 40)) for _ in range(rng.randrange(1, 6))), lang)
    for i in range(8):
        add(prose(rng, "fr", 30) + "\n" + shared + "\n" + prose(rng, "fr", 12), "fr")
        near = docs[i * 5][1].split(" ")
        near[len(near) // 2] = f"abcabc{i}x"
        add(" ".join(near), docs[i * 5][2])
        add(docs[i * 7][1], docs[i * 7][2])
        add(prose(rng, "en", 20) + " " + bench[i % 4][1].upper() + " " + prose(rng, "en", 9))
    add(None)
    add("")
    add("123 456 !", None)
    add("日本語だけの文書です。" * 30, None)
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(
        3
    ).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, bench


def plain(spark, folder, docs, bench):
    """(doc_id, text) after each stage but the last."""
    table = spark.read.parquet(f"{folder}/documents.parquet")
    model = langid.fit(langid.training_rows(table))
    rejected = model.predict([d[1] for d in docs])[2]
    rows = [(d[0], d[1]) for d, gone in zip(docs, rejected, strict=True) if not gone]
    yield rows
    kept = brute.line_dedup(rows)
    rows = [
        (doc, "\n".join(lines))
        for (doc, text), lines in zip(rows, kept, strict=True)
        if "\n".join(lines) == text or "".join(lines).strip(" ")
    ]
    yield rows
    rows = [r for r, least in zip(rows, brute.jaccard_components(rows), strict=True) if r[0] == least]
    yield rows
    items = [decontam.normal(t) for _, t in bench]
    rows = [
        r
        for r in rows
        if not any(
            brute.least_edits(y, decontam.normal(r[1])) <= decontam.budget(len(y), decontam.Q, decontam.ERROR_RATE)[0]
            for y in items
        )
    ]
    yield rows


def test_every_stage_works_on_what_the_one_before_kept(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    folder, docs, bench = tables
    current = spark.read.parquet(f"{folder}/documents.parquet")
    columns = current.columns
    expected = list(plain(spark, folder, docs, bench))
    assert [len(e) for e in expected] == sorted((len(e) for e in expected), reverse=True)
    for (name, step), rows in zip(corpus_pipeline.STAGES[:-1], expected, strict=True):
        current = corpus_pipeline.stage(step(spark, current, folder), name)
        assert current.columns == columns, name
        got = sorted((r.doc_id, r.text) for r in current.collect())
        assert got == sorted(rows), name
        assert all(r.n_chars == len(r.text) for r in current.collect())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        whole.setdefault(r.doc_id, []).append(r)
    assert sorted(whole) == sorted(d for d, _ in expected[-1])
    for doc, text in expected[-1]:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        for r in whole[doc]:
            part = np.array(ids[r.start : r.start + r.length], dtype="<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids)
        assert sum(r.length for r in whole[doc]) == len(ids)


def test_no_documents(spark, tables, tmp_path):
    folder, _, _ = tables
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
