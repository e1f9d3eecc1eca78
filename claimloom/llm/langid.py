"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed character n-grams (two and three code points of the
lower-cased text, digits left out, white space one blank), weighted by square-root
frequency times inverse document frequency and scaled to length one.  The vectors
of a language's training texts are clustered on the sphere; a text takes the
language of the nearest of all centroids by cosine.  A text farther from its
centroid than any training text of that language (times ``slack``) is rejected, but
none within ``LEAST_RADIUS``: texts of a few words are far from every centroid.

Learning uses a bounded sample: at most ``per_language`` texts of each language, those of
the smallest hash of id and text; only their n-gram counts reach the driver.  More than
``max_languages`` languages are an error, so that no language is silently left out.  Prediction reads whole texts, in one pass, no shuffle.

Defined cases: a null text or one without any letter is ``und`` with score 0 and is
rejected; equal texts get equal answers; ties go to the first language in
alphabetical order; with no labelled text every answer is ``und``; an empty table
gives no rows; other columns are kept untouched by ``identify`` and ignored
by ``predict``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
DIMENSIONS = 1 << 13
PER_LANGUAGE = 300
MAX_LANGUAGES = 200
CLUSTERS = 4
SLACK = 1.05
LEAST_RADIUS = 0.88
CHUNK = 1 << 21


def counts(texts: list[str]) -> np.ndarray:
    """Hashed n-gram counts, one row per text."""
    made = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    for row, text in enumerate(texts):
        for at in range(0, len(text), CHUNK):
            made[row] += _counts_of(text[at : at + CHUNK + 2])
    return made


def _counts_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    points = np.where(raw < 0x30, 32, raw)
    points = points[(points < 0x30) | (points > 0x39)]
    blank = points == 32
    if len(points) > 1:
        points = points[np.r_[True, ~(blank[1:] & blank[:-1])]]
    x = np.concatenate(([32], points, [32])).astype(np.uint32)
    two = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + x[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - 13)
    keys = np.concatenate((two >> shift, three >> shift))
    return np.bincount(keys, minlength=DIMENSIONS).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return rows / np.where(norm > 0, norm, 1)[:, None]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    radius: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, cosine to its nearest centroid, and whether it was rejected."""
        language = [UNKNOWN] * len(texts)
        score, rejected = [0.0] * len(texts), [True] * len(texts)
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not known or not len(self.centroids):
            return language, score, rejected
        for at in range(0, len(known), 256):
            part = known[at : at + 256]
            like = unit(np.sqrt(counts([texts[i] for i in part])) * self.idf) @ self.centroids.T
            best = np.argmax(np.round(like, 6), axis=1)
            for i, row, near in zip(part, like, best, strict=True):
                owner = int(self.owner[near])
                language[i] = self.languages[owner]
                score[i] = float(min(1.0, max(0.0, row[near])))
                rejected[i] = bool(1 - row[near] > self.radius[owner])
        return language, score, rejected


def cluster(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts are spread: each is the row least like the ones before."""
    chosen = [int(np.argmax(rows @ rows.mean(axis=0)))]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int(np.argmin((rows @ rows[chosen].T).max(axis=1))))
    centers = rows[chosen]
    for _ in range(rounds):
        nearest = np.argmax(rows @ centers.T, axis=1)
        sums = np.stack([rows[nearest == c].sum(axis=0) for c in range(len(centers))])
        centers = np.where((nearest[:, None] == np.arange(len(centers))).any(axis=0)[:, None], unit(sums), centers)
    return centers


def train(rows: list[tuple[str, np.ndarray]], k: int = CLUSTERS, slack: float = SLACK) -> Model:
    """A model from (language, n-gram counts) pairs."""
    languages = sorted({language for language, _ in rows})
    if not rows:
        return Model([], np.zeros(DIMENSIONS), np.zeros((0, DIMENSIONS)), np.zeros(0), np.zeros(0))
    seen = np.stack([c for _, c in rows])
    idf = (np.log((1 + len(rows)) / (1 + (seen > 0).sum(axis=0))) + 1).astype(np.float32)
    vectors = unit(np.sqrt(seen) * idf)
    label = np.array([languages.index(language) for language, _ in rows])
    groups = [cluster(vectors[label == i], k) for i in range(len(languages))]
    radius = [
        min(0.98, max(LEAST_RADIUS, slack * float(1 - (vectors[label == i] @ g.T).max(axis=1).min())))
        for i, g in enumerate(groups)
    ]
    owner = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    return Model(languages, idf, np.concatenate(groups).astype(np.float32), owner, np.array(radius))


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        made = [counts([t])[0] for t in texts]
        at = [np.flatnonzero(c) for c in made]
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:2],
                pa.array([a.astype("<u2").tobytes() for a in at], type=pa.binary()),
                pa.array([c[a].astype("<f4").tobytes() for a, c in zip(at, made, strict=True)], type=pa.binary()),
            ],
            names=["lang", "draw", "at", "n"],
        )


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def fit(
    labelled: DataFrame,
    per_language: int = PER_LANGUAGE,
    max_languages: int = MAX_LANGUAGES,
    k: int = CLUSTERS,
    slack: float = SLACK,
) -> Model:
    """Learn from the rows with a language and a text (columns doc_id, text, lang)."""
    usable = labelled.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    sizes = usable.groupBy("lang").count().limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages; give a larger max_languages")
    share = F.lit(0.0)
    for row in sizes:
        share = F.when(F.col("lang") == row["lang"], F.lit(2.0 * per_language / row["count"])).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.select("lang", draw.alias("draw"), "text").where(F.col("draw") < share)
    taken: dict[str, int] = {}
    rows = []
    drawn = sample.mapInArrow(_count_rows, "lang string, draw double, at binary, n binary").collect()
    for lang, _, at, n in sorted(drawn, key=lambda r: (r[0], r[1], bytes(r[3]), bytes(r[2]))):
        if taken.setdefault(lang, 0) < per_language:
            taken[lang] += 1
            dense = np.zeros(DIMENSIONS, dtype=np.float32)
            dense[np.frombuffer(at, dtype="<u2")] = np.frombuffer(n, dtype="<f4")
            rows.append((lang, dense))
    return train(rows, k, slack)


def _predictor(model: Model, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language, score, rejected = model.predict(batch.column(keep).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:keep],
                    pa.array(language, type=pa.string()),
                    pa.array(score, type=pa.float64()),
                    pa.array(rejected, type=pa.bool_()),
                ],
                names=[*batch.schema.names[:keep], "lang_pred", "score", "rejected"],
            )

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every document."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(fold() == 2, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(
        _predictor(model, 2),
        "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean",
    )


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.coalesce(fold() != 2, F.lit(False)))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose text is accepted as one of the learned languages, as they came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text")).to_pylist()
            keep = pa.array([not r for r in model.predict(texts)[2]], type=pa.bool_())
            yield batch.filter(keep)

    return docs.mapInArrow(run, docs.schema)
