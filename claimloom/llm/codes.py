"""Vector codes by codebooks, one for each of eight parts, with pivots that save distances.

Components become integers, floor(4096 * x).  The codebook of a part position starts as
that part of the vectors with the smallest ids.  A round assigns every part to its
nearest entry, ties to the lower index, and moves each entry to the floored mean of its
parts; at the end the parts are assigned once more.

Nearest entries are found as LAESA does: the first entries are fixed pivots, and every
part's distances to them are computed once and stored with the part.  In a round the
pivots' distances to the present entries give, for each part and entry, the lower bound
``max |d(part, pivot) - d(pivot, entry)|``.  Entries are tried in ascending order of the
bound, and exact integer distances are computed only while the bound does not exceed the
best one found.

A round is one map over the stored parts and an aggregation of sums, combined in the
tasks; the driver holds the codebooks, which are 16 times a vector in size.

Defined cases: null vectors and those with null or non-finite components are dropped, as
are empty vectors and those of another length than the first kept one (by id, then by
components; a null id comes last); a length that is no multiple of eight is filled with
zeros; fewer than 16 kept vectors make that many entries; repeated rows count each time;
an empty table gives no rows; other columns are ignored.  Where a squared distance
could reach 2**60, unbounded integers are used; an error beyond 2**63 - 1 is given as
that number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

PARTS = 8
ENTRIES = 16
ROUNDS = 6
PIVOTS = 4
SCALE = 4096
LIMIT = 1 << 60
MOST = (1 << 63) - 1
SLACK = 1e-6
STORED = "vec_id long, label int, parts binary, pivots binary"


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the components as scaled doubles, of the vectors that are kept."""
    numbers = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("v"),
    )
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = numbers.where(F.col("v").isNotNull() & (F.size("v") > 0) & good)
    return kept.withColumn("v", F.transform("v", lambda x: x * F.lit(float(SCALE))))


def integers(rows: list, exact: bool) -> np.ndarray:
    """Floored components, one row per vector, filled up to equal parts; axes: vector, part, place."""
    floored = np.floor(np.asarray(rows, dtype=np.float64))
    if exact:
        wide = np.empty(floored.shape, dtype=object)
        wide.flat = [int(x) for x in floored.ravel()]
    else:
        wide = floored.astype(np.int64)
    missing = -wide.shape[1] % PARTS
    if missing:
        wide = np.concatenate((wide, np.zeros((len(wide), missing), dtype=wide.dtype)), axis=1)
    return wide.reshape(len(wide), PARTS, -1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    gap = a - b
    return (gap * gap).sum(axis=-1)


def roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def nearest(part: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Entry and squared distance for each row of one part position, and how many were computed.

    ``to_pivots`` has the rows' distances to the pivots, ``between`` those of pivots to entries.
    """
    n, k = len(part), len(entries)
    bound = np.zeros((n, k))
    for p in range(between.shape[0]):
        np.maximum(bound, np.abs(to_pivots[:, p, None] - between[p]), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    least = np.maximum(np.take_along_axis(bound, order, axis=1) * (1 - SLACK) - SLACK, 0) ** 2
    best = np.zeros(n, dtype=part.dtype)
    chosen = np.full(n, k)
    rows, made = np.arange(n), 0
    for j in range(k):
        if j:
            rows = rows[least[rows, j] <= best[rows].astype(np.float64)]
            if not len(rows):
                break
        entry = order[rows, j]
        found = squared(part[rows], entries[entry])
        made += len(rows)
        better = (found < best[rows]) | ((found == best[rows]) & (entry < chosen[rows])) if j else np.ones(n, dtype=bool)
        won = rows[better]
        best[won], chosen[won] = found[better], entry[better]
    return chosen, best, made


def _chunks(batch: pa.RecordBatch, exact: bool, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Stored parts and pivot distances of a batch as arrays."""
    raw = b"".join(batch.column("parts").to_pylist())
    floats = np.frombuffer(raw, dtype="<f8") if exact else np.frombuffer(raw, dtype="<i4")
    parts = integers(floats.reshape(-1, width), True) if exact else floats.astype(np.int64).reshape(-1, PARTS, width // PARTS)
    pivots = np.frombuffer(b"".join(batch.column("pivots").to_pylist()), dtype="<f8")
    return parts, pivots.reshape(len(parts), PARTS, -1)


class Codes:
    """Stored parts of a table's vectors and the codebooks learnt from them."""

    def __init__(self, vectors: DataFrame):
        kept = scaled(vectors)
        self.spark = vectors.sparkSession
        first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").take(ENTRIES)
        self.stored, self.books = None, np.zeros((0, PARTS, 0), dtype=np.int64)
        if not first:
            return
        size = len(first[0]["v"])
        if any(len(r["v"]) != size for r in first):
            kept = kept.where(F.size("v") == size)
            first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").take(ENTRIES)
        else:
            kept = kept.where(F.size("v") == size)
        most = kept.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
        self.width = size + -size % PARTS
        self.exact = exact = (2 * int(most) + 2) ** 2 * (self.width // PARTS) >= LIMIT
        self.books = integers([r["v"] for r in first], exact)
        pivots = self.pivots = self.books[:PIVOTS].copy()

        def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
                parts = integers(flat, exact)
                far = np.stack([roots(squared(parts, p[None])) for p in pivots], axis=-1)
                if exact:
                    whole = np.floor(flat)
                    raw = np.pad(whole, ((0, 0), (0, -size % PARTS))).astype("<f8")
                else:
                    raw = parts.reshape(len(parts), -1).astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id"),
                        batch.column("label"),
                        pa.array([r.tobytes() for r in raw], type=pa.binary()),
                        pa.array([f.astype("<f8").tobytes() for f in far], type=pa.binary()),
                    ],
                    names=["vec_id", "label", "parts", "pivots"],
                )

        self.stored = stage(kept.mapInArrow(stored, STORED), "parts")

    def _sent(self):
        between = np.stack([roots(squared(p[None], self.books)) for p in self.pivots])
        return self.books, between, self.exact, self.width

    def round(self) -> None:
        """Assigns all parts and moves each entry to the floored mean of its parts."""
        books, between, exact, width = self._sent()
        kind = "decimal(38,0)"
        low = (1 << 62) - 1

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k, each = len(books), width // PARTS
            total = np.zeros((PARTS, k, each), dtype=object)
            count = np.zeros((PARTS, k), dtype=np.int64)
            for batch in batches:
                parts, far = _chunks(batch, exact, width)
                for p in range(PARTS):
                    own, _, _ = nearest(parts[:, p], far[:, p], books[:, p], between[:, :, p])
                    order = np.argsort(own, kind="stable")
                    used, start = np.unique(own[order], return_index=True)
                    if len(used):
                        total[p, used] += np.add.reduceat(parts[order, p], start).astype(object)
                        count[p] += np.bincount(own, minlength=k)
            part, entry, place = (x.ravel() for x in np.indices(total.shape))
            used = count[part, entry] > 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[used].astype(np.int32)),
                    pa.array(entry[used].astype(np.int32)),
                    pa.array(place[used].astype(np.int32)),
                    pa.array(count[part, entry][used]),
                    pa.array([Decimal(int(x) >> 62) for x in total.ravel()[used]], type=pa.decimal128(38, 0)),
                    pa.array([Decimal(int(x) & low) for x in total.ravel()[used]], type=pa.decimal128(38, 0)),
                ],
                names=["part", "entry", "place", "n", "high", "low"],
            )

        parts = self.stored.mapInArrow(sums, f"part int, entry int, place int, n long, high {kind}, low {kind}")
        for r in parts.groupBy("part", "entry", "place").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low"))).collect():
            self.books[r["entry"], r["part"], r["place"]] = ((int(r["high"]) << 62) + int(r["low"])) // r["n"]

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and place."""
        return hashlib.sha256(",".join(str(int(x)) for x in self.books.transpose(1, 0, 2).ravel()).encode()).hexdigest()

    def coded(self) -> DataFrame:
        """vec_id, label, code (two hex digits a part) and squared error of every kept vector."""
        if self.stored is None:
            return self.spark.createDataFrame([], "vec_id long, label int, code string, error long")
        books, between, exact, width = self._sent()

        def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts, far = _chunks(batch, exact, width)
                found = [nearest(parts[:, p], far[:, p], books[:, p], between[:, :, p]) for p in range(PARTS)]
                own = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
                error = sum(f[1] for f in found)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id"),
                        batch.column("label"),
                        pa.array([bytes(r).hex() for r in own], type=pa.string()),
                        pa.array([min(int(e), MOST) for e in error], type=pa.int64()),
                    ],
                    names=["vec_id", "label", "code", "error"],
                )

        return self.stored.mapInArrow(codes, "vec_id long, label int, code string, error long")


def learn(vectors: DataFrame) -> Codes:
    made = Codes(vectors)
    if made.stored is not None:
        for _ in range(ROUNDS):
            made.round()
    return made


def report(vectors: DataFrame) -> DataFrame:
    """Codes and errors of all kept vectors, the errors added up by label, the codebooks' digest."""
    made = learn(vectors)
    rows = stage(made.coded(), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    labels = rows.groupBy(F.col("label").alias("l")).agg(total.alias("label_error"))
    return rows.join(labels, F.col("label").eqNullSafe(F.col("l"))).select(
        "vec_id", "code", "error", "label_error", F.lit(made.digest()).alias("codebooks_sha256")
    )


def oracle() -> str:
    """The same by plain distances to every entry, in DuckDB's SQL."""
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, "
        "list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT r, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x "
        f"FROM kept, range({PARTS}) g(p))",
        f"book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {ENTRIES})",
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"near{i} AS MATERIALIZED (SELECT r, p, min(d) AS d, arg_min(e, d * 64 + e) AS e FROM ("
            "SELECT r, parts.p, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d "
            f"FROM parts JOIN book{i} ON parts.p = book{i}.p) GROUP BY r, p)"
        )
        if i < ROUNDS:
            steps.append(
                f"mean{i} AS MATERIALIZED (SELECT p, e, list(m ORDER BY j) AS c FROM (SELECT p, e, j, "
                "CAST((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM ("
                f"SELECT parts.p, near{i}.e, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM parts JOIN near{i} USING (r, p)) "
                "GROUP BY p, e, j) GROUP BY p, e)"
            )
            steps.append(
                f"book{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN mean{i} m USING (p, e))"
            )
    return (
        "WITH " + ",\n".join(steps) + ",\n"
        f"coded AS MATERIALIZED (SELECT r, string_agg(lpad(printf('%x', e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY r)\n"
        "SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, "
        f"(SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{ROUNDS}) AS codebooks_sha256 "
        "FROM coded JOIN kept USING (r)"
    )
