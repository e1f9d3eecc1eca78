"""Ranked search of documents for items, with the terms dealt over owners in a pipeline.

Documents are indexed in blocks of a few thousand; a block's postings hold, for each
term that some item may use, its documents and how often they hold it.  Terms belong to
owners by how many documents hold them, the rarest terms to the first owner.  Items
travel in bundles from owner to owner: at each, a cogroup by (block, bundle) brings the
owner's postings of the block together with the bundle's items and their sparse
accumulators, and the owner adds its integer contributions.  After the last owner each
block hands on an item's best documents, and a ranking over all blocks selects.

An accumulator goes as soon as it cannot matter: a document whose sum and the most that
later owners can add stay below the item's k-th sum within the block is not among the
item's k best, whatever follows; the same holds for documents that a later owner would add.
Equal scores are never decided that way, so results are exactly those of full sums.

Scores are those of the contract: N documents with a term, L terms in all, n of a
document, df and tf of a term, w = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 50 + 50 n N
div L, and the sum of w (1e9 tf div (1000 tf + 20 m)).

A filter of at most 16 MB keeps the terms of the items in the first scan; what it lets
through besides goes in an exact join by hash.

Defined cases: a null or empty text has no terms; rows with one item_id are one item with
the terms of all; a null item_id is an item of its own; repeated documents are ranked one
by one; a null doc_id comes last among equal scores; an item without a scoring
document and an empty table give no rows; other columns are ignored; terms are compared
by 64-bit hashes; a very long text is tokenised in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_filter, stage
from .tokens import TERMS, groups, hashed

BEST = 50
BLOCK_DOCS = 4096
HELD = 1 << 21
BUNDLE = 256
#: An owner has the terms held by fewer than this share of the documents, the last one the rest.
OWNERS = (1 / 64, 1 / 8)
NO_ID = np.iinfo(np.int64).max
BLOCKS = (
    "block long, doc_ids binary, nulls binary, n_terms binary, filled long, terms long, "
    "postings array<struct<hash:long,docs:binary,times:binary>>"
)
DEALT = "block long, hash long, docs binary, parts binary, top long"
STATE = "block long, bundle long, item_id long, terms binary, docs binary, sums binary"
CHOSEN = "item_id long, doc_id long, score long"


def _texts(table: DataFrame, key: str) -> DataFrame:
    return table.select(F.col(key).cast("long").alias(key), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, hash) for every term of an item, once."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, parts in groups(batch.column("text").to_pylist(), TERMS):
                part, keys, _, _ = hashed(parts, TERMS)
                owner = np.asarray(rows, dtype=np.int64)[part]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item_id").take(pa.array(owner)), pa.array(keys.view(np.int64))], names=["item_id", "hash"]
                )

    return stage(_texts(items, "item_id").mapInArrow(of, "item_id long, hash long").distinct(), "items")


def _counted(docs: list[np.ndarray], keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Sorted by key and document, times added up."""
    doc, key, n = (np.concatenate(x) for x in (docs, keys, times))
    order = np.lexsort((doc, key))
    doc, key, n = doc[order], key[order], n[order]
    if not len(doc):
        return doc, key, n
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
    return doc[first], key[first], np.add.reduceat(n, first)


class _Block:
    """Documents of a block while their texts are read."""

    def __init__(self):
        self.ids, self.null, self.n = [], [], []
        self.docs, self.keys, self.times = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        self.held = 0

    def add(self, docs, keys):
        self.docs.append(docs)
        self.keys.append(keys)
        self.times.append(np.ones(len(docs), dtype=np.int64))
        self.held += len(docs)
        if self.held > HELD:
            self.docs, self.keys, self.times = ([x] for x in _counted(self.docs, self.keys, self.times))
            self.held = len(self.docs[0])

    def row(self, number: int) -> pa.RecordBatch:
        docs, keys, times = _counted(self.docs, self.keys, self.times)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(keys))[: len(first)]
        n = np.array(self.n, dtype=np.int64)
        postings = [
            {"hash": h, "docs": docs[a:b].astype("<u2").tobytes(), "times": times[a:b].astype("<i8").tobytes()}
            for h, a, b in zip(keys[first].view(np.int64).tolist(), first.tolist(), ends.tolist(), strict=True)
        ]
        kind = pa.list_(pa.struct([("hash", pa.int64()), ("docs", pa.binary()), ("times", pa.binary())]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number]),
                pa.array([np.array(self.ids, dtype="<i8").tobytes()]),
                pa.array([np.array(self.null, dtype=bool).tobytes()]),
                pa.array([n.astype("<i8").tobytes()]),
                pa.array([int((n > 0).sum())]),
                pa.array([int(n.sum())]),
                pa.array([postings], type=kind),
            ],
            names=[f.split()[0] for f in BLOCKS.split(", ", 6)],
        )


def blocks(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The documents in blocks, with postings of the terms (hash) that the filter lets through."""
    filled, bits = bit_filter(terms, "hash", terms.count())
    sent = docs.sparkSession.sparkContext.broadcast(filled)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        number = TaskContext.get().partitionId() << 32
        block = _Block()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text").to_pylist()
            at = 0
            while at < len(ids):
                size = min(len(ids) - at, BLOCK_DOCS - len(block.n))
                base = len(block.n)
                block.ids += [0 if x is None else x for x in ids[at : at + size]]
                block.null += [x is None for x in ids[at : at + size]]
                n = np.zeros(size, dtype=np.int64)
                for rows, parts in groups(texts[at : at + size], TERMS):
                    part, keys, _, _ = hashed(parts, TERMS)
                    doc = np.asarray(rows, dtype=np.int64)[part]
                    n += np.bincount(doc, minlength=size)
                    cell = keys & np.uint64(bits - 1)
                    kept = (words[cell >> np.uint64(5)] >> (cell & np.uint64(31)).astype(np.uint32)) & np.uint32(1)
                    kept = np.flatnonzero(kept)
                    block.add(doc[kept] + base, keys[kept])
                block.n += n.tolist()
                at += size
                if len(block.n) >= BLOCK_DOCS:
                    yield block.row(number)
                    number, block = number + 1, _Block()
        if block.n:
            yield block.row(number)

    return stage(_texts(docs, "doc_id").mapInArrow(read, BLOCKS), "blocks")


def lengths(n: np.ndarray, filled: int, terms: int) -> np.ndarray:
    """m of documents with n terms; unbounded integers where 64 bits could overflow."""
    if len(n) and int(n.max()) * 50 * filled >= 1 << 62:
        return np.array([50 + 50 * int(x) * filled // terms for x in n], dtype=np.int64)
    return 50 + 50 * n * filled // max(terms, 1)


def _dealt(made: DataFrame, filled: int, terms: int) -> DataFrame:
    """A row per block and term: documents, the parts 1e9 tf div (1000 tf + 20 m), their maximum."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                m = lengths(np.frombuffer(row["n_terms"], dtype="<i8"), filled, terms)
                out = []
                for p in row["postings"]:
                    tf = np.frombuffer(p["times"], dtype="<i8")
                    parts = 1_000_000_000 * tf // (1000 * tf + 20 * m[np.frombuffer(p["docs"], dtype="<u2")])
                    out.append((row["block"], p["hash"], p["docs"], parts.astype("<i4").tobytes(), int(parts.max())))
                if out:
                    names = [f.split()[0] for f in DEALT.split(", ")]
                    yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out, strict=True), strict=True)))

    return made.select("block", "n_terms", "postings").mapInArrow(deal, DEALT)


def _added(state: pa.Table, owned: pa.Table, k: int) -> Iterator[tuple[dict, np.ndarray, np.ndarray, int]]:
    """For each item of a bundle its documents and sums after this owner, and a bound for what follows."""
    postings, later, ids = {}, {}, None
    for row in owned.to_pylist():
        if row["hash"] is None:
            ids = row
        elif row["docs"] is None:
            later[row["hash"]] = row["w"] * row["top"]
        else:
            docs = np.frombuffer(row["docs"], dtype="<u2").astype(np.int64)
            postings[row["hash"]] = docs, np.frombuffer(row["parts"], dtype="<i4").astype(np.int64) * row["w"], row["top"] * row["w"]
    size = 1 + max([0, *(int(d[-1]) for d, _, _ in postings.values())])
    for row in state.to_pylist():
        terms = np.frombuffer(row["terms"], dtype="<i8").tolist()
        own = [postings[t] for t in terms if t in postings]
        rest = sum(later.get(t, 0) for t in terms)
        docs, sums = np.frombuffer(row["docs"], dtype="<u2").astype(np.int64), np.frombuffer(row["sums"], dtype="<i8")
        total = np.zeros(max(size, int(docs.max()) + 1 if len(docs) else 0), dtype=np.int64)
        total[docs] = sums
        for at, values, _ in own:
            total[at] += values
        found = np.flatnonzero(total)
        least = 1
        if len(found) > k:
            kth = int(np.partition(total[found], len(found) - k)[len(found) - k])
            least = max(kth - rest, 1)
        found = found[total[found] >= least]
        yield row, found, total[found], ids


def search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """The k best documents of every item: item_id, rank, doc_id, score."""
    asked = item_terms(items)
    terms = asked.select("hash").distinct()
    made = blocks(docs, terms)
    total = made.agg(F.sum("filled").alias("filled"), F.sum("terms").alias("terms")).first()
    filled, in_all = total["filled"] or 0, total["terms"] or 0
    number = max(1, -(-asked.select("item_id").distinct().count() // BUNDLE))
    bundle = F.pmod(F.xxhash64("item_id"), F.lit(number)).alias("bundle")
    bundled = asked.select(bundle, "item_id", "hash")
    held = made.select(F.explode("postings").alias("p")).groupBy(F.col("p.hash").alias("hash"))
    held = held.agg(F.sum(F.octet_length("p.docs") / 2).cast("long").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(filled) + 2) / (2 * F.col("df") + 1))).cast("long")
    owner = sum(((F.col("df") >= F.lit(filled * share)).cast("int") for share in OWNERS), F.lit(0))
    owned = stage(bundled.select("bundle", "hash").distinct().join(held, "hash").select("bundle", "hash", weight.alias("w"), owner.alias("owner")), "owners")
    dealt = stage(_dealt(made, filled, in_all).join(owned, "hash"), "dealt")
    names = [f.split()[0] for f in STATE.split(", ")]

    def carried(state: pa.Table, posts: pa.Table) -> pa.Table:
        rows = [
            {**row, "docs": at.astype("<u2").tobytes(), "sums": sums.astype("<i8").tobytes()}
            for row, at, sums, _ in _added(state, posts, k)
        ]
        kinds = [pa.int64()] * 3 + [pa.binary()] * 3
        return pa.Table.from_pylist([{n: r[n] for n in names} for r in rows], pa.schema(list(zip(names, kinds, strict=True))))

    def chosen(state: pa.Table, posts: pa.Table) -> pa.Table:
        items_, ids_, scores_ = [], [], []
        for row, at, sums, ids in _added(state, posts, k):
            own = np.frombuffer(ids["docs"], dtype="<i8")[at]
            null = np.frombuffer(ids["parts"], dtype=bool)[at]
            best = np.lexsort((own, null, -sums))[:k]
            items_ += [row["item_id"]] * len(best)
            ids_ += [None if none else x for x, none in zip(own[best].tolist(), null[best].tolist(), strict=True)]
            scores_ += sums[best].tolist()
        return pa.table({"item_id": pa.array(items_, pa.int64()), "doc_id": pa.array(ids_, pa.int64()), "score": pa.array(scores_, pa.int64())})

    lists = bundled.groupBy("bundle", "item_id").agg(F.sort_array(F.collect_list("hash")).alias("h"))
    packed = F.unhex(F.concat_ws("", F.transform("h", _little_hex)))
    places = dealt.select("block", "bundle").distinct()
    empty = F.lit(b"")
    state = places.join(lists, "bundle").select("block", "bundle", "item_id", packed.alias("terms"), empty.alias("docs"), empty.alias("sums"))
    for step in range(len(OWNERS) + 1):
        here = F.col("owner") == step
        posts = dealt.where(F.col("owner") >= step).select(
            "block", "bundle", "hash", "w", "top", F.when(here, F.col("docs")).alias("docs"), F.when(here, F.col("parts")).alias("parts")
        )
        last = step == len(OWNERS)
        if last:
            ids = places.join(made.select("block", "doc_ids", "nulls"), "block")
            none = F.lit(None).cast("long")
            posts = posts.unionAll(ids.select("block", "bundle", none, none, none, F.col("doc_ids"), F.col("nulls")))
        posts = posts.withColumnsRenamed({"block": "of_block", "bundle": "of_bundle"})
        both = state.groupBy("block", "bundle").cogroup(posts.groupBy("of_block", "of_bundle"))
        state = both.applyInArrow(chosen if last else carried, CHOSEN if last else STATE)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return state.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _little_hex(value):
    """The eight bytes of a long in hex, the lowest first."""
    whole = F.lpad(F.hex(value), 16, "0")
    return F.concat(*(F.substring(whole, 15 - 2 * i, 2) for i in range(8)))


SQL = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
sizes AS MATERIALIZED (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n FROM docs),
whole AS MATERIALIZED (SELECT CAST(count(*) FILTER (n > 0) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
asked AS MATERIALIZED (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
tf AS MATERIALIZED (
  SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS MATERIALIZED (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, whole GROUP BY term, n_docs),
scored AS MATERIALIZED (
  SELECT item_id, r, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms))))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (r), whole
  GROUP BY item_id, r, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST, r) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
