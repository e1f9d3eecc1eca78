"""Exact Jaccard join on word shingles, with block skipping and derived answers.

Two documents link when their shingle sets have a Jaccard measure of at least
``PERCENT`` / 100; the result names each document's connected component.

1. One pass computes every text's set (``shingles.sets``), its 64-bit signature, its
   size, a parity sketch, and counts of shingles that repeat within blocks of a task.
   Equal sets are one set from here on.
2. Sets are ordered by shingle hash, with frequent shingles last.  Linked sets share
   a shingle among the first ``n - ceil(0.75 n) + 1`` (prefix filter), so only those
   are indexed, sorted by shingle and streamed; no list is held in memory.  Frequent
   are shingles counted in a thousandth of the documents, so there are at most a
   thousand times the mean set size of them: that bounds what is broadcast.
3. Index lists.  The first set of a list is its pivot; pivot and members of fitting
   size are compared first.  Distances to pivots are answers that others reuse: the
   distance (size of the symmetric difference) is a metric, so a set close to its
   pivot inherits the pivot's rejections: |x - y| >= |pivot - y| - |pivot - x|.
   Of lists with the same members only the first in the order is kept: a pair meets
   first in it or in an earlier one.
4. Components of the links so far.  A list inside one component needs no more
   work.  In the others, members of different components are compared by blocks: a
   list is sorted by size, a block of partners is skipped by size, and the rest by the
   positions of the shared shingle (what follows it bounds the overlap), the derived
   bound and short parity sketches that the rows carry.  A list of over LIST_ROWS rows is dealt into blocks by size,
   position and hash, and the pairs of blocks that size, position and component allow
   are groups of their own.  What is left is compared like the pivots' pairs: first a few
   members of each larger component with the others, which joins most of
   what belongs together, then, with the components that gives, all that are still apart.
5. A comparison first bounds the distance by parity sketches (each differing shingle
   flips one bit, so differing bits never exceed the distance), then computes it from
   the sets of the pairs that remain.

No pair of a list is made twice in a block, no list or component is collected, and
between the steps tables are written to the shared folder.

Defined cases: a null text is empty; empty sets link with nothing; rows with equal
text are linked; a null doc_id never is the smallest of a component unless it has no
other; repeated rows each get their row; an empty table gives no rows; other
columns are ignored by ``join`` and kept by ``representatives``.

Signatures and shingles are 64-bit hashes: among 10^9 different texts the odds that
two share a signature are about 3 in 100.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_batch, bit_filter, stage, unstage
from .graph import components
from .shingles import mix, sets

PERCENT = 75
FREQUENT_SHARE = 1000
LEAST_FREQUENT = 20
COUNT_BLOCK = 1 << 22
SEEN = 1 << 19
BLOCK = 512
#: Rows of a list that one group of a task takes; longer lists are dealt into blocks of half of it.
LIST_ROWS = 1 << 14
SPREAD = 1 << 12
SCOUTS = 16
#: Bits of the sketch that index rows carry, so most pairs are rejected where they would be made.
SHORT_BITS = 512
SKETCH_BITS = (64, 1 << 20)

PASS = "doc_id long, sig long, n long, sketch binary, short binary, times long"
POSTING = "token long, sig long, n int, at int"
DEALT = ("token", "i", "j", "sig", "n", "at", "group", "low", "high", "half", "sent")
LISTED = "token long, pivot long, pivot_n int, sig long, n int, at int"
PAIR = "a long, b long, na int, nb int"
#: The largest distance of linked sets of these sizes.
_LIMIT = f"{100 - PERCENT} * (cast(na AS long) + nb) div {100 + PERCENT}"


def prefix(n: np.ndarray | int):
    """How many first shingles of a set of n linked sets must share one of."""
    return n - -(-PERCENT * n // 100) + 1


def signature(x: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = mix(x).sum() ^ mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum() * np.uint64(0x9E3779B97F4A7C15)
    return int(mix(np.array([total + np.uint64(len(x))], dtype=np.uint64)).view(np.int64)[0])


def sketch(x: np.ndarray) -> bytes:
    """Parities of the shingles over hash cells, two cells a shingle at least."""
    bits = min(max(SKETCH_BITS[0], 1 << (2 * len(x)).bit_length()), SKETCH_BITS[1])
    cells = (x >> np.uint64(20)).astype(np.int64) & (bits - 1)
    return np.packbits(np.bincount(cells, minlength=bits) & 1, bitorder="little").tobytes()


def short_sketch(x: np.ndarray) -> bytes:
    """Parities over a fixed number of cells."""
    cells = (x >> np.uint64(20)).astype(np.int64) & (SHORT_BITS - 1)
    return np.packbits(np.bincount(cells, minlength=SHORT_BITS) & 1, bitorder="little").tobytes()


def apart_at_least(a: bytes, b: bytes) -> int:
    """Differing bits of two sketches; the longer one is folded to the shorter."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _texts(batch: pa.RecordBatch) -> Iterator[str | None]:
    return (t.as_py() for t in batch.column(batch.schema.names.index("text")))


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every document, and (token, times) rows, which have no n."""
    held, size = [], 0

    def repeats() -> pa.RecordBatch:
        token, times = np.unique(np.concatenate(held), return_counts=True)
        token, times = token[times > 1], times[times > 1]
        none = [None] * len(token)
        return arrow_batch(PASS, none, token.view(np.int64), none, none, none, times)

    for batch in batches:
        made = list(sets(_texts(batch)))
        yield arrow_batch(
            PASS,
            batch.column(0).to_pylist(),
            [signature(s) if len(s) else None for s in made],
            [len(s) for s in made],
            [sketch(s) for s in made],
            [short_sketch(s) for s in made],
            [None] * len(made),
        )
        held.extend(made)
        size += sum(map(len, made))
        if size >= COUNT_BLOCK:
            yield repeats()
            held, size = [], 0
    if held:
        yield repeats()


def _postings(frequent):
    """The prefix of every set not yet seen in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        seen: set[int] = set()
        for batch in batches:
            out = [[], [], [], []]
            for s in sets(_texts(batch)):
                if not len(s):
                    continue
                sig = signature(s)
                if sig in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(sig)
                if len(often):
                    near = np.searchsorted(often, s)
                    rare = often[np.minimum(near, len(often) - 1)] != s
                    s = np.concatenate((s[rare], s[~rare]))
                p = int(prefix(len(s)))
                out[0].append(s[:p].view(np.int64))
                out[1].append(np.full(p, sig, dtype=np.int64))
                out[2].append(np.full(p, len(s), dtype=np.int32))
                out[3].append(np.arange(p, dtype=np.int32))
            if out[0]:
                yield arrow_batch(POSTING, *map(np.concatenate, out))

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of two sets or more, each row beside the list's pivot, its first set.

    Rows come sorted by token and signature.  Only the last row and the pivot of the
    list under way are carried over.
    """
    last = None
    for batch in batches:
        token, sig, n, at = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if last is not None:
            token, sig, n, at = (np.append([x], y) for x, y in zip(last[0], (token, sig, n, at), strict=True))
        if not len(token):
            continue
        new = np.r_[True, token[1:] != token[:-1]]
        fresh = new | np.r_[True, sig[1:] != sig[:-1]]
        head = np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))
        pivot, pivot_n, pivot_at = sig[head], n[head], at[head]
        if last is not None:
            fresh[0] = False
            same = head == 0
            pivot, pivot_n, pivot_at = (np.where(same, x, y) for x, y in zip(last[1], (pivot, pivot_n, pivot_at), strict=True))
        member = fresh & (sig != pivot)
        started = np.zeros(len(token), dtype=bool)
        rows = np.flatnonzero(member)
        if len(rows):
            starts = rows[np.r_[True, token[rows][1:] != token[rows][:-1]]]
            if last is not None and last[2] and token[starts[0]] == last[0][0]:
                starts = starts[1:]
            started[starts] = True
            heads = (token[starts], pivot[starts], pivot_n[starts], pivot[starts], pivot_n[starts], pivot_at[starts])
            body = (token[rows], pivot[rows], pivot_n[rows], sig[rows], n[rows], at[rows])
            yield arrow_batch(LISTED, *(np.concatenate(x) for x in zip(heads, body, strict=True)))
        was = last is not None and last[2] and token[-1] == last[0][0]
        begun = was or bool((member & (token == token[-1])).any())
        last = ((token[-1], sig[-1], n[-1], at[-1]), (pivot[-1], pivot_n[-1], pivot_at[-1]), begun)


def _wanted_sets(wanted):
    """Signature and set of the texts the bit filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = wanted.value
        seen: set[int] = set()
        for batch in batches:
            out = [], []
            for s in sets(_texts(batch)):
                if not len(s):
                    continue
                sig = signature(s)
                cell = sig & (bits - 1)
                if sig in seen or not int(words[cell >> 5]) >> (cell & 31) & 1:
                    continue
                if len(seen) < SEEN:
                    seen.add(sig)
                out[0].append(sig)
                out[1].append(s.tobytes())
            yield arrow_batch("sig long, members binary", *out)

    return run


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with the least distance their sketches allow."""
    for batch in batches:
        least = [
            apart_at_least(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(least, type=pa.int64())], names=["a", "b", "na", "nb", "least"]
        )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their distance, computed from the sets."""
    for batch in batches:
        na, nb = (c.to_numpy() for c in batch.columns[2:4])
        common = []
        for x, y in zip(batch.column(4), batch.column(5), strict=True):
            x, y = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
            short, long = (x, y) if len(x) <= len(y) else (y, x)
            at = np.searchsorted(long, short)
            common.append(int((long[np.minimum(at, len(long) - 1)] == short).sum()))
        apart = na.astype(np.int64) + nb - 2 * np.array(common, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(apart, type=pa.int64())], names=["a", "b", "na", "nb", "apart"]
        )


def _compare(docs: DataFrame, sketches: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, na, nb, least, exact: the distance, or a lower bound over the limit."""
    spark = docs.sparkSession
    x = sketches.select(F.col("sig").alias("a"), F.col("sketch").alias("x"))
    y = sketches.select(F.col("sig").alias("b"), F.col("sketch").alias("y"))
    drawn = pairs.join(y, "b").join(x, "a").select("a", "b", "na", "nb", "x", "y")
    bounds = stage(drawn.mapInArrow(_bounded, PAIR + ", least long"), "bounds")
    limit = F.expr(_LIMIT)
    close = bounds.where(F.col("least") <= limit).select("a", "b", "na", "nb")
    needed = close.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    needed = stage(needed, "needed")
    wanted = spark.sparkContext.broadcast(bit_filter(needed, "sig", needed.count()))
    members = docs.mapInArrow(_wanted_sets(wanted), "sig long, members binary")
    held = stage(members.join(needed, "sig", "left_semi"), "members")
    members = held.dropDuplicates(["sig"])
    x = members.select(F.col("sig").alias("a"), F.col("members").alias("x"))
    y = members.select(F.col("sig").alias("b"), F.col("members").alias("y"))
    both = close.join(y, "b").join(x, "a").select("a", "b", "na", "nb", "x", "y")
    measured = both.mapInArrow(_measured, PAIR + ", apart long")
    far = bounds.where(F.col("least") > limit)
    made = stage(
        measured.select("a", "b", "na", "nb", F.col("apart").alias("least"), F.lit(True).alias("exact")).unionAll(
            far.select("a", "b", "na", "nb", "least", F.lit(False).alias("exact"))
        ),
        "compared",
    )
    unstage(bounds, needed, held)
    return made


def _links(compared: DataFrame) -> DataFrame:
    limit = F.expr(_LIMIT)
    return compared.where(F.col("exact") & (F.col("least") <= limit)).select("a", "b")


def scouts(group: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Marks up to SCOUTS members of each component with several members in the list.

    They are the smallest by a hash of the signature, so mostly the same in every list.
    """
    order = np.lexsort((mix(sig.view(np.uint64)), group))
    _, first, count = np.unique(group[order], return_index=True, return_counts=True)
    place = np.arange(len(order)) - np.repeat(first, count)
    marked = np.zeros(len(group), dtype=bool)
    marked[order] = (place < SCOUTS) & (np.repeat(count, count) > 1)
    return marked


def cross_pairs(group, n, at, low, high, sig, sent=None, half=None, short=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Undecided pairs of one list: row numbers of members of different components.

    Rows are sorted by size.  Blocks of partners are skipped by size; single ones by
    the positions of the shared shingle, by distances to the pivot and, with ``short``, by
    differing bits of the short sketches.  With ``sent``, one of the two has to be marked
    in it; with ``half``, they have to differ in it.
    """
    for start in range(0, len(n), BLOCK):
        i = np.arange(start, min(start + BLOCK, len(n)))
        reach = int(np.searchsorted(n, n[i[-1]] * 100 // PERCENT, "right"))
        for other in range(start, reach, BLOCK):
            j = np.arange(other, min(other + BLOCK, reach))
            a, b = i[:, None], j[None, :]
            limit = (100 - PERCENT) * (n[a] + n[b]) // (100 + PERCENT)
            overlap = np.minimum(n[a] - at[a], n[b] - at[b])
            keep = (
                (a < b)
                & (group[a] != group[b])
                & (PERCENT * n[b] <= 100 * n[a])
                & (n[a] + n[b] - 2 * overlap <= limit)
                & (np.maximum(low[a] - high[b], low[b] - high[a]) <= limit)
                & (sig[a] != sig[b])
            )
            if sent is not None:
                keep &= sent[a] | sent[b]
            if half is not None:
                keep &= half[a] != half[b]
            x, y = np.nonzero(keep)
            if short is not None and len(x):
                differ = np.bitwise_count(short[i[x]] ^ short[j[y]]).sum(axis=1)
                near = differ <= limit[x, y]
                x, y = x[near], y[near]
            if len(x):
                yield i[x], j[y]


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Undecided pairs of every list; rows come sorted by token and size."""
    return _undecided(batches, scouting=False)


def _scouting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _undecided(batches, scouting=True)


def _undecided(batches: Iterator[pa.RecordBatch], scouting: bool) -> Iterator[pa.RecordBatch]:
    """Rows are those of short lists, or DEALT: pairs of blocks, with half and sent; short sketches may follow."""

    def lists() -> Iterator[list[np.ndarray]]:
        kept = None
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if kept is not None:
                rows = [np.concatenate((x, y)) for x, y in zip(kept, rows, strict=True)]
            keys = rows[:3] if len(rows) >= len(DEALT) else rows[:1]
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            bounds = np.r_[0, cut]
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                yield [c[a:b] for c in rows]
            kept = [c[int(bounds[-1]) :] for c in rows]
        if kept is not None and len(kept[0]):
            yield kept

    out: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        rows = np.unique(np.concatenate(out), axis=0)
        return arrow_batch(PAIR, rows[:, 0], rows[:, 1], rows[:, 2].astype(np.int32), rows[:, 3].astype(np.int32))

    for rows in lists():
        half = short = None
        if len(rows) >= len(DEALT):
            _, i, j, sig, n, at, group, low, high, half, sent, *more = rows
            half = half if i[0] != j[0] else None
            sent = sent if scouting else None
        else:
            _, sig, n, at, group, low, high, *more = rows
            sent = scouts(group, sig) if scouting else None
        if more:
            short = np.frombuffer(b"".join(more[0]), dtype=np.uint64).reshape(len(sig), -1)
        n64 = n.astype(np.int64)
        for i, j in cross_pairs(group, n64, at.astype(np.int64), low, high, sig, sent, half, short):
            first = sig[i] < sig[j]
            a, b = np.where(first, sig[i], sig[j]), np.where(first, sig[j], sig[i])
            na, nb = np.where(first, n64[i], n64[j]), np.where(first, n64[j], n64[i])
            out.append(np.stack((a, b, na, nb), axis=1))
            size += len(i)
            if size >= 1 << 18:
                yield flush()
                out, size = [], 0
    if out:
        yield flush()


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"))


def _by_token(rows: DataFrame, *order: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "token").sortWithinPartitions("token", *order)


def _frequent(spark: SparkSession, first: DataFrame):
    """Shingles counted in a thousandth of the documents, sorted."""
    docs = first.where(F.col("n").isNotNull()).count()
    least = max(LEAST_FREQUENT, docs // FREQUENT_SHARE)
    counted = first.where(F.col("n").isNull()).groupBy("sig").agg(F.sum("times").alias("times"))
    rows = counted.where(F.col("times") >= least).select("sig").toLocalIterator()
    values = np.fromiter((r[0] for r in rows), dtype=np.int64).view(np.uint64)
    return spark.sparkContext.broadcast(np.sort(values))


def _distinct_lists(lists: DataFrame) -> DataFrame:
    """Of lists with the same members, the one whose token comes first in the order."""
    own = F.when(F.col("sig") == F.col("pivot"), F.col("at"))
    members = lists.groupBy("token").agg(
        F.bit_xor(F.xxhash64("sig")).alias("x"),
        F.sum(F.pmod(F.xxhash64(F.lit(7), "sig"), F.lit(1 << 36))).alias("y"),
        F.min(own).alias("place"),
    )
    kept = members.groupBy("x", "y").agg(F.min_by("token", "place").alias("token"))
    return lists.join(kept.select("token"), "token", "left_semi")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sig, n) of every row, and (sig, group) of the sets with a partner."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = stage(rows.mapInArrow(_first_pass, PASS), "sets")
    members = first.where(F.col("n").isNotNull())
    postings = rows.mapInArrow(_postings(_frequent(spark, first)), POSTING)
    every = stage(_by_token(postings, "sig").mapInArrow(_lists, LISTED), "every_list")
    lists = stage(_distinct_lists(every), "lists")
    unstage(every)
    indexed = lists.select("sig").distinct()
    sketches = members.select("sig", "sketch", "short").join(indexed, "sig", "left_semi").dropDuplicates(["sig"])
    sketches = stage(sketches, "sketches")
    fits = F.least("n", "pivot_n").cast("long") * 100 >= F.greatest("n", "pivot_n").cast("long") * PERCENT
    to_pivot = lists.where((F.col("sig") != F.col("pivot")) & fits).select(
        F.col("pivot").alias("a"), F.col("sig").alias("b"), F.col("pivot_n").alias("na"), F.col("n").alias("nb")
    )
    compared = _compare(rows, sketches, _distinct(to_pivot))
    groups = stage(components(_links(compared)), "groups")
    known = compared.select("a", "b")
    left = lists
    for step in (_scouting, _cross):
        wider, left = left, _open_lists(left, groups)
        made, temporary = _open_pairs(left, compared, sketches, step)
        pairs = stage(_distinct(made).join(known, ["a", "b"], "left_anti"), "cross")
        unstage(wider, *temporary)
        more = _compare(rows, sketches, pairs)
        known = known.unionAll(more.select("a", "b"))
        older, groups = groups, stage(_merged(groups, _links(more)), "groups")
        unstage(pairs, older)
    unstage(left, sketches)
    return members, groups.withColumnRenamed("node", "sig")


def _open_lists(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """The lists that hold more than one component, with each row's component and the list's size."""
    named = groups.select(F.col("node").alias("sig"), "group")
    columns = [f.split()[0] for f in LISTED.split(", ")]
    rows = lists.select(*columns).join(named, "sig", "left").select(*columns, F.coalesce("group", "sig").alias("group"))
    rows = stage(rows, "grouped")
    mixed = rows.groupBy("token").agg(F.min("group").alias("x"), F.max("group").alias("y"), F.count("*").alias("size"))
    left = stage(rows.join(mixed.where("x <> y").select("token", "size"), "token"), "open")
    unstage(rows)
    return left


def _open_pairs(left: DataFrame, compared: DataFrame, sketches: DataFrame, step) -> tuple[DataFrame, list]:
    """Undecided pairs of these lists, and the tables that they are read from."""
    near = compared.select(
        F.col("a").alias("pivot"),
        F.col("b").alias("sig"),
        F.col("least").alias("low"),
        F.when(F.col("exact"), F.col("least")).alias("high"),
    )
    own = F.col("sig") == F.col("pivot")
    rows = (
        left.join(near, ["pivot", "sig"], "left")
        .join(sketches.select("sig", "short"), "sig")
        .select(
            "token",
            "sig",
            "n",
            "at",
            "group",
            F.when(own, F.lit(0)).otherwise(F.coalesce("low", F.abs(F.col("n") - F.col("pivot_n")))).cast("long").alias("low"),
            F.when(own, F.lit(0)).otherwise(F.coalesce("high", F.col("n") + F.col("pivot_n"))).cast("long").alias("high"),
            "short",
            "size",
        )
    )
    pairs = _by_token(rows.where(F.col("size") <= LIST_ROWS).drop("size"), "n", "sig").mapInArrow(step, PAIR)
    long = left.where(F.col("size") > LIST_ROWS).select("token").distinct()
    if long.isEmpty():
        return pairs, []
    spread = _spread(rows.where(F.col("size") > LIST_ROWS).drop("size"), long)
    dealt = _block_pairs(spread, step is _scouting)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "sig")
    return pairs.unionAll(dealt.mapInArrow(step, PAIR)), [spread]


def _fine() -> Column:
    return F.pmod(F.xxhash64("sig"), F.lit(SPREAD)).cast("int").alias("fine")


def _spread(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """The rows of these tokens; one token's rows meet it in SPREAD places."""
    copies = tokens.select("token", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("fine"))
    return stage(rows.withColumn("fine", _fine()).join(copies, ["token", "fine"]).drop("fine"), "long")


def _block_pairs(rows: DataFrame, scouting: bool) -> DataFrame:
    """Columns DEALT: the rows of every pair of blocks that may hold undecided pairs.

    Rows are dealt into cells by size (linked sets are in one cell or neighbours), by
    position and by being a scout, and a cell into blocks by hash.
    """
    rows = rows.withColumn("sent", F.lit(False))
    if scouting:
        best = Window.partitionBy("token", "group").orderBy(F.xxhash64("sig"), "sig")
        few = rows.select("token", "group", "sig", F.row_number().over(best).alias("place")).where(F.col("place") <= SCOUTS)
        several = F.count("*").over(Window.partitionBy("token", "group"))
        marks = few.withColumn("several", several).where("several > 1").select("token", "sig", F.lit(True).alias("mark"))
        rows = rows.join(marks, ["token", "sig"], "left").withColumn("sent", F.coalesce("mark", F.lit(False))).drop("mark")
    width = F.floor(F.log("n") / F.log(F.lit(100 / PERCENT)))
    cell = (width * 32 + F.floor(16 * F.col("at") / F.col("n"))) * 2 + F.col("sent").cast("int")
    rows = stage(rows.withColumn("cell", cell.cast("long")).withColumn("fine", _fine()), "celled")
    parts = rows.groupBy("token", "cell", "fine").agg(F.count("*").alias("size"))
    whole = parts.groupBy("token", "cell").agg(F.ceil(2 * F.sum("size") / LIST_ROWS).alias("blocks"))
    parts = parts.select("token", "cell", "fine").join(whole, ["token", "cell"])
    salt = F.pmod(F.xxhash64(F.lit(11), "sig"), F.col("blocks"))
    dealt = rows.join(parts, ["token", "cell", "fine"]).withColumn("block", F.shiftleft("cell", 32) + salt)
    dealt = stage(dealt.drop("cell", "fine", "blocks"), "dealt")
    blocks = dealt.groupBy("token", "block").agg(
        F.min(F.col("n").cast("long")).alias("least"),
        F.max(F.col("n").cast("long")).alias("most"),
        F.max((F.col("n") - F.col("at")).cast("long")).alias("rest"),
        F.min("group").alias("g"),
        F.max("group").alias("h"),
        F.max("sent").alias("sent"),
    )
    x, y = (blocks.select("token", *(F.col(c).alias(c + k) for c in blocks.columns[1:])) for k in "ij")
    allowed = F.expr(
        f"""blocki <= blockj AND {PERCENT} * leasti <= 100 * mostj AND {PERCENT} * leastj <= 100 * mosti
        AND leasti + leastj - 2 * least(resti, restj) <= {100 - PERCENT} * (leasti + leastj) div {100 + PERCENT}
        AND NOT (gi = hi AND gj = hj AND gi = gj)"""
    )
    pairs = x.join(y, "token").where(allowed)
    if scouting:
        pairs = pairs.where("senti OR sentj")
    pairs = stage(pairs.select("token", F.col("blocki").alias("i"), F.col("blockj").alias("j")), "block_pairs")
    sides = pairs.select("token", "i", "j", F.col("i").alias("block"), F.lit(0).alias("half")).unionAll(
        pairs.where("i <> j").select("token", "i", "j", F.col("j").alias("block"), F.lit(1).alias("half"))
    )
    return dealt.join(sides, ["token", "block"]).select(*DEALT, *(c for c in ("short",) if c in dealt.columns))


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(node, group) after further links between components and single sets."""
    named = groups.select("node", "group")
    x = named.select(F.col("node").alias("a"), F.col("group").alias("ga"))
    y = named.select(F.col("node").alias("b"), F.col("group").alias("gb"))
    between = links.join(x, "a", "left").join(y, "b", "left").select(
        F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b")
    )
    upper = stage(components(between.distinct()), "upper").select(F.col("node").alias("g"), F.col("group").alias("top"))
    lifted = named.join(upper, named["group"] == upper["g"], "left").select(
        "node", F.coalesce("top", "group").alias("group")
    )
    alone = upper.join(named.select(F.col("group").alias("g")).distinct(), "g", "left_anti")
    return lifted.unionAll(alone.select(F.col("g").alias("node"), F.col("top").alias("group")))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    members, groups = classes(docs)
    least = members.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"))
    named = stage(least.join(groups, "sig", "left").withColumn("group", F.coalesce("group", "sig")), "named")
    smallest = named.groupBy("group").agg(F.min("least").alias("component"))
    by_sig = named.join(smallest, "group").select("sig", "component")
    return members.select("doc_id", "sig", F.col("n").alias("n_shingles")).join(by_sig, "sig", "left").select(
        "doc_id", "n_shingles", F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id")
    )


def _tagged(name: str):
    """The rows as they come with the signature of their set; null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [signature(s) if len(s) else None for s in sets(_texts(batch))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, type=pa.int64())], names=[*batch.schema.names, name])

    return run


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each component, as it came; rows with empty sets all stay.

    It is the one with the smallest doc_id (a null one last), then with the smallest
    signature; of several such rows any one.  So of repeated rows one stays, of copies
    with null ids one, and rows with one id and unlinked texts all stay.
    """
    members, groups = classes(docs)
    rows = members.where("n > 0").groupBy("sig", "doc_id").agg(F.count("*").alias("times"))
    rows = rows.join(groups, "sig", "left").withColumn("group", F.coalesce("group", "sig"))
    rows = stage(rows, "rows")
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "sig", "times")).alias("f")
    best = stage(rows.groupBy("group").agg(first).select("f.none", F.coalesce("f.doc_id", F.lit(0)).alias("id"), "f.sig", "f.times"), "best")
    key = [F.isnull("doc_id").alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "sig"]
    gone = rows.select(*key).join(best, ["none", "id", "sig"], "left_anti")
    several = best.where("times > 1").drop("times")
    own = "sig"
    while own in docs.columns:
        own += "_"
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    tagged = docs.mapInArrow(_tagged(own), f"{plain}, {own} long")

    def same(side: DataFrame):
        return (
            (tagged[own] == side["sig"])
            & (F.coalesce(tagged["doc_id"].cast("long"), F.lit(0)) == side["id"])
            & (F.isnull(tagged["doc_id"]) == side["none"])
        )

    kept = tagged.join(gone, same(gone), "left_anti")
    if several.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(several, same(several), "left_anti")
    repeated = kept.join(several, same(several), "left_semi").dropDuplicates(["doc_id", own])
    return once.select(*docs.columns).unionAll(repeated.select(*docs.columns))
