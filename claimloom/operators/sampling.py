"""Deterministic splits and samples of exact size.

Rows are ordered by ``md5(seed:id)``.  An exact rank cut needs no global sort:
a histogram over the first hex digits of the hash finds the cell that holds
the cut, only that cell is ranked, and the cut is then a plain comparison
against one (hash, id) pair per class.  Ids are taken to be unique.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import let, pin
from ..functions.constants import GOLD_QUOTAS, PILOT_SIZE, POOL_TARGETS
from ..session import stage

CELL_DIGITS = 4  # 65,536 cells per class
Need = Callable[[Column], Column]


def hash_key(seed: int | str, id_column: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")))


def hashed(df: DataFrame, id_column: str, seed) -> DataFrame:
    """Add the id as text, its hash and its histogram cell."""
    return df.withColumns(
        {
            "_id": F.col(id_column).cast("string"),
            "_h": hash_key(seed, id_column),
            "_cell": F.substring(hash_key(seed, id_column), 1, CELL_DIGITS),
        }
    )


def _histogram(df: DataFrame, id_column: str, seed, by: list[str]) -> tuple[DataFrame, DataFrame]:
    keyed = hashed(df, id_column, seed).select(*by, "_id", "_h", "_cell")
    cells = keyed.groupBy(*by, "_cell").agg(F.count("*").alias("_in"))
    earlier = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumns(
        {
            "_before": F.coalesce(F.sum("_in").over(earlier), F.lit(0)),
            "_n": F.sum("_in").over(Window.partitionBy(*by)),
        }
    )
    return keyed, cells


def cut_points(
    df: DataFrame,
    id_column: str,
    seed,
    needs: dict[str, Need],
    by: list[str] | None = None,
    widen: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Per class one row with, per entry of ``needs``, the (hash, id) of the
    row at that rank; NULL where nothing is needed.  A class size ``n`` is
    passed to each need; ``widen`` may add columns to the cell table first."""
    by = by or []
    keyed, cells = _histogram(df, id_column, seed, by)
    if widen is not None:
        cells = widen(cells)
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("name"), need(F.col("_n")).cast("long").alias("rank"))
            for name, need in needs.items()
        ]
    )
    hits = (
        cells.withColumn("_w", F.explode(wanted))
        .where(
            (F.col("_w.rank") > F.col("_before"))
            & (F.col("_w.rank") <= F.col("_before") + F.col("_in"))
        )
        .groupBy(*by, "_cell", "_before")
        .agg(F.collect_list("_w").alias("_ws"))
    )
    # hits: at most one row per class and need
    inside = Window.partitionBy(*by, "_cell").orderBy("_h", "_id")
    edge = (
        keyed.join(hits, [*by, "_cell"])
        .withColumn("_rank", F.col("_before") + F.row_number().over(inside))
        .withColumn("_w", F.explode("_ws"))
        .where(F.col("_rank") == F.col("_w.rank"))
    )
    at = F.struct("_h", "_id")
    return edge.groupBy(*by).agg(
        *[F.max(F.when(F.col("_w.name") == name, at)).alias(f"_cut_{name}") for name in needs]
    )


def assign(
    df: DataFrame,
    id_column: str,
    seed,
    parts: dict[str, Need],
    rest: str,
    by: list[str] | None = None,
    column: str = "split",
    widen: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add ``column``: the first part whose cumulative need covers the row."""
    by = by or []
    cuts = F.broadcast(cut_points(df, id_column, seed, parts, by, widen))
    key = F.struct(
        hash_key(seed, id_column).alias("_h"), F.col(id_column).cast("string").alias("_id")
    )
    joined = df.join(cuts, by, "left") if by else df.join(cuts, how="left")
    choice = F.lit(rest)
    for name in reversed(list(parts)):
        choice = F.when(key <= F.col(f"_cut_{name}"), F.lit(name)).otherwise(choice)
    return joined.withColumn(column, choice).drop(*[f"_cut_{name}" for name in parts])


def stratified_split(
    messages: DataFrame, seed: int = 42, test_share: float = 0.2, unlabelled: str = "smish"
) -> DataFrame:
    """80/20 per class: ceil(share * n) go to test.

    ``unlabelled="smish"``: everything that is not ham is the other class.
    ``unlabelled="train"``: other labels stay in train; without any ham or
    smish label the whole set is split instead.
    """
    label = F.col("label")
    ham = label.eqNullSafe(F.lit("ham"))
    if unlabelled == "smish":
        stratum, widen = F.when(ham, "ham").otherwise("smish"), None

        def need(n: Column) -> Column:
            return F.ceil(n * F.lit(test_share))

    else:
        smish = label.eqNullSafe(F.lit("smish"))
        stratum = F.when(ham, "ham").when(smish, "smish").otherwise("other")

        def widen(cells: DataFrame) -> DataFrame:
            labelled = F.sum(F.when(F.col("_stratum") != "other", F.col("_in")))
            return cells.withColumn(
                "_labelled", F.coalesce(labelled.over(Window.partitionBy()), F.lit(0))
            )

        def need(n: Column) -> Column:
            keep = (F.col("_stratum") == "other") & (F.col("_labelled") > 0)
            return F.when(keep, 0).otherwise(F.ceil(n * F.lit(test_share)))

    rows = messages.withColumn("_stratum", stratum)
    return assign(
        rows, "message_id", seed, {"test": need}, "train", ["_stratum"], widen=widen
    ).drop("_stratum")


def three_way_split(
    messages: DataFrame, seed: int = 42, train: float = 0.67, val: float = 0.17
) -> DataFrame:
    """train/val/test of int(train*n), int(val*n) and the remainder."""
    parts = {
        "train": lambda n: F.floor(n * F.lit(train)),
        "val": lambda n: F.floor(n * F.lit(train)) + F.floor(n * F.lit(val)),
    }
    return assign(messages, "message_id", seed, parts, "test")


def nested_split(
    messages: DataFrame, label: str, seed: int = 42, test: float = 0.15, val: float = 0.176
) -> DataFrame:
    """Per class: ceil(test*n) test, then ceil(val*rest) validation."""

    def test_n(n: Column) -> Column:
        return F.ceil(n * F.lit(test))

    parts = {"test": test_n, "val": lambda n: test_n(n) + F.ceil((n - test_n(n)) * F.lit(val))}
    return assign(messages, "message_id", seed, parts, "train", [label])


def kfold_assign(messages: DataFrame, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """fold = exact rank in the class modulo k."""
    keyed, cells = _histogram(messages, "message_id", seed, [label])
    inside = Window.partitionBy(label, "_cell").orderBy("_h", "_id")
    # a cell is a key of its own, so no class meets in one place; Spark chooses the join
    ranked = keyed.join(cells.select(label, "_cell", "_before"), [label, "_cell"])
    rank = F.col("_before") + F.row_number().over(inside) - 1
    return ranked.select(
        F.col("_id").alias("message_id"), label, F.pmod(rank, F.lit(k)).cast("int").alias("fold")
    )


def sample_n(messages: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows in hash order; all when there are fewer."""
    picked = assign(
        messages, "message_id", seed, {"in": lambda size: F.least(F.lit(n), size)}, "out", column="_pick"
    )
    return picked.where(F.col("_pick") == "in").drop("_pick")


def proportional_sample(rows: DataFrame, size: int = 150, seed: int = 42) -> DataFrame:
    """Ids and strata of a sample stratified by claim count (ham counts as 0).

    Per stratum int(size * share), at least 5, at most all; then trimmed.
    The claim counts are staged once, since both cuts pass over them.
    """
    ham = F.col("label").eqNullSafe(F.lit("ham"))
    strata = stage(
        rows.select("message_id", F.when(ham, 0).otherwise(F.size("spans")).alias("stratum")), "strata"
    )

    def widen(cells: DataFrame) -> DataFrame:
        total = cells.agg(F.sum("_in").alias("_all"))
        return cells.join(F.broadcast(total))

    def need(n: Column) -> Column:
        share = n.cast("double") / F.col("_all")
        return F.least(F.greatest(F.floor(F.lit(size) * share), F.lit(5)), n)

    first = assign(strata, "message_id", seed, {"in": need}, "out", ["stratum"], "_pick", widen)
    picked = first.where(F.col("_pick") == "in").drop("_pick")
    return sample_n(picked, size, seed + 1)


def annotation_pool(messages: DataFrame, order: str, seed: int = 42) -> DataFrame:
    """The annotation pool: first smishing messages in input order, random
    ham and spam; in hash order, the pilot marked."""

    def top(label: str, *keys: Column) -> DataFrame:
        return messages.where(F.col("label") == label).orderBy(*keys).limit(POOL_TARGETS[label])

    h = hash_key(seed, "message_id")
    pool = (
        top("smishing", F.col(order))
        .unionByName(top("ham", h, F.col("message_id")))
        .unionByName(top("spam", h, F.col("message_id")))
    )
    # the pool has a fixed size, so one window over it is bounded
    place = F.row_number().over(Window.orderBy(hash_key(f"{seed}:pool", "message_id"), "message_id"))
    return pool.withColumn("position", place).withColumn("pilot", F.col("position") <= PILOT_SIZE)


def gold_quota_sample(
    messages: DataFrame,
    spans: DataFrame,
    target: int = 300,
    quotas: dict[str, int] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Messages for a gold set: quotas per rare type, filled up half and half.

    Types are served in order, each from messages not picked before.  The
    first q of a type that are still free always lie among its first
    (sum of quotas so far), and the fill among the first ``target`` of a
    label, so short candidate lists suffice and the picking is exact; its cost is
    linear in ``target``.
    """
    quotas = GOLD_QUOTAS if quotas is None else quotas
    known = spans.join(messages.select("message_id"), "message_id", "left_semi")
    depth = sum(quotas.values())
    h = hash_key(seed, "message_id")

    by_type = known.where(F.col("claim_type").isin(list(quotas))).select(
        F.col("claim_type").alias("group"), "message_id", h.alias("_h")
    )
    by_label = messages.where(F.col("label").isin("ham", "smish")).select(
        F.col("label").alias("group"), "message_id", h.alias("_h")
    )
    # ids and hashes only, derived once
    narrow = stage(by_type.distinct().unionByName(by_label), "candidates")
    most = F.lit(max(depth, target))
    cuts = cut_points(narrow, "message_id", seed, {"n": lambda size: F.least(size, most)}, ["group"])
    key = F.struct(F.col("_h"), F.col("message_id").cast("string").alias("_id"))
    lists = narrow.join(cuts, "group").where(key <= F.col("_cut_n")).drop("_cut_n")
    packed = lists.groupBy("group").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_h", "message_id"))), lambda x: x["message_id"]).alias("ids")
    )
    table = packed.agg(F.map_from_entries(F.collect_list(F.struct("group", "ids"))).alias("lists"))

    def pick(chosen: Column, group: Column | str, n: Column) -> Column:
        key = F.lit(group) if isinstance(group, str) else group
        ids = F.coalesce(F.try_element_at("lists", key), F.array().cast("array<string>"))
        # set difference by hash, in the order of ids
        return F.concat(chosen, F.slice(F.array_except(ids, chosen), F.lit(1), F.greatest(n, F.lit(0))))

    steps = F.array(
        *[F.struct(F.lit(t).alias("group"), F.lit(q).alias("n")) for t, q in quotas.items()]
    )

    def fill(chosen: Column) -> Column:
        # both fills exclude the quota picks; ham and smish cannot overlap
        room = F.greatest(F.lit(target) - F.size(chosen), F.lit(0))
        ham_n = F.floor(room / 2).cast("int")
        return let(
            pick(chosen, "ham", ham_n), lambda both: pick(both, "smish", (room - ham_n).cast("int"))
        )

    by_quota = F.aggregate(
        steps, F.array().cast("array<string>"), lambda acc, s: pick(acc, s["group"], s["n"])
    )
    done = pin(table, picked=let(by_quota, fill))
    return done.select(F.explode("picked").alias("message_id"))
