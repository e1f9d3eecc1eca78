"""Span resolution and greedy matching as expressions over span arrays.

Span arrays hold structs with at least ``start``, ``end`` and ``claim_type``;
their order is the order greedy matching follows.  Each function first splits
the spans into islands of overlap, then folds inside an island, so the cost
follows the local overlap and not the number of spans in a message.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import empty, islands, let

PAIR_TYPE = "struct<pred:int,gt:int,score:double,used:boolean>"


def overlap_length(a: Column, b: Column) -> Column:
    return F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])


def iou(a: Column, b: Column) -> Column:
    inter = F.greatest(overlap_length(a, b), F.lit(0))
    union = (a["end"] - a["start"]) + (b["end"] - b["start"]) - inter
    return F.coalesce(F.try_divide(inter.cast("double"), union.cast("double")), F.lit(0.0))


def coverage(pred: Column, gt: Column) -> Column:
    """Share of the gold span that the prediction covers."""
    inter = F.greatest(overlap_length(pred, gt), F.lit(0))
    return F.coalesce(
        F.try_divide(inter.cast("double"), (gt["end"] - gt["start"]).cast("double")), F.lit(0.0)
    )


def _pick(ord_: Column, score: Column) -> Column:
    return F.struct(ord_.alias("ord"), score.alias("score"))


def first_same_type(pred: Column, free: Column) -> Column:
    hits = F.filter(
        free, lambda g: (overlap_length(pred, g) > 0) & (g["claim_type"] == pred["claim_type"])
    )
    return F.get(F.transform(hits, lambda g: _pick(g["ord"], F.lit(1.0))), F.lit(0))


def first_any_type(pred: Column, free: Column) -> Column:
    hits = F.filter(free, lambda g: overlap_length(pred, g) > 0)
    return F.get(F.transform(hits, lambda g: _pick(g["ord"], F.lit(1.0))), F.lit(0))


def _best(scored: Column) -> Column:
    """Highest score; the earliest gold span among equals."""
    top = F.array_max(scored)
    return F.when(top.isNotNull(), _pick(-top["neg"], top["score"]))


def best_iou(pred: Column, free: Column) -> Column:
    scored = F.transform(
        free, lambda g: F.struct(iou(pred, g).alias("score"), (-g["ord"]).alias("neg"))
    )
    return let(F.filter(scored, lambda s: s["score"] > 0), _best)


def best_coverage(pred: Column, free: Column) -> Column:
    same = F.filter(free, lambda g: g["claim_type"] == pred["claim_type"])
    scored = F.transform(
        same, lambda g: F.struct(coverage(pred, g).alias("score"), (-g["ord"]).alias("neg"))
    )
    return let(F.filter(scored, lambda s: s["score"] > 0.5), _best)


def always(pred: Column, gt: Column, pick: Column) -> Column:
    return F.lit(True)


def match_spans(
    gt: Column,
    pred: Column,
    choose: Callable[[Column, Column], Column],
    consume: Callable[[Column, Column, Column], Column] = always,
) -> Column:
    """Greedy matching: array<struct<pred, gt, score, used>>.

    Every prediction yields one entry (``gt`` NULL when nothing was chosen);
    every gold span nobody consumed yields one entry with ``pred`` NULL.
    ``consume`` tells whether a chosen gold span is taken out of play.
    """

    def tagged(spans: Column, side: int) -> Column:
        return F.transform(
            spans,
            lambda s, i: F.struct(
                s["start"].cast("int").alias("start"),
                s["end"].cast("int").alias("end"),
                F.lit(side).alias("side"),
                i.alias("ord"),
                s["claim_type"].alias("claim_type"),
            ),
        )

    def one_side(isl: Column, side: int) -> Column:
        kept = F.transform(
            F.filter(isl, lambda s: s["side"] == side),
            lambda s: F.struct(s["ord"], s["start"], s["end"], s["claim_type"]),
        )
        return F.sort_array(kept)

    def fold(golds: Column, preds: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            free = F.filter(golds, lambda g: ~F.array_contains(acc["used"], g["ord"]))

            def record(pick: Column) -> Column:
                chosen = F.get(F.filter(golds, lambda g: g["ord"] == pick["ord"]), F.lit(0))
                taken = pick.isNotNull() & consume(p, chosen, pick)
                return F.struct(
                    F.when(taken, F.concat(acc["used"], F.array(pick["ord"])))
                    .otherwise(acc["used"])
                    .alias("used"),
                    F.concat(
                        acc["out"],
                        F.array(
                            F.struct(
                                p["ord"].alias("pred"),
                                pick["ord"].alias("gt"),
                                pick["score"].alias("score"),
                                F.coalesce(taken, F.lit(False)).alias("used"),
                            )
                        ),
                    ).alias("out"),
                )

            return let(choose(p, free), record)

        def finish(acc: Column) -> Column:
            missed = F.transform(
                F.filter(golds, lambda g: ~F.array_contains(acc["used"], g["ord"])),
                lambda g: F.struct(
                    F.lit(None).cast("int").alias("pred"),
                    g["ord"].alias("gt"),
                    F.lit(None).cast("double").alias("score"),
                    F.lit(False).alias("used"),
                ),
            )
            return F.concat(acc["out"], missed)

        start = F.struct(empty("int").alias("used"), empty(PAIR_TYPE).alias("out"))
        return F.aggregate(preds, start, step, finish)

    def per_island(isl: Column) -> Column:
        return let(one_side(isl, 0), lambda g: let(one_side(isl, 1), lambda p: fold(g, p)))

    both = F.concat(tagged(gt, 0), tagged(pred, 1))
    return F.flatten(F.transform(islands(both), per_island))


def resolve_overlaps(spans: Column) -> Column:
    """Keep longer spans: each new span meets the kept ones in list order.

    At the first conflict it replaces the kept span when its text is strictly
    longer (and goes to the end of the list, with no further check), else it
    is dropped.  The result is ordered by start.
    """

    def fold(isl: Column, kind: str) -> Column:
        def step(kept: Column, s: Column) -> Column:
            def place(hit: Column) -> Column:
                return (
                    F.when(hit.isNull(), F.concat(kept, F.array(s)))
                    .when(
                        s["neg_len"] < hit["neg_len"],
                        F.concat(F.filter(kept, lambda k: k["ord"] != hit["ord"]), F.array(s)),
                    )
                    .otherwise(kept)
                )

            clash = F.filter(kept, lambda k: ~((s["end"] <= k["start"]) | (s["start"] >= k["end"])))
            return let(F.get(clash, F.lit(0)), place)

        order = F.sort_array(
            F.transform(
                isl,
                lambda s: F.struct(s["start"], s["neg_len"], s["ord"], s["end"]),
            )
        )
        return F.aggregate(order, empty(kind), step)

    kind = "struct<start:int,neg_len:int,ord:int,end:int>"

    def resolve(bound: Column) -> Column:
        def back(kept: Column) -> Column:
            # by start; entries of equal start keep their list position
            return F.transform(
                F.sort_array(
                    F.transform(kept, lambda k, i: F.struct(k["start"], i.alias("i"), k["ord"]))
                ),
                lambda k: F.get(bound, k["ord"]),
            )

        tagged = F.transform(
            bound,
            lambda s, i: F.struct(
                s["start"].cast("int").alias("start"),
                s["end"].cast("int").alias("end"),
                (-F.length(s["text"])).alias("neg_len"),
                i.alias("ord"),
            ),
        )
        return back(F.flatten(F.transform(islands(tagged), lambda isl: fold(isl, kind))))

    return let(spans, resolve)


def overlapping_pairs(spans: Column) -> Column:
    """array<struct<a, b>> of list positions a < b whose spans intersect."""
    tagged = F.transform(
        spans,
        lambda s, i: F.struct(
            s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), i.alias("ord")
        ),
    )

    def pairs(isl: Column) -> Column:
        return F.flatten(
            F.transform(
                isl,
                lambda x: F.transform(
                    F.filter(
                        isl,
                        lambda y: (x["ord"] < y["ord"])
                        & ~((x["end"] <= y["start"]) | (y["end"] <= x["start"])),
                    ),
                    lambda y: F.struct(x["ord"].alias("a"), y["ord"].alias("b")),
                ),
            )
        )

    return F.flatten(F.transform(islands(tagged), pairs))


def cross_overlaps(left: Column, right: Column) -> Column:
    """array<struct<l, r>> of positions in two lists whose spans intersect."""

    def tagged(spans: Column, side: int) -> Column:
        return F.transform(
            spans,
            lambda s, i: F.struct(
                s["start"].cast("int").alias("start"),
                s["end"].cast("int").alias("end"),
                F.lit(side).alias("side"),
                i.alias("ord"),
            ),
        )

    def pairs(isl: Column) -> Column:
        return let(
            F.filter(isl, lambda s: s["side"] == 1),
            lambda rights: F.flatten(
                F.transform(
                    F.filter(isl, lambda s: s["side"] == 0),
                    lambda x: F.transform(
                        F.filter(rights, lambda y: overlap_length(x, y) > 0),
                        lambda y: F.struct(x["ord"].alias("l"), y["ord"].alias("r")),
                    ),
                )
            ),
        )

    return F.flatten(F.transform(islands(F.concat(tagged(left, 0), tagged(right, 1))), pairs))
