"""Array helpers that stay inside one row: no shuffle, no Python.

A message and its spans sit in one row, so order-dependent work (offsets,
overlap chains, greedy matching) is done on arrays.  The helpers below keep
that work close to linear in the length of the array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 16
LOWEST = -(2**31)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it as often as needed in ``body``.

    The accumulator of an aggregate is handed to its finish step without being
    copied, so binding a large array costs nothing.  Any array used inside a
    lambda must be bound this way: the optimizer may inline the column it came
    from, and an inlined expression in a lambda runs once per element.
    """
    return F.aggregate(F.array(F.lit(0)), value, lambda acc, _x: acc, body)


def pin(df: DataFrame, *keep: str | Column, **columns: Column) -> DataFrame:
    """Select ``keep`` plus computed columns that are evaluated once.

    The values pass through a one-element generator.  Filters on them (also
    the ones the optimizer derives from a later explode) stay above it, so a
    costly expression is neither evaluated a second time nor moved in front
    of a repartition.
    """
    fields = [value.alias(name) for name, value in columns.items()]
    return df.select(*keep, F.inline(F.array(F.struct(*fields))))


def indices(n: Column) -> Column:
    """0 .. n-1, and an empty array for n = 0."""
    return F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)


def empty(element_type: str) -> Column:
    return F.expr(f"cast(array() as array<{element_type}>)")


def running(values: Column, combine: Callable[[Column, Column], Column], zero: int) -> Column:
    """For every element, ``combine`` over all elements before it.

    Works block by block: one pass for block totals, one over the short list
    of totals, one inside each block.
    """
    start = F.lit(zero).cast("int")

    def over_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda blk: F.aggregate(blk, start, combine))
        carries = F.aggregate(
            totals,
            F.array(start),
            lambda acc, t: F.concat(acc, F.array(combine(F.element_at(acc, -1), t))),
        )
        return let(
            carries,
            lambda carry: F.flatten(
                F.transform(
                    blocks,
                    lambda blk, b: let(
                        F.get(carry, b),
                        lambda base: F.transform(
                            blk,
                            lambda _x, j: F.aggregate(F.slice(blk, F.lit(1), j), base, combine),
                        ),
                    ),
                )
            ),
        )

    def split(vals: Column) -> Column:
        n_blocks = F.ceil(F.size(vals) / F.lit(BLOCK)).cast("int")
        return F.transform(
            indices(n_blocks), lambda b: F.slice(vals, b * BLOCK + 1, F.lit(BLOCK))
        )

    return let(values, lambda vals: let(split(vals), over_blocks))


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b, 0)


def running_max(values: Column) -> Column:
    return running(values, lambda a, b: F.greatest(a, b), LOWEST)


def count_below(ordered: Column, value: Column) -> Column:
    """How many elements of an ascending array are smaller than ``value``.

    Leaps of halving width: their number grows with the logarithm of the length.
    Bind ``ordered`` with ``let`` when this runs inside a lambda.
    """
    steps = F.sequence(F.ceil(F.log2(F.size(ordered) + 1)).cast("int"), F.lit(0), F.lit(-1))

    def leap(below: Column, power: Column) -> Column:
        further = below + F.call_function("shiftleft", F.lit(1), power)
        # beyond the end there is NULL, which is not smaller
        return F.when(F.get(ordered, further - 1) < value, further).otherwise(below)

    return F.aggregate(steps, F.lit(0), leap)


def ranges_hit(first: Column, stop: Column, r: Column) -> Column:
    """array<struct<l, r>> for l in first .. stop-1."""
    return F.transform(
        F.filter(F.sequence(first, F.greatest(stop - 1, first)), lambda i: i < stop),
        lambda i: F.struct(i.alias("l"), r.alias("r")),
    )


def islands(spans: Column) -> Column:
    """Split spans into chains of overlapping ones.

    ``spans`` is an array of structs whose first two fields are ``start`` and
    ``end`` (half-open).  Two spans that overlap always share an island, so
    any logic that only looks at overlapping spans can run per island.
    """

    def cut(s: Column) -> Column:
        reach = running_max(F.transform(s, lambda x: x["end"].cast("int")))
        return let(
            reach,
            lambda far: F.filter(
                indices(F.size(s)), lambda i: F.get(s, i)["start"] >= F.get(far, i)
            ),
        )

    def group(s: Column) -> Column:
        return let(
            cut(s),
            lambda cuts: F.transform(
                cuts,
                lambda c, k: F.slice(
                    s, c + 1, F.coalesce(F.get(cuts, k + 1), F.size(s)) - c
                ),
            ),
        )

    return let(F.sort_array(spans), group)
