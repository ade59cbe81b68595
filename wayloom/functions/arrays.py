"""Array idioms on columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once a row.

    A lambda that refers to an expression outside works it out again for every
    element; a lambda's own variable is a value.
    """
    return F.transform(F.array(value), use)[0]


def prefix_sums(values: Column) -> Column:
    """Inclusive running sums of an array of numbers, by doubling: n log n steps."""

    def double(acc: Column, k: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: x + F.when(i >= step, F.get(acc, i - step)).otherwise(F.lit(0).cast("long")))

    def run(a: Column) -> Column:
        rounds = F.filter(F.sequence(F.lit(0), F.lit(30)), lambda k: F.call_function("shiftleft", F.lit(1), k) < F.size(a))
        return F.aggregate(rounds, a, double)

    return let(F.transform(values, lambda x: x.cast("long")), run)
