"""Folds over arrays in native expressions that take time in proportion to the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a part: a part's running values are copied once an element.
PART = 128


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """The fold of each prefix of an array: element i is ``merge`` of element i - 1 (first of ``zero``) and value i.

    ``merge`` must be associative, and values of the type of ``zero``. The array is folded in parts, whose totals give where each part
    begins, so no running array grows with the whole one. An empty array gives an empty one.
    """

    def grown(part: Column, begin: Column) -> Column:
        return F.aggregate(part, F.array(begin), lambda acc, x: F.concat(acc, F.array(merge(F.element_at(acc, -1), x))))

    def in_parts(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, zero, lambda acc, x: merge(acc, x)))
        begins = let(grown(totals, zero), lambda b: F.slice(b, F.lit(1), F.size(b) - 1))
        return F.flatten(F.zip_with(parts, begins, lambda p, b: F.slice(grown(p, b), F.lit(2), F.size(p))))

    def whole(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / PART).cast("int"))
        parts = F.transform(numbers, lambda k: F.slice(v, k * PART + 1, F.lit(PART)))
        return F.when(F.size(v) > 0, let(parts, in_parts)).otherwise(F.slice(v, F.lit(1), F.lit(0)))

    return let(values, whole)
