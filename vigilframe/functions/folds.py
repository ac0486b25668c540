"""Order-free aggregate expressions.

Every "first", "last" or "newest" is a max_by/min_by over an explicit order, so the value combines map-side
and never needs a whole group in one place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def newest(value: Column, *order: Column) -> Column:
    return F.max_by(value, F.struct(*order))


def oldest(value: Column, *order: Column) -> Column:
    return F.min_by(value, F.struct(*order))


def joined(values: Column, sep: str = ",") -> Column:
    return F.array_join(values, sep)


def distinct_sorted(value: Column) -> Column:
    return F.array_sort(F.collect_set(value))


def once(value: Column, body) -> Column:
    """``body`` of ``value``; the plan holds ``value`` a single time."""
    return F.transform(F.array(value), body)[0]
