"""Set operations on array columns and on keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def includes(a: Column, b: Column) -> Column:
    """Whether a holds all of b."""
    return F.size(F.array_except(b, a)) == 0


def set_less(a: Column, b: Column) -> Column:
    """A total order of sets: by their sorted elements."""
    return F.array_sort(F.array_distinct(a)) < F.array_sort(F.array_distinct(b))


def insert(a: Column, x: Column) -> Column:
    return F.array_sort(F.array_union(a, F.array(x)))


def erase(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def power_set(a: Column) -> Column:
    """All subsets, by the bits of 0 to 2^n - 1; for sets of at most 30 elements."""
    bits = F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), F.size(a)) - 1)
    return F.transform(bits, lambda n: F.filter(a, lambda _, i: F.call_function("shiftright", n, i).bitwiseAND(F.lit(1)) == 1))


def remove_by_index(a: Column, drop: Column) -> Column:
    """The array without the elements at these places (from 0)."""
    return F.filter(a, lambda _, i: ~F.array_contains(drop, i))


def classes(table: DataFrame, key: str, value: str) -> DataFrame:
    """(value, keys): the sorted key set of each value."""
    return table.groupBy(value).agg(F.array_sort(F.collect_set(key)).alias("keys"))


def row(cells: DataFrame, r) -> DataFrame:
    """Of a table of cells (r, c, v): one row as (c, v)."""
    return cells.where(F.col("r") == r).select("c", "v")


def column(cells: DataFrame, c) -> DataFrame:
    return cells.where(F.col("c") == c).select("r", "v")


def put_cells(cells: DataFrame, new: DataFrame) -> DataFrame:
    """cells with the new ones in place of those at the same row and column."""
    return cells.join(new.select("r", "c"), ["r", "c"], "left_anti").unionByName(new)


def numeric_order(ids: Column) -> list[Column]:
    """Sort keys that order ids such as `main.12` by their prefix, then by number."""
    return [F.regexp_replace(ids, r"[0-9]+$", ""), F.regexp_extract(ids, r"([0-9]+)$", 1).try_cast("long")]
