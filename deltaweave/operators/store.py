"""Triple store: one table, eight patterns; `?` stands for any value."""

from __future__ import annotations

from pyspark.sql import DataFrame


def put(store: DataFrame, new: DataFrame) -> DataFrame:
    return store.unionByName(new.select("s", "p", "o")).dropDuplicates()


def get(store: DataFrame, s: str = "?", p: str = "?", o: str = "?") -> DataFrame:
    for name, value in (("s", s), ("p", p), ("o", o)):
        if value != "?":
            store = store.where(store[name] == value)
    return store.select("s", "p", "o")


def get_many(store: DataFrame, asked: DataFrame) -> DataFrame:
    """The triples that agree with some row of `asked` in the columns (of s, p, o) that it has."""
    on = [c for c in ("s", "p", "o") if c in asked.columns]
    return store.join(asked.select(*on).distinct(), on, "left_semi").select("s", "p", "o")
