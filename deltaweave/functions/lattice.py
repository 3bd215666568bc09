"""Lattices as columns: tag 0 top (no information), 1 a value, 2 bottom (any value)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flat_join(tag: str = "tag", value: str = "v") -> tuple[Column, Column]:
    """Aggregates (tag, value) of the flat lattice's join over a group."""
    one = F.when(F.col(tag) == 1, F.col(value))
    clash = F.min(one) != F.max(one)
    joined = F.when((F.max(tag) == 2) | F.coalesce(clash, F.lit(False)), F.lit(2)).otherwise(F.max(tag))
    return joined, F.when(joined == 1, F.min(one))


def label_join(labels: str) -> Column:
    """Aggregate: sorted union of label arrays."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(labels))))


def compose_dfa(first: Column, second: Column) -> Column:
    """Transition arrays indexed by state: first, then second."""
    return F.transform(first, lambda s: F.element_at(second, s + 1))


#: Token -> next state for each state.  stdio: 0 UNINIT, 1 OPENED, 2 CLOSED, 3 ERROR, 4 BOT.
STDIO = {"FOPEN": [1, 1, 1, 3, 1], "FCLOSE": [3, 2, 3, 3, 4], "STAR": [3, 1, 3, 3, 4]}
#: EVP KDF: 0 UNINIT, 1 FETCHED, 2 ERROR, 3 BOT.
EVP_KDF = {"FETCH": [1, 2, 2, 1], "FREE": [2, 0, 2, 3], "STAR": [2, 1, 2, 3]}
#: EVP KDF context: 0 BOT, 1 ATTACHED, 2 PARAM, 3 DERIVED, 4 ERROR, 5 UNINIT.
EVP_KDF_CTX = {"NEW": [1, 1, 1, 1, 4, 1], "SET": [4, 2, 2, 2, 4, 4], "DERIVE": [4, 4, 3, 3, 4, 4], "FREE": [4, 5, 5, 5, 4, 4], "STAR": [4, 1, 2, 3, 4, 4]}
#: Secure memory: 0 BOT, 1 ZEROED, 2 FREED, 3 ERROR, 4 ALLOC.
SECURE_MEMORY = {"MALLOC": [4, 4, 4, 3, 4], "ZALLOC": [1, 1, 1, 3, 1], "FREE": [3, 2, 3, 3, 3], "CLEANSE": [0, 1, 3, 3, 1], "STAR": [0, 4, 2, 3, 4]}


def run_dfa(table: dict[str, list[int]], tokens: Column, start: int) -> Column:
    """The state after an array of tokens; unknown tokens act as STAR."""
    def step(state: Column, token: Column) -> Column:
        out = F.element_at(F.array(*map(F.lit, table["STAR"])), state + 1)
        for name, to in table.items():
            out = F.when(token == name, F.element_at(F.array(*map(F.lit, to)), state + 1)).otherwise(out)
        return out

    return F.aggregate(tokens, F.lit(start), step)
