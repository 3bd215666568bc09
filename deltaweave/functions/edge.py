"""Edge functions as columns: what an edge of the exploded graph does to a value, with composition and join.

A semiring names the functions' type and gives `identity`, `compose(first, second)`, the aggregate `join(name)`,
`apply(function, value)` and the values' aggregate `value_join(name)`.  Top (no information) is a missing row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Semiring:
    schema: str
    identity: Column
    compose: Callable[[Column, Column], Column]
    join: Callable[[str], Column]
    apply: Callable[[Column, Column], Column]
    value_join: Callable[[str], Column]


#: Without values: reachability alone.
def reachability() -> Semiring:
    one = F.lit(0)
    return Semiring("int", one, lambda a, b: one, lambda c: F.min(c), lambda f, v: v, lambda c: F.min(c))


OPS = "array<struct<op:string,c:bigint,left:boolean>>"


def operation(op: str | Column, c: Column | int | None = None, left: bool | Column = False) -> Column:
    """One arithmetic step: x op c, or c op x with left.  op: const, bot, +, -, *, /, %, &, |, ^."""
    return F.array(F.struct((F.lit(op) if isinstance(op, str) else op).alias("op"), F.lit(c).cast("bigint").alias("c"), F.lit(left).alias("left")))


def evaluated(ops: Column, x: Column) -> Column:
    """The value after all steps; null is bottom (any value).  Overflow, division by zero and unknown steps give bottom."""
    def outcome(op: Column, c: Column, p: Column) -> Column:
        a, b = p["a"], p["b"]
        whole = F.nullif(b, F.lit(0))
        known = {"+": F.try_add(a, b), "-": F.try_subtract(a, b), "*": F.try_multiply(a, b), "/": F.call_function("div", a, whole), "%": a % whole, "&": a.bitwiseAND(b), "|": a.bitwiseOR(b), "^": a.bitwiseXOR(b), "const": c}
        out = None
        for name, value in known.items():
            out = F.when(op == name, value) if out is None else out.when(op == name, value)
        return out

    def step(acc: Column, o: Column) -> Column:
        operands = F.struct(F.when(o["left"], o["c"]).otherwise(acc).alias("a"), F.when(o["left"], acc).otherwise(o["c"]).alias("b"))
        return F.transform(F.array(operands), lambda p: outcome(o["op"], o["c"], p))[0]

    return F.aggregate(ops, x.cast("bigint"), step)


def arithmetic() -> Semiring:
    """Constants through arithmetic: functions are arrays of steps, normalised so that a constant or bottom comes first only."""
    bottom = operation("bot")
    fixed = lambda f: (F.size(f) > 0) & f[0]["op"].isin("const", "bot")

    def compose(a: Column, b: Column) -> Column:
        # a constant goes through the steps of b; computed once
        folded = F.transform(F.array(evaluated(b, a[0]["c"])), lambda v: F.when(v.isNull(), bottom[0]).otherwise(operation("const", v)[0]))
        return F.when(F.coalesce(fixed(b), F.lit(False)), b).when(F.coalesce(fixed(a), F.lit(False)), folded).otherwise(F.concat(a, b))

    agree = lambda c, other: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(other)
    value_join = lambda c: F.when(F.count(c) == F.count(F.lit(1)), agree(c, F.lit(None)))
    return Semiring(OPS, F.array().cast(OPS), compose, lambda c: agree(c, bottom), evaluated, value_join)


def automaton(states: int, bottom: int) -> Semiring:
    """Typestate: a function is the next state of each state; states that disagree join to bottom."""
    def merge(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.when(x == y, x).otherwise(F.lit(bottom)))

    def join(c: str) -> Column:
        return F.aggregate(F.collect_set(c), F.min(c), merge)

    same = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.lit(bottom))
    return Semiring("array<int>", F.array(*map(F.lit, range(states))), lambda a, b: F.transform(a, lambda s: F.element_at(b, s + 1)), join, lambda f, v: F.element_at(f, v + 1), same)


def labels() -> Semiring:
    """Label sets: a function replaces the set or adds to it."""
    kind = "struct<replace:boolean,labels:array<string>>"
    pair = lambda r, a: F.struct(r.alias("replace"), F.array_sort(F.array_distinct(a)).alias("labels"))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    empty = F.array().cast("array<string>")
    return Semiring(
        kind,
        F.struct(F.lit(False).alias("replace"), empty.alias("labels")),
        lambda a, b: F.when(b["replace"], b).otherwise(pair(a["replace"], F.concat(a["labels"], b["labels"]))),
        lambda c: F.struct(F.bool_and(F.col(c)["replace"]).alias("replace"), union(F.col(c)["labels"]).alias("labels")),
        lambda f, v: F.array_sort(F.when(f["replace"], f["labels"]).otherwise(F.array_union(v, f["labels"]))),
        union,
    )
