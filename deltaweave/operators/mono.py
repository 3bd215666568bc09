"""Monotone frameworks: facts in front of every node of a flow graph, merged over its predecessors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import dropped, stored
from .fixpoint import semi_naive


def may(edges: DataFrame, start: DataFrame, flow: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(n, d): facts that hold before n on some path.  edges(src, dst); start(n, d); flow maps facts before to facts after their
    node and treats each fact by itself (facts that a node makes from nothing belong to `start` at its successors)."""
    def step(delta: DataFrame, _: DataFrame) -> DataFrame:
        after = flow(delta)
        return after.join(edges, after.n == edges.src).select(edges.dst.alias("n"), "d")

    return semi_naive(start.select("n", "d"), step)


def must(edges: DataFrame, entries: DataFrame, start: DataFrame, flow: Callable[[DataFrame], DataFrame], max_rounds: int = 10_000) -> DataFrame:
    """(n, d): facts that hold before n on every path from an entry (n); nodes that no path reaches have none.

    flow maps the facts before all visited nodes (n, d) and the visited nodes (n, null) to the facts after them, nulls included.
    A node takes the facts of all its visited predecessors; `start` (n, d) counts as one more predecessor of an entry."""
    state = stored(entries.select("n", F.lit(None).cast(start.schema["d"].dataType).alias("d")).unionByName(start.select("n", "d")).distinct())
    outside = state.select(F.lit(None).cast(edges.schema["src"].dataType).alias("src"), "n", "d")
    before = None
    for _ in range(max_rounds):
        after = flow(state).select("n", "d").distinct()
        came = after.join(edges, after.n == edges.src).select("src", edges.dst.alias("n"), "d")
        came = came.unionByName(outside.join(entries.select("n").distinct(), "n", "left_semi").select("src", "n", "d"))
        preds = came.where("d is null").groupBy("n").agg(F.count(F.lit(1)).alias("k"))
        kept = came.groupBy("n", "d").agg(F.count(F.lit(1)).alias("c")).join(preds, "n").where("c = k").select("n", "d")
        new = stored(kept)
        both = new.unionByName(state).groupBy("n", "d").count().where("count = 1")
        if not both.take(1):
            return new.where("d is not null")
        if before is not None:
            dropped(before)
        before = state = new
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def call_strings(p, seeds: DataFrame, k: int = 3) -> DataFrame:
    """(n, ctx, d): facts before n by call string, the last k call sites on the way there.

    p: an ide.Problem; a return goes only to the contexts of its call that lead to the callee's context."""
    def pushed(ctx: Column, site: Column) -> Column:
        return F.slice(F.concat(ctx, F.array(site)), F.greatest(F.size(ctx) + 2 - k, F.lit(1)), k)

    into = p.enter.join(p.entry, "f").select("n", "f", "d", "s", "e")
    around = p.normal.withColumnRenamed("m", "r").select("n", "r", "d", "e").unionByName(p.around.select("n", "r", "d", "e"))
    sites = p.enter.select("n", "f").distinct()

    def step(delta: DataFrame, seen: DataFrame) -> DataFrame:
        on = delta.join(around, ["n", "d"]).select(F.col("r").alias("n"), "ctx", F.col("e").alias("d"))
        down = delta.join(into, ["n", "d"]).select(F.col("s").alias("n"), pushed(F.col("ctx"), F.col("n")).alias("ctx"), F.col("e").alias("d"))

        def up(inner: DataFrame, outer: DataFrame) -> DataFrame:
            ends = inner.join(p.exit, inner.n == p.exit.x).select("f", "x", F.col("ctx").alias("within"), "d")
            calls = outer.join(sites, "n").select("n", "f", "ctx").distinct().withColumn("within", pushed(F.col("ctx"), F.col("n")))
            return ends.join(calls, ["f", "within"]).join(p.leave, ["n", "f", "x", "d"]).select(F.col("r").alias("n"), "ctx", F.col("e").alias("d"))

        return on.unionByName(down).unionByName(up(delta, seen)).unionByName(up(seen, delta))

    none = F.array().cast(f"array<{seeds.schema['n'].dataType.simpleString()}>")
    return semi_naive(seeds.select("n", none.alias("ctx"), "d"), step)
