"""IDE and IFDS tabulation over relations.

Relations: entry(f, s); exit(f, x); the flow functions as pairs with an edge function `ef` (none: identity):
normal(n, m, d, e), enter(n, f, d, e), leave(n, f, x, r, d, e), around(n, r, d, e), summary(n, r, d, e).  A missing pair
kills a fact.  A call with a special summary does not enter its callees.  Facts are of any type that can be compared.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.edge import Semiring, reachability
from ..plans.storage import dropped, stored

KEY = ["s", "d1", "n", "d2"]


@dataclass
class Problem:
    entry: DataFrame
    exit: DataFrame
    normal: DataFrame
    enter: DataFrame
    leave: DataFrame
    around: DataFrame
    summary: DataFrame | None = None


@dataclass
class Options:
    """zero: the zero fact, which is added to the seeds' points and to which unbalanced returns belong; unbalanced: facts at the
    exit of a function that no call entered go on to all its callers; on_round(number, delta): False stops."""

    zero: object = None
    unbalanced: bool = False
    max_rounds: int = 10_000
    on_round: Callable[[int, DataFrame], bool] | None = None


def with_edges(pairs: DataFrame, ring: Semiring) -> DataFrame:
    return pairs if "ef" in pairs.columns else pairs.withColumn("ef", ring.identity)


def solve(p: Problem, seeds: DataFrame, ring: Semiring | None = None, options: Options | None = None) -> DataFrame:
    """Jump functions (s, d1, n, d2, ef): fact d1 at the start s reaches n as d2, and what happens to its value on the way.

    Each seed (n, d) begins with the self-loop (n, d, n, d, identity), as does each fact that enters a callee.  Per round the changed
    jump functions go through normal, summary and call-to-return flow; calls whose jump function changed meet all ends of their callees
    and ends that changed meet all calls, so that a summary serves every context, whenever it comes."""
    ring, o = ring or reachability(), options or Options()
    normal, enter, leave, around = (with_edges(x, ring) for x in (p.normal, p.enter, p.leave, p.around))
    if p.summary is not None:
        enter = enter.join(p.summary.select("n").distinct(), "n", "left_anti")
        around = around.unionByName(with_edges(p.summary, ring))
    if o.zero is not None:
        seeds = seeds.unionByName(seeds.select("n", F.lit(o.zero).alias("d")))
    step = normal.withColumnRenamed("m", "r").unionByName(around)
    step = step.select(F.col("n"), F.col("d").alias("d2"), F.col("r").alias("to"), F.col("e").alias("d3"), F.col("ef").alias("g"))
    into = enter.join(p.entry, "f").select("n", F.col("d").alias("d2"), "f", F.col("s").alias("s2"), F.col("e").alias("d3"), F.col("ef").alias("g"))
    out = p.exit.join(p.entry, "f").select("f", F.col("x").alias("n"), "s")
    back = leave.select("n", "f", "x", F.col("r").alias("to"), F.col("d").alias("d4"), F.col("e").alias("d5"), F.col("ef").alias("h"))
    calling = bool(p.enter.take(1))
    files = path = delta = stored(seeds.select(F.col("n").alias("s"), F.col("d").alias("d1"), "n", F.col("d").alias("d2"), ring.identity.alias("ef")).distinct())

    def calls(j: DataFrame) -> DataFrame:
        met = j.join(into, ["n", "d2"])
        return met.select("s", "d1", F.col("n").alias("c"), "f", "s2", "d3", ring.compose(F.col("ef"), F.col("g")).alias("ec"))

    def ends(j: DataFrame) -> DataFrame:
        return j.join(out, ["n", "s"]).select("f", F.col("s").alias("s2"), F.col("d1").alias("d3"), F.col("n").alias("x"), F.col("d2").alias("d4"), F.col("ef").alias("es"))

    both = ["f", "s2", "d3"]

    def through_calls(path: DataFrame, delta: DataFrame) -> DataFrame:
        begun = delta.join(into, ["n", "d2"]).select(F.col("s2").alias("s"), F.col("d3").alias("d1"), F.col("s2").alias("n"), F.col("d3").alias("d2"), ring.identity.alias("ef"))
        met = calls(delta).join(ends(path), both).unionByName(calls(path).join(ends(delta), both))
        met = met.withColumnRenamed("c", "n").join(back, ["n", "f", "x", "d4"])
        home = met.select("s", "d1", F.col("to").alias("n"), F.col("d5").alias("d2"), ring.compose(ring.compose(F.col("ec"), F.col("es")), F.col("h")).alias("ef"))
        return begun.unionByName(home)

    for n in range(o.max_rounds):
        if o.on_round and not o.on_round(n, delta):
            return path
        on = delta.join(step, ["n", "d2"]).select("s", "d1", F.col("to").alias("n"), F.col("d3").alias("d2"), ring.compose(F.col("ef"), F.col("g")).alias("ef"))
        fresh = on
        if calling:
            fresh = fresh.unionByName(through_calls(path, delta))
        if o.unbalanced:
            alone = ends(path).join(calls(path).select(*both), both, "left_anti")
            past = alone.join(back, ["f", "x", "d4"])
            fresh = fresh.unionByName(past.select(F.col("to").alias("s"), F.col("d5").alias("d1"), F.col("to").alias("n"), F.col("d5").alias("d2"), ring.identity.alias("ef")))
        # one pass: all jump functions with those that are new or have changed
        was = path.withColumn("was", F.lit(True)).unionByName(fresh.withColumn("was", F.lit(False)))
        joined = was.groupBy(*KEY).agg(ring.join("ef").alias("ef"), F.bool_or("was").alias("was"), F.min(F.when(F.col("was"), F.col("ef"))).alias("old"))
        now = stored(joined.select(*KEY, "ef", (~F.col("was") | ~F.col("ef").eqNullSafe(F.col("old"))).alias("changed")))
        dropped(files)
        files, path, delta = now, now.drop("changed"), now.where("changed").drop("changed")
        if not delta.take(1):
            return path
    raise RuntimeError(f"no fixpoint after {o.max_rounds} rounds")


def values(p: Problem, jumps: DataFrame, seeds: DataFrame, ring: Semiring, max_rounds: int = 10_000) -> DataFrame:
    """(n, d, v): the value of each fact that holds at n, from jump functions and the seeds' values (n, d, v).

    Values go from start points through calls to the callees' starts until nothing changes, then to all points."""
    into = with_edges(p.enter, ring).join(p.entry, "f").select("n", F.col("d").alias("d2"), F.col("s").alias("s2"), F.col("e").alias("d3"), F.col("ef").alias("g"))
    calling = bool(p.enter.take(1))
    at = stored(seeds.select(F.col("n").alias("s"), F.col("d").alias("d1"), "v").groupBy("s", "d1").agg(ring.value_join("v").alias("v")))
    delta = at
    everywhere = lambda: at.join(jumps, ["s", "d1"]).select("n", F.col("d2").alias("d"), ring.apply(F.col("ef"), F.col("v")).alias("v")).groupBy("n", "d").agg(ring.value_join("v").alias("v"))
    if not calling:
        return everywhere()
    for _ in range(max_rounds):
        there = delta.join(jumps, ["s", "d1"]).join(into, ["n", "d2"])
        new = there.select(F.col("s2").alias("s"), F.col("d3").alias("d1"), ring.apply(F.col("g"), ring.apply(F.col("ef"), F.col("v"))).alias("v"))
        both = new.withColumn("old", F.lit(False)).unionByName(at.withColumn("old", F.lit(True)))
        joined = both.groupBy("s", "d1").agg(ring.value_join("v").alias("v"), F.bool_or("old").alias("had"), F.bool_or(~F.col("old")).alias("met"))
        before = at.select("s", "d1", F.col("v").alias("w"))
        changed = joined.where("met").join(before, ["s", "d1"], "left").where("not had or not (v <=> w)").select("s", "d1", "v")
        delta = stored(changed)
        if not delta.take(1):
            return everywhere()
        at = stored(at.join(delta, ["s", "d1"], "left_anti").unionByName(delta))
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def facts(jumps: DataFrame, zero: object = None) -> DataFrame:
    """(n, d): the facts that hold at each node, without the zero fact."""
    out = jumps.select("n", F.col("d2").alias("d")).distinct()
    return out if zero is None else out.where(F.col("d") != F.lit(zero))
