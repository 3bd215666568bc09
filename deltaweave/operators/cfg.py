"""Control-flow graphs as relations: instructions (fn, pos, op, ...), edges (fn, src, dst, kind)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .fixpoint import semi_naive

#: Allocation functions, and marks of special members in mangled names.
HEAP = ["_Znwm", "_Znam", "malloc", "calloc", "realloc", "_ZnwPv"]
CONSTRUCTORS, DESTRUCTORS = ["C1", "C2", "C3"], ["D0", "D1", "D2"]
COPY, MOVE = "aSERKS_", "aSEOS_"
DEBUG = "llvm.dbg."


def real(instructions: DataFrame) -> DataFrame:
    """Instructions that are no debug intrinsics, numbered anew within their function."""
    kept = instructions.where(~F.coalesce(F.col("callee").startswith(DEBUG), F.lit(False)))
    return kept.withColumn("pos", F.row_number().over(W.partitionBy("fn").orderBy("pos")).cast("long"))


def edges(instructions: DataFrame, branches: DataFrame) -> DataFrame:
    """(fn, src, dst, kind): each instruction falls through to the next of its function unless it is a terminator (`ret`, `jump`);
    branches (fn, src, dst) add targets."""
    after = F.lead("pos").over(W.partitionBy("fn").orderBy("pos"))
    falls = instructions.select("fn", F.col("pos").alias("src"), after.alias("dst"), "op").where("dst is not null and op not in ('ret', 'jump')")
    return falls.select("fn", "src", "dst", F.lit("fall").alias("kind")).unionByName(branches.select("fn", "src", "dst", F.lit("branch").alias("kind"))).distinct()


def successors(*targets: Column) -> Column:
    """The `to` of a node for operators.within: its targets without nulls, each once."""
    return F.array_distinct(F.array_compact(F.array(*targets)))


def backward(edges: DataFrame) -> DataFrame:
    return edges.select("fn", F.col("dst").alias("src"), F.col("src").alias("dst"), "kind")


def exits(instructions: DataFrame, edges: DataFrame) -> DataFrame:
    """Instructions without a successor."""
    return instructions.join(edges.select("fn", F.col("src").alias("pos")), ["fn", "pos"], "left_anti").select("fn", "pos")


def branch_targets(edges: DataFrame) -> DataFrame:
    return edges.where("kind = 'branch'").select("fn", F.col("dst").alias("pos")).distinct()


def special_member(name: Column) -> Column:
    """constructor, destructor, copy or move assignment by the mangled name, else none."""
    mark = lambda ms: F.lit(False) if not ms else name.rlike("^_Z.*(?:" + "|".join(ms) + ")E")
    return F.when(name.contains(COPY), "copy").when(name.contains(MOVE), "move").when(mark(CONSTRUCTORS), "constructor").when(mark(DESTRUCTORS), "destructor").otherwise("none")


def allocates(name: Column) -> Column:
    return name.isin(HEAP)


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(fn, pos): what the starts (fn, pos) reach, themselves included."""
    def step(delta: DataFrame, _: DataFrame) -> DataFrame:
        return delta.join(edges, (delta.fn == edges.fn) & (delta.pos == edges.src)).select(delta.fn, edges.dst.alias("pos"))

    return semi_naive(start.select("fn", "pos"), step)


def dominators(instructions: DataFrame, edges: DataFrame) -> DataFrame:
    """(fn, pos, dom): dom comes before pos on every path from the function's start (pos 1): pos is not reached without it."""
    from_start = reachable(edges, instructions.groupBy("fn").agg(F.min("pos").alias("pos")))
    first = instructions.groupBy("fn").agg(F.min("pos").alias("first"))
    pairs = from_start.withColumnRenamed("pos", "dom").join(first, "fn")
    seeds = pairs.where("dom != first").select("fn", "dom", F.col("first").alias("pos"))

    def step(delta: DataFrame, _: DataFrame) -> DataFrame:
        on = delta.join(edges, (delta.fn == edges.fn) & (delta.pos == edges.src)).where("dst != dom")
        return on.select(delta.fn, "dom", edges.dst.alias("pos"))

    around = semi_naive(seeds, step)
    return pairs.select("fn", "dom").join(from_start, "fn").join(around, ["fn", "dom", "pos"], "left_anti").select("fn", "pos", "dom")


def paths(edges: DataFrame, start: DataFrame, most: int = 64) -> DataFrame:
    """(fn, path): paths without a repeated node from the starts (fn, pos) to nodes without successor, of at most `most` nodes; longer
    ones end there and are marked by `cut`."""
    def step(delta: DataFrame, _: DataFrame) -> DataFrame:
        last = F.element_at("path", -1)
        grown = delta.where(F.size("path") < most).withColumn("last", last)
        on = grown.join(edges, (grown.fn == edges.fn) & (grown["last"] == edges.src)).where(~F.array_contains("path", F.col("dst")))
        return on.select(grown.fn, F.concat("path", F.array("dst")).alias("path"))

    every = semi_naive(start.select("fn", F.array(F.col("pos").cast("long")).alias("path")), step)
    ends = edges.select("fn", F.col("src").alias("last")).distinct().withColumn("goes", F.lit(True))
    marked = every.withColumn("last", F.element_at("path", -1)).join(ends, ["fn", "last"], "left")
    return marked.where(F.col("goes").isNull() | (F.size("path") >= most)).select("fn", "path", F.col("goes").isNotNull().alias("cut"))
