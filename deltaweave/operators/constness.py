"""Mutated memory: locations that a second store reaches are not constant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .within import facts

#: Facts: zero; a location was stored to once on some path; it was stored to again.
ZERO, INITIALISED, MUTATED = "", "i:", "m:"


def flow(edges: DataFrame, stores: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """normal(n, m, d, e) for IFDS from edges (f, n, m) and stores (f, n, loc); with classes (value, rep), locations of an alias set are one.

    A store makes its location initialised, and mutated where it was initialised before.  Facts never end.  Only a function's own
    stored locations are listed on its edges."""
    if classes is not None:
        stores = stores.join(classes, stores.loc == classes.value, "left").select("f", "n", F.coalesce("rep", "loc").alias("loc"))
    stores = stores.select("f", "n", F.col("loc").cast("string").alias("loc")).distinct()
    edges = edges.select("f", "n", "m").distinct()
    first, again = F.concat(F.lit(INITIALISED), "loc"), F.concat(F.lit(MUTATED), "loc")
    zero = edges.select("n", "m", F.lit(ZERO).alias("d"), F.lit(ZERO).alias("e"))
    kept = edges.join(stores.select("f", "loc").distinct(), "f").select("n", "m", F.explode(F.array(first, again)).alias("d")).withColumn("e", F.col("d"))
    at = edges.join(stores, ["f", "n"])
    made = at.select("n", "m", F.explode(F.array(F.struct(F.lit(ZERO).alias("d"), first.alias("e")), F.struct(first.alias("d"), again.alias("e")))).alias("p")).select("n", "m", "p.*")
    return zero.unionByName(kept).unionByName(made)


def mutated(path_edges: DataFrame) -> DataFrame:
    """(n, loc): the locations that may be mutated before n, from IFDS path edges (n, d2)."""
    return path_edges.where(F.col("d2").startswith(MUTATED)).select("n", F.expr(f"substring(d2, {len(MUTATED) + 1})").alias("loc")).distinct()


def within(rows: DataFrame, key: str, carry: list[str], loc: str) -> DataFrame:
    """carry and loc: the locations that may be mutated before each node of a function.  rows: nodes for operators.within with `entry`
    (boolean) and the location that they store to, if any."""
    at = F.col(loc).cast("string")
    first, again = F.concat(F.lit(INITIALISED), at), F.concat(F.lit(MUTATED), at)
    pair = lambda d, e: F.struct(d.alias("d"), e.alias("e"))
    give = F.when(at.isNotNull(), F.array(pair(F.lit(ZERO), first), pair(first, again)))
    found = facts(rows.withColumns({"seed": F.when(F.col("entry"), F.array(F.lit(ZERO))), "give": give, "kill": F.array().cast("array<string>")}), key, carry)
    return found.where(F.col("d").startswith(MUTATED)).select(*carry, F.expr(f"substring(d, {len(MUTATED) + 1})").alias("loc"))
