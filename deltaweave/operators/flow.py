"""Flow-function combinators: from fact tables (n, d) to the facts after each node.

`v`, `w` are facts (values or columns of the row), predicates are columns over d."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZERO = "Λ"


def identity(facts: DataFrame) -> DataFrame:
    return facts


def apply_sets(facts: DataFrame, out: Column) -> DataFrame:
    """Each fact becomes the elements of the array `out`."""
    return facts.withColumn("d", F.explode(F.array_distinct(out))).distinct()


def generate(facts: DataFrame, v: Column, w: Column) -> DataFrame:
    return apply_sets(facts, F.when(F.col("d") == w, F.array(w, v)).otherwise(F.array("d")))


def generate_if(facts: DataFrame, v: Column, p: Column) -> DataFrame:
    return apply_sets(facts, F.when(p, F.array(F.col("d"), v)).otherwise(F.array("d")))


def generate_many(facts: DataFrame, vs: Column, w: Column) -> DataFrame:
    return apply_sets(facts, F.when(F.col("d") == w, F.array_union(F.array(w), vs)).otherwise(F.array("d")))


def kill(facts: DataFrame, v: Column) -> DataFrame:
    return facts.where(F.col("d") != v)


def kill_if(facts: DataFrame, p: Column) -> DataFrame:
    return facts.where(~p)


def kill_many(facts: DataFrame, vs: Column) -> DataFrame:
    return facts.where(~F.array_contains(vs, F.col("d")))


def kill_all(facts: DataFrame) -> DataFrame:
    return facts.where(F.lit(False))


def generate_and_kill_others(facts: DataFrame, v: Column, w: Column) -> DataFrame:
    return apply_sets(facts.where(F.col("d") == w), F.array(w, v))


def generate_many_and_kill_others(facts: DataFrame, vs: Column, w: Column) -> DataFrame:
    return apply_sets(facts.where(F.col("d") == w), F.array_union(F.array(w), vs))


def transfer(facts: DataFrame, v: Column, w: Column) -> DataFrame:
    return apply_sets(facts.where((F.col("d") != v) | (v == w)), F.when(F.col("d") == w, F.array(w, v)).otherwise(F.array("d")))


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def zeroed(facts: DataFrame, flow) -> DataFrame:
    """`flow`, which never loses the zero fact."""
    return union(flow(facts), facts.where(F.col("d") == ZERO))


def pairs(facts: DataFrame, table: DataFrame) -> DataFrame:
    """Any distributive function, given as pairs (d, e)."""
    return facts.join(table.select("d", "e"), "d").select(*[F.col("e").alias("d") if c == "d" else F.col(c) for c in facts.columns]).distinct()


def composed(facts: DataFrame, *flows) -> DataFrame:
    for f in flows:
        facts = f(facts)
    return facts


def along_call_site(facts: DataFrame, args: DataFrame, pass_arg: Column | None = None, globals_pass: bool = True) -> DataFrame:
    """Facts (n, d, ...) from a call to its return sites: zero passes, globals (`is_global`) on demand, arguments args(n, argno, value) by the
    predicate (a condition on argno and value; none: all), other facts always."""
    held = facts.join(args.select("n", F.col("value").alias("d"), "argno", F.lit(True).alias("is_arg")), ["n", "d"], "left").withColumn("value", F.col("d"))
    fine = F.lit(True) if pass_arg is None else pass_arg
    keep = F.when(F.col("d") == ZERO, True).when(F.col("is_global"), globals_pass).when(F.col("is_arg"), fine).otherwise(True)
    return held.where(keep).select(*facts.columns).distinct()


def along_call_sites(calls: DataFrame, facts: Column, args: Column, pass_arg: Callable[[Column], Column] | None = None, globals_pass: bool = True) -> DataFrame:
    """(n, d, is_global): along_call_site for calls (n, ...), one row each, whose facts (d, is_global) and args (argno, value) are arrays: no
    join, and no row is compared with those of other calls."""
    fine = pass_arg or (lambda a: F.lit(True))

    def keep(h: Column) -> Column:
        mine = F.filter(args, lambda a: a["value"] == h["d"])
        return F.when(h["d"] == ZERO, True).when(h["is_global"], globals_pass).otherwise((F.size(mine) == 0) | F.exists(mine, fine))

    return calls.select("n", F.inline(F.array_distinct(F.filter(facts, keep)))).select("n", "d", "is_global")


def to_callee(facts: DataFrame, args: DataFrame, params: DataFrame, callees: DataFrame) -> DataFrame:
    """(n, fn, d): facts at calls as the callee sees them.  callees(n, fn, is_decl, is_vararg); args(n, argno, value, is_sret); params(fn, argno,
    value).  Declarations get nothing; zero and globals pass; an actual becomes its formal, but for structure-return pairs; actuals beyond the
    formals of a variadic function become its list, `va_list`."""
    into = facts.join(callees.where("not is_decl"), "n")
    same = into.where((F.col("d") == ZERO) | F.col("is_global")).select("n", "fn", "d")
    met = into.join(args.where("not is_sret").select("n", "argno", F.col("value").alias("d")), ["n", "d"])
    formal = met.join(params.select("fn", "argno", F.col("value").alias("formal")), ["fn", "argno"], "left")
    mapped = formal.select("n", "fn", F.coalesce("formal", F.when(F.col("is_vararg"), F.lit("va_list"))).alias("d")).where("d is not null")
    return same.unionByName(mapped).distinct()


def formals(params: DataFrame) -> DataFrame:
    """(fn, formals): the params (fn, argno, value) of each function as an array."""
    return params.groupBy("fn").agg(F.collect_list(F.struct("argno", "value")).alias("formals"))


def to_callees(calls: DataFrame, facts: Column, args: Column, formals: DataFrame) -> DataFrame:
    """(n, fn, d): to_callee for different pairs of call and callee, calls (n, fn, is_decl, is_vararg, ...), whose facts (d, is_global) and args
    (argno, value, is_sret) are arrays.  The arrays are made after the join with formals (fn, formals), the only one."""
    rest = F.when(F.col("is_vararg"), F.lit("va_list"))

    def formal(a: Column) -> Column:
        mine = F.filter("formals", lambda p: p["argno"] == a["argno"])
        return F.when(F.size(mine) > 0, F.transform(mine, lambda p: F.coalesce(p["value"], rest))).otherwise(F.array(rest))

    same = F.transform(F.filter(facts, lambda h: (h["d"] == ZERO) | h["is_global"]), lambda h: h["d"])
    passed = F.flatten(F.transform(facts, lambda h: F.filter(args, lambda a: (a["value"] == h["d"]) & ~a["is_sret"])))
    mapped = F.array_compact(F.flatten(F.transform(passed, formal)))
    known = calls.where("not is_decl").join(formals, "fn", "left")
    return known.select("n", "fn", F.explode(F.array_distinct(F.concat(same, mapped))).alias("d"))


def to_caller(facts: DataFrame, args: DataFrame, params: DataFrame, callees: DataFrame, returned: DataFrame) -> DataFrame:
    """(n, fn, d): facts (fn, d, is_global) at a function's end as its callers n see them: formals that are pointers (params.is_pointer)
    become actuals, returned values (fn, d) the call itself, `call:n`; zero and globals pass."""
    out = facts.join(callees.where("not is_decl").select("n", "fn"), "fn")
    same = out.where((F.col("d") == ZERO) | F.col("is_global")).select("n", "fn", "d")
    formal = out.join(params.where("is_pointer").select("fn", "argno", F.col("value").alias("d")), ["fn", "d"])
    actual = formal.join(args.select("n", "argno", "value"), ["n", "argno"]).select("n", "fn", F.col("value").alias("d"))
    result = out.join(returned.select("fn", "d"), ["fn", "d"]).select("n", "fn", F.concat(F.lit("call:"), F.col("n").cast("string")).alias("d"))
    return same.unionByName(actual).unionByName(result).distinct()


def strong_update_store(facts: DataFrame, pointer: Column, base: Column, generates: Column) -> DataFrame:
    """A store: the pointer and its stripped base go; facts for which `generates` holds (the stored value, say) give the pointer too."""
    out = F.when(generates, F.array(F.col("d"), pointer)).otherwise(F.array("d"))
    kept = F.filter(out, lambda x: (x == pointer) & generates | ((x != pointer) & (x != base)))
    return apply_sets(facts, kept)
