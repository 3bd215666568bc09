import random

from deltaweave.operators import callgraph, constness, flow, ide, ifds, statistics
from pyspark.sql import functions as F


def test_counters_of_empty_tables_and_nulls(spark):
    d = lambda rows, s: spark.createDataFrame(rows, s)
    schemas = ["external boolean, defined boolean, address_taken boolean", "external boolean, defined boolean, constant boolean", "block int", "src int, dst int", "op string, callee string, void boolean, operands int, type string", "n int, outside boolean"]
    out = {r.counter: r.value for r in statistics.module_counters(*(d([], s) for s in schemas)).collect()}
    assert len(out) == 35 and set(out.values()) == {0}
    rows = [[(None, True, None)], [], [(1,), (2,)], [(1, 2), (3, 2)], [("call", "asm", True, 3, None), ("call", None, None, None, None), ("alloca", None, False, 1, "A"), ("call", "allocating", False, 2, "A")], [(3, False), (3, True), (4, None)]]
    out = {r.counter: r.value for r in statistics.module_counters(*(d(r, s) for r, s in zip(rows, schemas, strict=True))).collect()}
    want = {"functions": 1, "external_functions": 0, "function_definitions": 1, "basic_blocks": 2, "max_predecessors": 2, "max_successors": 1, "call_sites": 3, "inline_asm": 1, "allocation_sites": 2, "allocated_types": 1, "total_operands": 6, "max_operands": 3, "non_void": 2, "total_uses": 3, "max_uses": 2, "multiple_uses": 1, "used_outside_block": 1}
    assert {k: out[k] for k in want} == want


def test_second_store_mutates_and_aliases_are_one_location(spark):
    """1 stores p, 2 stores q, 3 stores p; 2 -> 2 is a loop in the other function."""
    d = lambda rows, s: spark.createDataFrame(rows, s)
    edges = d([("f", 1, 2), ("f", 2, 3), ("f", 3, 4), ("g", 12, 12), ("g", 12, 13)], "f string, n long, m long")
    stores = d([("f", 1, "p"), ("f", 2, "q"), ("f", 3, "p"), ("g", 12, "s")], "f string, n long, loc string")
    seeds = d([(1, ""), (12, "")], "n long, d string")

    def run(**how):
        pair = "d string, e string"
        p = ide.Problem(d([], "f string, s long"), d([], "f string, x long"), constness.flow(edges, stores, **how), d([], f"n long, f string, {pair}"), d([], f"n long, f string, x long, r long, {pair}"), d([], f"n long, r long, {pair}"))
        return {tuple(r) for r in constness.mutated(ifds.solve(p, seeds)).collect()}

    assert run() == {(4, "p"), (12, "s"), (13, "s")}
    assert run(classes=d([("p", "p"), ("q", "p")], "value string, rep string")) == {(3, "p"), (4, "p"), (12, "s"), (13, "s")}


def brute(calls, addresses, points_to, assigned, direct, actuals, formals, results, returned):
    edges = set(direct)
    while True:
        rep = {}

        def find(x):
            while rep.setdefault(x, x) != x:
                x = rep[x]
            return x

        pairs = [(v, "o" + o) for v, o in points_to] + list(assigned)
        pairs += [(a, b) for n, f in edges for m, i, a in actuals if m == n for g, j, b in formals if (g, j) == (f, i)]
        pairs += [(a, b) for n, f in edges for m, a in results if m == n for g, b in returned if g == f]
        for a, b in pairs:
            rep[find(a)] = find(b)
        new = edges | {(n, f) for n, p, s in calls for v, t, f in addresses if s == t and find(v) == find(p)}
        if new == edges:
            return edges
        edges = new


def test_targets_by_alias_sets_against_brute_force(spark):
    pick = random.Random(3)
    fns = range(12)
    v = lambda: f"v{pick.randrange(40)}"
    tables = {
        "calls": ([(n, v(), pick.choice([None, None, 0, 1])) for n in range(40)], "n int, pointer string, slot int"),
        "addresses": ([(f"&{f}", None, f) for f in fns] + [(f"t{f}", f % 2, f) for f in fns], "value string, slot int, fn int"),
        "points_to": ([(f"&{f}", f"f{f}") for f in fns] + [(v(), f"f{pick.randrange(12)}") for _ in range(14)], "value string, object string"),
        "assigned": ([(v(), f"t{pick.randrange(12)}") for _ in range(7)], "a string, b string"),
        "direct": ([(100, 1), (101, 2)], "n int, fn int"),
        "actuals": ([(n, n % 2, v()) for n in [*range(40), 100, 101]], "n int, place int, value string"),
        "formals": ([(f, p, v()) for f in fns for p in (0, 1)], "fn int, place int, value string"),
        "results": ([(n, v()) for n in range(0, 40, 5)], "n int, value string"),
        "returned": ([(f, v()) for f in fns], "fn int, value string"),
    }
    frames = {k: spark.createDataFrame(rows, s).coalesce(1) for k, (rows, s) in tables.items()}
    first = callgraph.on_the_fly(**frames, max_rounds=1000)
    want = brute(**{k: rows for k, (rows, _) in tables.items()})
    assert {tuple(r) for r in first.collect()} == want and first.count() == len(want) > 20
    alone = frames | {k: frames[k].where(F.lit(False)) for k in ("actuals", "results", "assigned", "points_to")}
    assert {tuple(r) for r in callgraph.on_the_fly(**alone).collect()} == {(100, 1), (101, 2)}


def test_numbered_values_grow_into_one_set_round_by_round(spark):
    """Functions 0 to 5 each call what their argument holds and hand it on: a chain of rounds, with numbers as values."""
    d = lambda rows, s: spark.createDataFrame(rows, s).coalesce(1)
    fns = range(6)
    frames = {
        "calls": d([(10 + f, 100 + f, None) for f in fns], "n long, pointer long, slot int"),
        "addresses": d([(200 + f, None, f) for f in fns], "value long, slot int, fn long"),
        "points_to": d([(200 + f, f) for f in fns] + [(300, 1), (301, 1)], "value long, object long"),
        "assigned": d([(100, 300)] + [(400 + f, 201 + f) for f in range(5)], "a long, b long"),
        "direct": d([(50, 0)], "n long, fn long"),
        "actuals": d([(10 + f, 0, 401 + f) for f in range(4)], "n long, place int, value long"),
        "formals": d([(f, 0, 100 + f) for f in fns], "fn long, place int, value long"),
        "results": d([], "n long, value long"),
        "returned": d([], "fn long, value long"),
    }
    got = {tuple(r) for r in callgraph.on_the_fly(**frames).collect()}
    assert got == brute(**{k: [tuple(str(x) if c in ("pointer", "value", "object", "a", "b") else x for c, x in zip(f.columns, r, strict=True)) for r in f.collect()] for k, f in frames.items()})
    assert {(10, 1), (11, 2), (12, 3), (13, 4)} <= got


def test_signatures_join_by_blocks_and_give_every_pair(spark):
    """A variadic function of a repeated row counts twice, as in SQL; blocks of three rows give what one block gives."""
    sigs = ["", "a", "a,b", "a,b,c"]
    calls = [(n, n % 4, sigs[n % 4]) for n in [*range(20), 3, 3]]
    functions = [(f, f % 3, f % 2 == 0, sigs[f % 3]) for f in [*range(15), 4]]
    frames = spark.createDataFrame(calls, "n int, arity int, sig string"), spark.createDataFrame(functions, "fn int, arity int, vararg boolean, sig string")
    fits = lambda a, s, b, vararg, t: (a, s) == (b, t) if not vararg else b <= a and (b == 0 or s == t or s.startswith(t + ","))
    want = sorted((n, f) for n, a, s in calls for f, b, vararg, t in functions if fits(a, s, b, vararg, t))
    assert sorted(tuple(r) for r in callgraph.by_signature(*frames, block=3).collect()) == want
    assert sorted(tuple(r) for r in callgraph.by_signature(*frames).collect()) == want


def test_facts_at_calls_as_arrays_equal_the_relations(spark):
    """Flows over the arrays of a call, against those over relations; nothing is joined by call or made distinct over calls."""
    pick = random.Random(4)
    v = lambda: pick.choice(["a", "b", "c", None])
    rows = [(n, n % 6, n % 5 == 0, n % 2 == 0, [(flow.ZERO, False), ("g", True), ("a", False), ("b", pick.random() < 0.3)], [(k, v(), pick.choice([True, False, None])) for k in range(4)]) for n in range(60)]
    calls = spark.createDataFrame(rows, "n int, fn int, is_decl boolean, is_vararg boolean, facts array<struct<d:string,is_global:boolean>>, args array<struct<argno:int,value:string,is_sret:boolean>>")
    params = spark.createDataFrame([(f, k, None if (f, k) == (2, 1) else f"{f}_{k}") for f in range(5) for k in range(f)] + [(4, 1, "other")], "fn int, argno int, value string")
    held, args = calls.select("n", F.inline("facts")), calls.select("n", F.inline("args"))
    rowset = lambda df: sorted(map(tuple, df.collect()))
    for globals_pass in (True, False):
        found = flow.along_call_sites(calls, F.col("facts"), F.col("args"), lambda a: a["argno"] == 0, globals_pass)
        assert rowset(found) == rowset(flow.along_call_site(held, args, F.col("argno") == 0, globals_pass))
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    found = flow.to_callees(calls, F.col("facts"), F.col("args"), F.broadcast(flow.formals(params)))
    assert rowset(found) == rowset(flow.to_callee(held, args, params, calls))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "keys=[n#" not in plan
