from deltaweave.functions import edge
from deltaweave.operators import ide, mono, sets
from deltaweave.sources import program
from pyspark.sql import functions as F


def test_sets_and_numbering(spark):
    d = spark.createDataFrame([(["a", "b"],)], "a array<string>")
    r = d.select(sets.power_set(F.col("a")).alias("p"), sets.remove_by_index(F.col("a"), F.array(F.lit(0))).alias("r")).first()
    assert sorted(map(tuple, r.p)) == [(), ("a",), ("a", "b"), ("b",)] and r.r == ["b"]
    n = program.numbered(spark.range(50).select((F.col("id") * 7 % 50).alias("k")), ["k"])
    assert {(x.k, x.id) for x in n.collect()} == {(i, i) for i in range(50)}
    ids = program.resolved(spark.createDataFrame([("12",), ("fn.1",), ("x",)], "id string")).collect()
    assert [(x.n, x.fn, x.argno) for x in ids] == [(12, None, None), (None, "fn", 1), (None, None, None)]


def test_constants_through_a_call(spark):
    """main: 1 x := 5; 2 calls f(x), back at 3.  f: 10 p := p + 2; 11 returns p, which becomes y."""
    d = lambda rows, s: spark.createDataFrame(rows, s)
    ring = edge.arithmetic()
    give = lambda rows, s: d(rows, s + ", op string, c long").withColumn("ef", F.when(F.col("op").isNull(), ring.identity).otherwise(edge.operation(F.col("op"), F.col("c")))).drop("op", "c")
    p = ide.Problem(
        entry=d([("f", 10)], "f string, s long"), exit=d([("f", 11)], "f string, x long"),
        normal=give([(1, 2, "0", "0", None, None), (1, 2, "0", "x", "const", 5), (10, 11, "p", "p", "+", 2)], "n long, m long, d string, e string"),
        enter=give([(2, "f", "x", "p", None, None)], "n long, f string, d string, e string"),
        leave=give([(2, "f", 11, 3, "p", "y", None, None)], "n long, f string, x long, r long, d string, e string"),
        around=give([(2, 3, "x", "x", None, None)], "n long, r long, d string, e string"),
    )
    seeds = d([(1, "0")], "n long, d string")
    out = ide.values(p, ide.solve(p, seeds, ring), seeds.withColumn("v", F.lit(None).cast("long")), ring)
    got = {(r.n, r.d): r.v for r in out.collect() if r.d != "0"}
    assert got == {(2, "x"): 5, (10, "p"): 5, (11, "p"): 7, (3, "x"): 5, (3, "y"): 7}


def test_call_strings_return_to_their_call(spark):
    d = lambda rows, s: spark.createDataFrame(rows, s)
    p = ide.Problem(
        entry=d([("f", 10)], "f string, s long"), exit=d([("f", 10)], "f string, x long"), normal=d([(2, 3, "x", "x")], "n long, m long, d string, e string"),
        enter=d([(1, "f", "a", "p"), (3, "f", "b", "p")], "n long, f string, d string, e string"),
        leave=d([(1, "f", 10, 2, "p", "x"), (3, "f", 10, 4, "p", "y")], "n long, f string, x long, r long, d string, e string"),
        around=d([(3, 4, "x", "x")], "n long, r long, d string, e string"),
    )
    got = {(r.n, tuple(r.ctx), r.d) for r in mono.call_strings(p, d([(1, "a")], "n long, d string"), k=2).collect()}
    assert got == {(1, (), "a"), (10, (1,), "p"), (2, (), "x"), (3, (), "x"), (4, (), "x")}
