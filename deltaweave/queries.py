"""Queries of the program-analysis operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import lattice
from .operators import fixpoint, flow, store
from .sources.relations import instructions, table, triples

IR = """ir AS (SELECT l_orderkey AS fn, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS pos,
 CASE l_returnflag WHEN 'A' THEN 'store' WHEN 'N' THEN 'load' ELSE 'call' END AS op, l_partkey AS ptr, l_suppkey AS val FROM lineitem)"""
TRIPLES = """t AS (SELECT 'c' || o_custkey AS s, 'ordered' AS p, 'o' || o_orderkey AS o FROM orders UNION SELECT 'o' || l_orderkey, 'has', 'p' || l_partkey FROM lineitem)"""
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT user_id, event_id FROM (SELECT *, max(CASE WHEN event_type = 'signup' THEN rn END) OVER w AS gen, max(CASE WHEN event_type = 'error' THEN rn END) OVER w AS kil
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 WHERE event_type = 'purchase' AND gen > coalesce(kil, 0)""")
def taint_linear(spark: SparkSession, d: str) -> DataFrame:
    """Leaks of a straight-line program for each user: signup generates, error kills, purchase reports."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts", F.row_number().over(order).alias("rn"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    e = e.withColumn("gen", F.max(F.when(F.col("event_type") == "signup", F.col("rn"))).over(before)).withColumn("kil", F.max(F.when(F.col("event_type") == "error", F.col("rn"))).over(before))
    return e.where((F.col("event_type") == "purchase") & (F.col("gen") > F.coalesce("kil", F.lit(0)))).select("user_id", "event_id")


for _name, _s, _p, _o in (("spo", "c1", "ordered", "o1"), ("spx", "c1", "ordered", "?"), ("sxo", "o1", "?", "p1"), ("xpo", "?", "has", "p1"), ("sxx", "o1", "?", "?"), ("xpx", "?", "ordered", "?"), ("xxo", "?", "?", "p7"), ("xxx", "?", "?", "?")):
    QUERIES[f"triples_{_name}"] = lambda spark, d, s=_s, p=_p, o=_o: store.get(triples(spark, d), s, p, o)
    SQL[f"triples_{_name}"] = f"WITH {TRIPLES} SELECT s, p, o FROM t WHERE " + " AND ".join([f"{c} = '{v}'" for c, v in zip("spo", (_s, _p, _o), strict=True) if v != "?"] or ["true"])


@query(f"WITH {IR} SELECT fn, pos AS src, nxt AS dst FROM (SELECT *, lead(pos) OVER (PARTITION BY fn ORDER BY pos) AS nxt FROM ir) WHERE nxt IS NOT NULL")
def cfg_edges(spark, d):
    i = instructions(spark, d)
    return i.select("fn", F.col("pos").alias("src"), F.lead("pos").over(W.partitionBy("fn").orderBy("pos")).alias("dst")).where("dst is not null")


@query(f"WITH {IR} SELECT fn, min(pos) AS start_pos, max(pos) AS exit_pos, count(*) AS n FROM ir GROUP BY fn")
def cfg_start_exit(spark, d):
    return instructions(spark, d).groupBy("fn").agg(F.min("pos").alias("start_pos"), F.max("pos").alias("exit_pos"), F.count("*").alias("n"))


@query(f"WITH {IR} SELECT fn, pos FROM ir WHERE op <> 'call' AND pos > 1")
def non_call_non_start(spark, d):
    return instructions(spark, d).where("op <> 'call' and pos > 1").select("fn", "pos")


@query(f"WITH {IR} SELECT fn, pos, return_site FROM (SELECT *, lead(pos) OVER (PARTITION BY fn ORDER BY pos) AS return_site FROM ir) WHERE op = 'call' AND return_site IS NOT NULL")
def return_sites(spark, d):
    i = instructions(spark, d).withColumn("return_site", F.lead("pos").over(W.partitionBy("fn").orderBy("pos")))
    return i.where("op = 'call' and return_site is not null").select("fn", "pos", "return_site")


@query(f"WITH {IR} SELECT count(*) AS instructions, count(DISTINCT fn) AS functions, count(*) FILTER (op = 'store') AS stores, count(*) FILTER (op = 'load') AS loads, count(*) FILTER (op = 'call') AS calls, max(pos) AS longest, count(DISTINCT ptr) AS pointers FROM ir")
def module_statistics(spark, d):
    n = lambda op: F.count_if(F.col("op") == op)
    return instructions(spark, d).agg(F.count("*").alias("instructions"), F.countDistinct("fn").alias("functions"), n("store").alias("stores"), n("load").alias("loads"), n("call").alias("calls"), F.max("pos").alias("longest"), F.countDistinct("ptr").alias("pointers"))


FACTS = "f AS (SELECT c_custkey AS n, c_mktsegment AS d, c_nationkey AS k FROM customer)"


def facts(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("n"), F.col("c_mktsegment").alias("d"), F.col("c_nationkey").alias("k"))


_B, _M = F.lit, "BUILDING"
_FLOWS = {
    "identity": (lambda f: flow.identity(f), "SELECT n, d, k FROM f"),
    "generate": (lambda f: flow.generate(f, _B("G"), _B(_M)), f"SELECT n, d, k FROM f UNION SELECT n, 'G', k FROM f WHERE d = '{_M}'"),
    "generate_if": (lambda f: flow.generate_if(f, _B("G"), F.col("k") < 5), "SELECT n, d, k FROM f UNION SELECT n, 'G', k FROM f WHERE k < 5"),
    "generate_many": (lambda f: flow.generate_many(f, F.array(_B("G"), _B("H")), _B(_M)), f"SELECT n, d, k FROM f UNION SELECT n, unnest(['G', 'H']), k FROM f WHERE d = '{_M}'"),
    "kill": (lambda f: flow.kill(f, _B(_M)), f"SELECT n, d, k FROM f WHERE d <> '{_M}'"),
    "kill_if": (lambda f: flow.kill_if(f, F.col("k") > 9), "SELECT n, d, k FROM f WHERE k <= 9"),
    "kill_many": (lambda f: flow.kill_many(f, F.array(_B(_M), _B("MACHINERY"))), f"SELECT n, d, k FROM f WHERE d NOT IN ('{_M}', 'MACHINERY')"),
    "kill_all": (lambda f: flow.kill_all(f), "SELECT n, d, k FROM f WHERE false"),
    "generate_kill_others": (lambda f: flow.generate_and_kill_others(f, _B("G"), _B(_M)), f"SELECT n, unnest([d, 'G']) AS d, k FROM f WHERE d = '{_M}'"),
    "generate_many_kill_others": (lambda f: flow.generate_many_and_kill_others(f, F.array(_B("G"), _B("H")), _B(_M)), f"SELECT n, unnest([d, 'G', 'H']) AS d, k FROM f WHERE d = '{_M}'"),
    "transfer": (lambda f: flow.transfer(f, _B("MACHINERY"), _B(_M)), f"SELECT n, d, k FROM f WHERE d <> 'MACHINERY' UNION SELECT n, 'MACHINERY', k FROM f WHERE d = '{_M}'"),
    "union": (lambda f: flow.union(flow.kill(f, _B(_M)), flow.kill(f, _B("MACHINERY"))), "SELECT n, d, k FROM f"),
}
for _name, (_f, _sql) in _FLOWS.items():
    QUERIES[f"flow_{_name}"] = lambda spark, d, g=_f: g(facts(spark, d))
    SQL[f"flow_{_name}"] = f"WITH {FACTS} {_sql}"


@query("SELECT c_nationkey AS k, CASE WHEN count(DISTINCT c_mktsegment) > 1 THEN 2 ELSE 1 END AS tag, CASE WHEN count(DISTINCT c_mktsegment) = 1 THEN min(c_mktsegment) END AS v FROM customer GROUP BY 1")
def lattice_flat_join(spark, d):
    tag, v = lattice.flat_join()
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit(1).alias("tag"), F.col("c_mktsegment").alias("v")).groupBy("k").agg(tag.alias("tag"), v.alias("v"))


@query("SELECT c_nationkey AS k, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS labels FROM customer GROUP BY 1")
def lattice_label_join(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.array("c_mktsegment").alias("a")).distinct()
    return c.groupBy("k").agg(F.array_join(lattice.label_join("a"), ",").alias("labels"))


@query("SELECT c_mktsegment AS v, count(*) AS keys, min(c_custkey) AS least FROM customer GROUP BY 1")
def equivalence_classes(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("v")).agg(F.count("*").alias("keys"), F.min("c_custkey").alias("least"))


TYPES = """e AS (SELECT r_name AS base, n_name AS derived FROM region JOIN nation ON r_regionkey = n_regionkey UNION SELECT n_name, s_name FROM nation JOIN supplier ON n_nationkey = s_nationkey)"""
CLOSED = f"WITH RECURSIVE {TYPES}, c AS (SELECT base, derived FROM e UNION SELECT c.base, e.derived FROM c JOIN e ON c.derived = e.base)"


def type_edges(spark, d):
    r, n, s = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    a = r.join(n, r.r_regionkey == n.n_regionkey).select(F.col("r_name").alias("base"), F.col("n_name").alias("derived"))
    return a.unionByName(n.join(s, n.n_nationkey == s.s_nationkey).select(F.col("n_name").alias("base"), F.col("s_name").alias("derived")))


@query(CLOSED + " SELECT base, derived FROM c")
def type_hierarchy(spark, d):
    """Transitive subtypes."""
    return fixpoint.closure(type_edges(spark, d), "base", "derived")


@query(CLOSED + " SELECT base AS receiver, derived AS callee FROM c WHERE derived IN (SELECT s_name FROM supplier) AND base IN (SELECT r_name FROM region)")
def call_targets_cha(spark, d):
    """Class-hierarchy analysis: every subtype of the receiver that has an implementation."""
    impl = table(spark, d, "supplier").select(F.col("s_name").alias("derived"))
    roots = table(spark, d, "region").select(F.col("r_name").alias("base"))
    return type_hierarchy(spark, d).join(impl, "derived", "left_semi").join(roots, "base", "left_semi").select(F.col("base").alias("receiver"), F.col("derived").alias("callee"))


@query(CLOSED + """, cha AS (SELECT base, derived FROM c WHERE derived IN (SELECT s_name FROM supplier) AND base IN (SELECT r_name FROM region)), rta AS (SELECT * FROM cha WHERE derived IN (SELECT s_name FROM supplier WHERE s_acctbal > 5000))
 SELECT base AS receiver, derived AS callee FROM rta UNION SELECT base, derived FROM cha WHERE base NOT IN (SELECT base FROM rta)""")
def call_targets_rta(spark, d):
    """Rapid type analysis: allocated types only; without any, class hierarchy."""
    cha = call_targets_cha(spark, d)
    live = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_name").alias("callee"))
    rta = cha.join(live, "callee", "left_semi")
    return rta.unionByName(cha.join(rta.select("receiver").distinct(), "receiver", "left_anti")).select("receiver", "callee")


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, CASE event_type WHEN 'signup' THEN 'FOPEN' WHEN 'purchase' THEN 'FCLOSE' ELSE 'STAR' END AS token FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
 r(user_id, rn, state) AS (SELECT DISTINCT user_id, cast(0 AS BIGINT), 0 FROM e UNION ALL SELECT e.user_id, e.rn, (CASE token WHEN 'FOPEN' THEN [1, 1, 1, 3, 1] WHEN 'FCLOSE' THEN [3, 2, 3, 3, 4] ELSE [3, 1, 3, 3, 4] END)[state + 1] FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
 SELECT user_id, max_by(state, rn) AS state FROM r GROUP BY 1""")
def typestate_stdio(spark, d):
    """The stdio automaton over each user's events: signup opens, purchase closes, error is any other use."""
    e = table(spark, d, "events").withColumn("token", F.expr("CASE event_type WHEN 'signup' THEN 'FOPEN' WHEN 'purchase' THEN 'FCLOSE' ELSE 'STAR' END")).where("event_type in ('signup', 'purchase', 'error')")
    g = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "token"))), lambda x: x["token"]).alias("tokens"))
    return g.select("user_id", lattice.run_dfa(lattice.STDIO, F.col("tokens"), 0).alias("state"))


@query(f"WITH {IR} SELECT ptr, to_json(list(DISTINCT fn ORDER BY fn)) AS callers FROM ir WHERE op = 'call' GROUP BY ptr")
def call_graph_json(spark, d):
    i = instructions(spark, d).where("op = 'call'").select("ptr", "fn").distinct()
    return i.groupBy("ptr").agg(F.to_json(F.sort_array(F.collect_list("fn"))).alias("callers"))
