"""Results, graphs and tables as JSON and DOT, and statistics of solver runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sets import numeric_order


def results_json(results: DataFrame) -> DataFrame:
    """One row for each node: results (fn, n, d, v) as `{"fn::n": {"Facts": [...]}}`, facts sorted."""
    return facts_json(results.groupBy("fn", "n").agg(F.collect_list(F.struct("d", "v")).alias("facts")))


def facts_json(results: DataFrame) -> DataFrame:
    """results_json of results (fn, n, facts) that are an array (d, v) for each node already."""
    facts = F.array_sort(F.transform("facts", lambda f: F.struct(f["d"].cast("string").alias("d"), f["v"].cast("string").alias("v"))))
    grouped = results.select("fn", "n", facts.alias("Facts"))
    return grouped.select("fn", "n", F.to_json(F.create_map(F.concat_ws("::", F.col("fn").cast("string"), F.col("n").cast("string")), F.struct("Facts"))).alias("json"))


def dump(results: DataFrame) -> DataFrame:
    """Result rows (fn, n, d, v), by function, node and fact in numeric-aware order."""
    keys = [k for c in ("fn", "n", "d") for k in numeric_order(F.col(c).cast("string"))]
    return results.orderBy(*keys)


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(c.cast("string"), r'(["\\])', r"\\$1"), F.lit('"'))


def dot_edges(graph: DataFrame, src: str, dst: str, label: str | None = None) -> DataFrame:
    """(line): one DOT edge for each row.  A whole file is the header, the lines and `}`; write_dot does it."""
    attr = F.lit("") if label is None else F.concat(F.lit(" [label="), quoted(F.col(label)), F.lit("]"))
    return graph.select(F.concat(quoted(F.col(src)), F.lit(" -> "), quoted(F.col(dst)), attr, F.lit(";")).alias("line"))


def write_dot(lines: DataFrame, path: str, name: str = "graph") -> None:
    """Lines in sorted order between a header and a closing brace, as text files that follow one another."""
    framed = lines.select(F.lit(1).alias("k"), "line").unionByName(lines.sparkSession.createDataFrame([(0, f'digraph "{name}" {{'), (2, "}")], "k int, line string"))
    framed.repartitionByRange("k", "line").sortWithinPartitions("k", "line").select(F.col("line").alias("value")).write.text(path)


def adjacency_json(graph: DataFrame, src: str, dst: str) -> DataFrame:
    """(src, json): the sorted targets of each source."""
    return graph.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct().groupBy("src").agg(F.to_json(F.sort_array(F.collect_list("dst"))).alias("json"))


def vtable_json(tables: DataFrame, null: str = "__null__") -> DataFrame:
    """(type, json): the slots in order, empty ones by a placeholder."""
    slots = F.transform(F.sort_array(F.collect_list(F.struct("slot", F.coalesce("fn", F.lit(null)).alias("fn")))), lambda x: x["fn"])
    return tables.groupBy("type").agg(F.to_json(slots).alias("json"))


def esg_statistics(jumps: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """One row about jump functions (s, d1, n, d2, ef): path edges, distinct facts, generated facts (not there at their start), facts
    at call sites, contexts, edge functions and different ones.  Call sites are `calls` (n) or marked by jumps.at_call.  A context is
    counted by the path edge from its start to itself, which each begins with."""
    if calls is not None:
        jumps = jumps.join(calls.select("n").distinct().withColumn("at_call", F.lit(True)), "n", "left")
    own = (F.col("s") == F.col("n")) & F.col("d1").eqNullSafe(F.col("d2"))
    return jumps.agg(
        F.count("*").alias("path_edges"), F.count_distinct("d2").alias("facts"), F.count_if(F.col("d1") != F.col("d2")).alias("generated"),
        F.count_if(own).alias("contexts"), F.count("ef").alias("edge_functions"), F.count_distinct("ef").alias("different_edge_functions"), F.count_if("at_call").alias("at_calls"),
    )


def counters(metrics: DataFrame) -> DataFrame:
    """(name, total, n, mean): sums of metric events (name, value)."""
    return metrics.groupBy("name").agg(F.sum("value").alias("total"), F.count("*").alias("n"), F.avg("value").alias("mean"))


def timers(events: DataFrame) -> DataFrame:
    """(name, run, elapsed): of events (name, run, start, stop), one row for each stretch between pauses."""
    return events.groupBy("name", "run").agg(F.sum(F.col("stop") - F.col("start")).alias("elapsed"))


def histogram(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("name", "value").agg(F.count("*").alias("n"))
