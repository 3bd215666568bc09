"""Program relations: loading, numbering, lookups, incremental functions, precomputed helper results, taint configuration."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.storage import stored
from .relations import TAINT_SCHEMA

#: Schemas of the program relations.
SCHEMAS = {
    "functions": "fn string, is_decl boolean, is_vararg boolean, address_taken boolean, sig string",
    "instructions": "n long, fn string, block int, pos int, opcode string, type string, line int, var string",
    "operands": "n long, idx int, kind string, value string, const_val long",
    "cfg_edges": "src long, dst long, kind string",
    "call_edges": "callsite long, callee string",
    "params": "fn string, argno int, value string",
    "args": "n long, argno int, value string",
    "points_to": "value string, object string",
    "debug_info": "n long, var string, file string, dir string, line int, col int, src_line string, module string",
}


def load(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The relations under path, as `<name>.parquet` or `<name>.json`; columns are cast to the schema.  A relation without a file is empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out = {}
    for name in names or SCHEMAS:
        schema = SCHEMAS[name]
        if fs.exists(hadoop(f"{path}/{name}.parquet")):
            raw = spark.read.parquet(f"{path}/{name}.parquet")
        elif fs.exists(hadoop(f"{path}/{name}.json")):
            raw = spark.read.schema(schema).json(f"{path}/{name}.json")
        else:
            raw = spark.createDataFrame([], schema)
        out[name] = raw.select(*(F.col(f.name).cast(f.dataType) for f in spark.createDataFrame([], schema).schema))
    return out


def adopt(spark: SparkSession, rows: dict[str, list]) -> dict[str, DataFrame]:
    """Relations from rows in memory."""
    return {name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()}


def numbered(rows: DataFrame, order: list[str], column: str = "id", first: int = 0) -> DataFrame:
    """rows with dense ids in this order.  The rows are numbered within ranges, whose counts give the offsets; no single task sorts
    them all.  The ranges are written once, as bounds drawn anew for the counts could be others."""
    ranged = stored(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))  # one row a partition
    within = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1 + first
    return ranged.join(F.broadcast(offsets), "__part").withColumn(column, F.col("__base") + within).drop("__part", "__base")


def insert_function(instructions: DataFrame, new: DataFrame) -> DataFrame:
    """instructions with those of a new function, whose ids go on after the largest."""
    top = instructions.agg((F.coalesce(F.max("n"), F.lit(-1)) + 1).alias("__top"))
    placed = new.withColumn("n", F.row_number().over(W.orderBy("pos")) - 1).crossJoin(F.broadcast(top))
    return instructions.unionByName(placed.withColumn("n", (F.col("n") + F.col("__top")).cast("long")).drop("__top"))


def resolved(ids: DataFrame, column: str = "id") -> DataFrame:
    """ids plus what a metadata id names: `fn.k` an argument (fn, argno), a number an instruction (n), anything else nothing."""
    at = F.col(column)
    dotted = at.rlike(r"^.+\.[0-9]+$")
    return ids.withColumns({"n": F.when(at.rlike(r"^[0-9]+$"), at.try_cast("long")), "fn": F.when(dotted, F.regexp_extract(at, r"^(.+)\.[0-9]+$", 1)), "argno": F.when(dotted, F.regexp_extract(at, r"\.([0-9]+)$", 1).try_cast("int"))})


def text_file(spark: SparkSession, path: str) -> DataFrame:
    """(value): whole files, one row each."""
    return spark.read.text(path, wholetext=True)


def names_file(spark: SparkSession, path: str) -> DataFrame:
    """(name): one name a line, as in function lists; blank lines and comments (#) are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> '' and not startswith(name, '#')").distinct()


def call_graph(texts: DataFrame, functions: DataFrame, column: str = "value") -> DataFrame:
    """(n, fn): a precomputed call graph `{fn: [call-site ids]}`; unknown functions are skipped."""
    parsed = texts.select(F.explode(F.from_json(column, "map<string,array<bigint>>")).alias("fn", "sites"))
    return parsed.join(functions.select("fn").distinct(), "fn", "left_semi").select(F.explode("sites").alias("n"), "fn")


def alias_sets(texts: DataFrame, values: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(value, rep) and analysed functions (fn) of `{"AliasSets": [[id]], "AnalyzedFunctions": [fn]}`; unknown ids are skipped."""
    parsed = texts.select(F.from_json(column, "AliasSets array<array<string>>, AnalyzedFunctions array<string>").alias("j"))
    members = parsed.select(F.posexplode("j.AliasSets").alias("k", "ids")).select(F.explode("ids").alias("value"), F.array_min("ids").alias("rep"))
    return members.join(values.select("value").distinct(), "value", "left_semi"), parsed.select(F.explode("j.AnalyzedFunctions").alias("fn"))


def type_graph(texts: DataFrame, column: str = "value") -> DataFrame:
    """(base, derived) of a serialised type graph `{type: [type]}`."""
    parsed = texts.select(F.explode(F.from_json(column, "map<string,array<string>>")).alias("base", "all"))
    return parsed.select("base", F.explode("all").alias("derived"))


def checked_config(texts: DataFrame, column: str = "value") -> DataFrame:
    """(value, config, problem): taint configurations; `problem` names what is missing or malformed, else null."""
    parsed = texts.withColumn("config", F.from_json(column, TAINT_SCHEMA))
    bad_function = F.coalesce(F.exists("config.functions", lambda f: f["name"].isNull()), F.lit(False))
    bad_kind = F.coalesce(F.exists("config.variables", lambda v: ~F.coalesce(v["cat"].isin("source", "sink", "sanitizer"), F.lit(False))), F.lit(False))
    problem = F.when(F.col("config.name").isNull() & F.col("config.version").isNull(), "not a configuration").when(F.col("config.name").isNull(), "no name").when(F.col("config.version").isNull(), "no version").when(bad_function, "function without name").when(bad_kind, "unknown category")
    return parsed.select(F.col(column).alias("value"), "config", problem.alias("problem"))


def strict_config(texts: DataFrame, column: str = "value") -> DataFrame:
    """checked_config that fails on the first malformed configuration."""
    checked = checked_config(texts, column)
    return checked.withColumn("config", F.when(F.col("problem").isNotNull(), F.raise_error("problem")).otherwise(F.col("config")))


def annotated(calls: DataFrame, prefix: str = "") -> DataFrame:
    """(value, cat): of calls (callee, value, text), those that annotate a value as source, sink or sanitizer (after a fixed prefix)."""
    kinds = ["llvm.var.annotation", "llvm.ptr.annotation", "llvm.global.annotations"]
    cat = F.regexp_extract("text", f"^{re.escape(prefix)}(source|sink|sanitizer)", 1)
    return calls.where(F.regexp_extract("callee", r"^(llvm\.[a-z]+\.annotations?)", 1).isin(kinds)).select("value", cat.alias("cat")).where("cat <> ''")


def by_callback(args: DataFrame, source: Column | None = None, sink: Column | None = None, sanitizer: Column | None = None) -> DataFrame:
    """args plus booleans source, sink and sanitizer, given as conditions on a row."""
    given = {"source": source, "sink": sink, "sanitizer": sanitizer}
    return args.withColumns({k: F.lit(False) if c is None else F.coalesce(c, F.lit(False)) for k, c in given.items()})


def located(nodes: DataFrame, debug_info: DataFrame) -> DataFrame:
    """nodes (n, ...) with variable, file, line and the rest; nulls where nothing is known."""
    return nodes.join(debug_info, "n", "left")


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """(fn, param, to): library summaries, JSON lines `{"fn":, "param":, "to": [index or -1 for the result]}`; the list itself is a
    parameter, not part of this library."""
    return spark.read.schema("fn string, param int, to array<int>").json(path).select("fn", "param", F.explode("to").alias("to"))
