"""Program relations over the driver's tables, triples and the taint configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TAINT_SCHEMA = "name string, version double, functions array<struct<name:string,ret:string,params:struct<source:array<int>,sink:array<int>,sanitizer:array<int>>>>, variables array<struct<scope:string,name:string,line:int,cat:string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn, pos, op, ptr, val): an order is a function, its lines are instructions; pos counts from 1 in a function.
    Ids are (fn, pos), so that numbering needs no global sort."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    op = F.when(F.col("l_returnflag") == "A", "store").when(F.col("l_returnflag") == "N", "load").otherwise("call")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fn"), F.row_number().over(order).cast("long").alias("pos"), op.alias("op"), F.col("l_partkey").alias("ptr"), F.col("l_suppkey").alias("val"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, p, o) as strings, without duplicates."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("s"), F.lit("ordered").alias("p"), F.concat(F.lit("o"), "o_orderkey").alias("o"))
    x = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("s"), F.lit("has").alias("p"), F.concat(F.lit("p"), "l_partkey").alias("o"))
    return o.unionByName(x).dropDuplicates()


def taint_config(texts: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Functions and variables of taint configurations in JSON, one document a row; malformed ones give no rows."""
    parsed = texts.select(F.from_json(column, TAINT_SCHEMA).alias("c"))
    return parsed.select(F.explode("c.functions").alias("f")).select("f.*"), parsed.select(F.explode("c.variables").alias("v")).select("v.*")
