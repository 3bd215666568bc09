"""Shared helpers: table access, materialisation in the cluster's shared folder, word splitting."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word is a run of letters, digits or underscores, compared in lower case.
WORD = re.compile(r"\w+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that setting is absent and Spark runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="deltaweave-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(__import__("shutil").rmtree, found, ignore_errors=True)
    return found.rstrip("/")


def observed(df: DataFrame, label: str, **figures: Column) -> tuple[DataFrame, dict]:
    """materialise(df) and aggregates of its rows, taken while they are written: no job of their own."""
    seen = Observation()
    out = materialise(df.observe(seen, *(c.alias(n) for n, c in figures.items())), label)
    return out, seen.get


def counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """materialise(df) and its number of rows."""
    out, figures = observed(df, label, n=F.count(F.lit(1)))
    return out, figures["n"]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at replicated files that
    survive lost executors.  The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialised(df: DataFrame) -> None:
    """Delete the files behind a DataFrame that materialise() returned and nothing needs any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def digest_of(text: Column) -> Column:
    """128-bit identity of a text; null and empty texts share one value."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []
