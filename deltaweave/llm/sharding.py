"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass 1 scatters the records uniformly over memory-sized buckets by a seeded hash (an exchange, which
writes them to disk).  Pass 2 takes each bucket alone, brings it into a canonical order, applies a
Fisher-Yates shuffle (which Spark's `shuffle` is) seeded by seed + bucket, and writes it.  The written
buckets stand one after the other; a record's place in that order gives its shard and slot.  The law
is `rows`: sizes of shards differ by one at most.

The number of buckets grows with the bytes, the size of a bucket does not.  A hot text or source does not
matter, as the hash covers doc_id too.  Of ids that repeat over `HOT_ID` times equal rows are counted first, and the copies are then
numbered, so that they are parted without meeting in one task and the result depends on rows and seed alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

OVERHEAD = 16
HOT_ID = 1024
#: Bucket offsets up to this count are broadcast (under 32 MB); more are joined by shuffle.
BROADCAST_BUCKETS = 1_000_000


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus a fixed overhead."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def shuffle_to_buckets(docs: DataFrame, seed: int, bucket_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """The written buckets: __bucket, __pos (from 0 within the bucket) and the columns of docs."""
    n = max(1, -(-(docs.agg(F.sum(size_of(F.col(text_col)))).first()[0] or 0) // bucket_bytes))
    hashed = [F.lit(seed), F.col(id_col), F.col(text_col)]
    hot = docs.groupBy(id_col).count().where(F.col("count") > HOT_ID).select(F.col(id_col).alias("__hot"))
    columns = docs.columns
    if hot.take(1):
        often = docs.join(hot, F.col(id_col).eqNullSafe(F.col("__hot")), "left_semi").groupBy(*columns).count()
        often = often.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("__copy"))
        rest = docs.join(hot, F.col(id_col).eqNullSafe(F.col("__hot")), "left_anti").withColumn("__copy", F.lit(0).cast("long"))
        docs = rest.unionByName(often)
        hashed.append(F.when(F.col("__copy") > 0, F.xxhash64("__copy", *columns)))
    record = F.struct(F.xxhash64(F.lit(~seed), F.col(id_col), F.col(text_col)).alias("k"), F.struct(*columns).alias("r"))
    scattered = docs.select(F.pmod(F.xxhash64(*hashed), F.lit(n)).cast("int").alias("__bucket"), record.alias("rec")).repartitionById(n, F.col("__bucket"))
    gathered = scattered.groupBy("__bucket").agg(F.collect_list("rec").alias("all"))
    drawn = F.shuffle(F.sort_array("all"), F.lit(seed))
    placed = gathered.select("__bucket", F.posexplode(drawn).alias("__pos", "rec"))
    return materialise(placed.select("__bucket", "__pos", "rec.r.*"), "shuffled-buckets")


def shard(docs: DataFrame, shards: int = 40, seed: int = 7, bucket_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs plus shard and slot (gapless from 0 in each shard), in a random order fixed by the seed.

    Null ids and texts, repeated rows (each keeps a place of its own), texts of any length and empty
    tables are fine.  Columns named shard, slot, __bucket or __pos are replaced.  Columns must be
    orderable (no maps).
    """
    docs = docs.drop("shard", "slot", "__bucket", "__pos")
    written = shuffle_to_buckets(docs, seed, bucket_bytes, id_col, text_col)
    counts = written.groupBy("__bucket").count()  # one row a bucket, read from one small column
    before = W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col("__bucket"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"), F.sum("count").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("__n"))
    if counts.count() <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)  # else the texts would be shuffled once more
    placed = written.join(offsets, "__bucket").withColumn("__place", F.col("__base") + F.col("__pos"))
    number = F.expr(f"cast(__place * {shards} div __n as int)")
    placed = placed.withColumn("shard", number).withColumn("slot", F.expr(f"__place - (shard * __n + {shards - 1}) div {shards}"))
    return placed.select(*docs.columns, "shard", "slot")


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """Write shard=N/ folders of Parquet, rows in slot order."""
    out = shard(docs, **how)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
