"""Two-pass external shuffle into shards.

Pass 1 scatters records over buckets by a seeded hash of id and text; there are
as many buckets as make one fit in memory. Pass 2 orders each bucket by that
hash, applies a seeded Fisher-Yates shuffle, and places the buckets one after
another: the places are a uniform random order of all records. Equal cuts of it
are the shards, so their row counts are at most one apart (law ``rows``).

The order depends on the records, the seed and the bucket count alone, so a task
that runs again gives the same rows. Where more than HOT rows have one id and
text, they would all lie in one bucket: the records are then written as a table
with row numbers, which scatter those rows over all buckets; as they differ in
nothing that is hashed, only their number in each bucket depends on the layout
of the input.

Defined cases: a null text has no bytes; null ids hash as any value; repeated
rows are interchangeable; a text of any length is one record, and a bucket holds
one at least; input columns named shard or slot are replaced, others may have
any name; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._common import materialise, table, text_bytes_total

SEED, SHARDS = 20240, 8
BUCKET_BYTES, LEAST_BUCKETS = 48_000_000, 24
#: Buckets whose offsets may be broadcast: 16 bytes each.
BROADCAST_BUCKETS = 200_000
#: Rows of one id and text that may share a bucket.
HOT = 1_000


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def scattered(marked: DataFrame, buckets: int, hot: int) -> DataFrame:
    """marked with its bucket: by mark, and by row number too where a mark has more than hot rows."""
    often = marked.groupBy("mark").count().where(F.col("count") > hot).select(F.col("mark").alias("hot"))
    if often.isEmpty():
        return marked.select(F.pmod("mark", F.lit(buckets)).cast("int").alias("bucket"), "*")
    stored, often = materialise(marked.withColumn("no", F.monotonically_increasing_id())), materialise(often)
    few = F.broadcast if often.count() <= BROADCAST_BUCKETS else lambda df: df
    dealt = F.when(F.col("hot").isNotNull(), F.xxhash64("mark", "no")).otherwise(F.col("mark"))
    return stored.join(few(often), stored.mark == often.hot, "left").select(F.pmod(dealt, F.lit(buckets)).cast("int").alias("bucket"), *marked.columns)


def shuffle_into_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """df's columns, and shard (0 to shards - 1) and slot (gapless from 0 in each shard)."""
    df = df.drop("shard", "slot")
    buckets = LEAST_BUCKETS + text_bytes_total(df, text_col) // bucket_bytes
    mark = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    own = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields)])
    marked = df.select(mark.alias("mark"), *(F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(df.schema.fields)))
    marked = scattered(marked, buckets, hot)
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), *own.fields, T.StructField("place", T.LongType())])

    def mixed(key: tuple, rows: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        order = np.argsort(rows.column("mark").to_numpy(), kind="stable")
        order = order[np.random.Generator(np.random.PCG64([seed, bucket])).permutation(len(order))]  # Fisher-Yates
        return rows.drop_columns(["mark"]).take(pa.array(order)).append_column("place", pa.array(np.arange(len(order), dtype=np.int64)))

    counts = marked.groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(ends).alias("total"))  # a row for each bucket
    if buckets <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    out = marked.groupBy("bucket").applyInArrow(mixed, schema).join(offsets, "bucket")
    place = F.col("offset") + F.col("place")
    out = out.withColumn("place", place).withColumn("shard", F.expr(f"cast(place * {shards} div total as int)"))
    slot = F.expr(f"place - (shard * total + {shards - 1}) div {shards}")
    return out.select(*(F.col(f"c{i}").alias(f.name) for i, f in enumerate(df.schema.fields)), "shard", slot.alias("slot"))


def write_shards(df: DataFrame, path: str, files_per_shard: int = 1, **options) -> None:
    """Writes shuffled records as Parquet, a folder for each shard, rows in the order of their slots."""
    out = shuffle_into_shards(df, **options)
    parts = options.get("shards", SHARDS) * files_per_shard
    out.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shuffle_into_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return got.select("doc_id", record_size(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
