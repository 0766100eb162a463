"""What several operators share: tokenising, shared storage, connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words in every contract: runs of anything but space and the controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch that goes to a Python worker, and Spark's own bound.
BATCH_BYTES, BATCH_CONF, BATCH_DEFAULT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", f"{64 << 20}b"
CLEAN_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def words_of(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 bytes; bytes.split() cuts at exactly 20 and 09 to 0D."""
    return text.split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def release() -> None:
    """Gives freed memory back to the system: a worker that waits for its next task should hold none."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over batches of few bytes rather than of many rows, however long the texts are (a text is never cut).

    Spark has this bound for the session alone: it is set once, unless the session has one of its own.
    """
    if df.sparkSession.conf.get(BATCH_CONF) == BATCH_DEFAULT:
        df.sparkSession.conf.set(BATCH_CONF, str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(task, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Where it is unset and everything runs on this machine (tests), a temporary one."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not own:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        own = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", own)
    return own.rstrip("/")


def tables_dir(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables; it may go when the application's results are written."""
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each table written herein go as soon as it is written; else Spark keeps them until the driver happens to collect what refers to them."""
    before = spark.conf.get(CLEAN_CONF, "false")
    spark.conf.set(CLEAN_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_CONF, before)


def materialise(df: DataFrame, clean: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again.

    It cuts the lineage, and survives the loss of any executor. clean: the
    shuffle files that made it go at once (``cleaned``).
    """
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{uuid.uuid4().hex}"
    with cleaned(spark) if clean else nullcontext():
        df.write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Removes the table of a frame that materialise returned and that nothing reads any more."""
    remove(df.sparkSession, df.table_path)


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def text_bytes_total(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts: one row comes to the driver."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0])


def deflate(a: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(a).tobytes(), 1)


def inflate(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), dtype)


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links of longs -> (node, root): the smallest node reachable, for each node that has a link.

    Alternates the large-star and small-star steps until the links no longer
    change; each step is an aggregate and an equi-join, so a node with very
    many links is pre-aggregated and its join can be split.
    """
    u, v = F.col("u"), F.col("v")
    e = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        sign = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if sign == before or not sign[0]:
            return e.select(u.alias("node"), v.alias("root"))
        before = sign
        both = e.union(e.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(v.alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(v.alias("u"), F.col("m").alias("v")).where("u != v")
        last, e = e, materialise(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        discard(last)
