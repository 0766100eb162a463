"""Plain event and order tables as metric rows (metric, labels, ts_us, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import micros
from .store import as_tables

BOUNDS = ["10", "50", "100", "250", "+Inf"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", "event_type", F.col("user_id").cast("string").alias("user_id"), micros(F.col("ts")).alias("ts_us"), "value")


def _labels(*names: str):
    return F.create_map(*(x for n in names for x in (F.lit(n), F.col(n))))


def gauge(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """event_value{event_type, user_id}: the raw values."""
    return as_tables(events(spark, sf_dir).select(F.lit("event_value").alias("metric"), _labels("event_type", "user_id").alias("labels"), "ts_us", "value"))


def counter(spark: SparkSession, sf_dir: str, modulus: int = 7) -> tuple[DataFrame, DataFrame]:
    """event_total{event_type, user_id}: a count that starts anew at modulus."""
    n = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("ts_us", "event_id"))
    return as_tables(events(spark, sf_dir).select(F.lit("event_total").alias("metric"), _labels("event_type", "user_id").alias("labels"), "ts_us", (n % modulus).cast("double").alias("value")))


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """event_value and event_total together."""
    (a, b), (c, d) = gauge(spark, sf_dir), counter(spark, sf_dir)
    return a.unionByName(c), b.unionByName(d)


def odd_buckets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """event_value_bucket with bounds spelled in other ways, and series whose bound is no number."""
    series, samples = histogram(spark, sf_dir)
    spelled = F.create_map(*(F.lit(x) for x in ("10", "1e1", "50", "50.0", "100", "1E2", "250", "many", "+Inf", "inf")))
    return series.withColumn("labels", F.transform_values("labels", lambda k, v: F.when(k == "le", spelled[v]).otherwise(v))), samples


def histogram(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """event_value_bucket{event_type, user_id, le}: running counts of values up to le."""
    rows = events(spark, sf_dir).select("*", F.explode(F.array(*(F.lit(b) for b in BOUNDS))).alias("le"))
    hit = (F.col("value") <= F.when(F.col("le") == "+Inf", float("inf")).otherwise(F.expr("try_cast(le as double)"))).cast("double")
    n = F.sum(hit).over(Window.partitionBy("event_type", "user_id", "le").orderBy("ts_us", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return as_tables(rows.select(F.lit("event_value_bucket").alias("metric"), _labels("event_type", "user_id", "le").alias("labels"), "ts_us", n.alias("value")))
