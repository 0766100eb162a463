"""Ingest: wire samples to validated rows and a report of rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import finite, series_id, sorted_labels
from ..schema import WIRE

NAME = r"\A[a-zA-Z_][a-zA-Z0-9_]*\z"
OLDEST_MS, NEWEST_MS = 3_600_000, 300_000


REQUEST = T.StructType([T.StructField("samples", T.ArrayType(WIRE)), T.StructField("_corrupt", T.StringType())])


def parse_json(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Wire rows of request bodies held as text, as read_json gives them."""
    parsed = F.from_json(column, REQUEST, {"columnNameOfCorruptRecord": "_corrupt"})
    return exploded(bodies.select(parsed.alias("r")).select("r.samples", F.when(F.col("r").isNull(), "").otherwise(F.col("r._corrupt")).alias("_corrupt")))


def read_json(spark: SparkSession, path: str, streaming: bool = False, **options) -> DataFrame:
    """Requests {"samples": [...]}, one JSON document a file, as wire rows with their place in the request.

    A request that is no such document is one row with an error. options are the
    file source's: maxFilesPerTrigger and maxBytesPerTrigger bound a micro-batch,
    cleanSource removes or archives files that are done.
    """
    reader = spark.readStream if streaming else spark.read
    return exploded(reader.schema(REQUEST).options(**options).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path))


def exploded(requests: DataFrame) -> DataFrame:
    """(index, metric, labels, ts, value, error); index and all but error are null for a request that can't be read."""
    error = F.when(F.col("_corrupt").isNotNull(), "request is not valid JSON").when(F.col("samples").isNull(), "request has no samples")
    rows = requests.select(error.alias("error"), F.posexplode_outer(F.when(error.isNull(), F.col("samples"))).alias("index", "s")).where("error is not null or index is not null")
    return rows.select("index", "s.metric", F.coalesce("s.labels", F.expr("cast(map() as map<string, string>)")).alias("labels"), "s.ts", "s.value", "error")


def reason(now_ms: Column, error: Column) -> Column:
    """Why a sample is rejected, the first failure in a fixed order; null if it isn't. The texts are fixed by the interface."""
    keys = F.map_keys(F.col("labels"))
    bad = F.get(F.filter(F.array_sort(keys), lambda k: k.startswith("__") | ~k.rlike(NAME)), F.lit(0))
    age = F.col("ts") - now_ms
    infinite = F.when(F.isnan("value"), "NaN").when(F.col("value") > 0, "Infinity").otherwise("-Infinity")
    return (
        F.when(error.isNotNull(), error)
        .when(F.coalesce(F.col("metric"), F.lit("")) == "", "metric name is empty")
        .when(~F.col("metric").rlike(NAME), F.format_string("metric name '%s' contains invalid characters (must match [a-zA-Z_][a-zA-Z0-9_]*)", "metric"))
        .when(bad.startswith("__"), F.format_string("label name '%s' is reserved (starts with '__')", bad))
        .when(bad.isNotNull(), F.format_string("label name '%s' is invalid (must match [a-zA-Z_][a-zA-Z0-9_]*)", bad))
        .when(F.exists(F.map_values("labels"), lambda x: x.isNull()), "label value is null")
        .when(F.col("value").isNull(), "value is missing")
        .when(~finite(F.col("value")), F.format_string("value is not finite: %s", infinite))
        .when(F.col("ts").isNull(), "timestamp is missing")
        .when(age < -OLDEST_MS, F.format_string(f"timestamp %d ms is too old: now=%d ms, grace={OLDEST_MS} ms", "ts", now_ms))
        .when(age > NEWEST_MS, F.format_string(f"timestamp %d ms is in the future: now=%d ms, grace={NEWEST_MS} ms", "ts", now_ms))
    )


def validated(wire: DataFrame, now_ms: Column | int | None = None) -> DataFrame:
    """wire with reason, and for accepted rows series_id, sorted labels and ts_us. The clock is the wall's, one value a micro-batch, unless given."""
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    error = F.col("error") if "error" in wire.columns else F.lit(None).cast("string")
    out = wire.withColumn("reason", reason(now, error)).withColumn("labels", sorted_labels(F.col("labels")))
    largest = (1 << 63) - 1
    us = F.when(F.abs(F.col("ts")) <= largest // 1000, F.col("ts") * 1000).otherwise(F.when(F.col("ts") > 0, largest).otherwise(-largest - 1))
    return out.withColumn("series_id", series_id(F.col("metric"), F.col("labels"))).withColumn("ts_us", F.when(F.col("reason").isNull(), us))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("reason is null").select("series_id", "metric", "labels", "ts_us", "value")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where("reason is not null").select("index", "reason")
