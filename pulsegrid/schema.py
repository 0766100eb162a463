"""Data model: two tables, the columns of query results, errors."""

from __future__ import annotations

from pyspark.sql import types as T

LABELS = T.MapType(T.StringType(), T.StringType(), False)
#: Dimension table, a row for each metric and label set.
SERIES = T.StructType([T.StructField("series_id", T.LongType()), T.StructField("metric_name", T.StringType()), T.StructField("labels", LABELS)])
#: Fact table, partitioned by timestamp_day; times have no zone and mean UTC.
SAMPLES = T.StructType([T.StructField("series_id", T.LongType()), T.StructField("timestamp", T.TimestampNTZType()), T.StructField("value", T.DoubleType())])
#: Samples as they arrive; ts in milliseconds.
WIRE = T.StructType([T.StructField("metric", T.StringType()), T.StructField("labels", T.MapType(T.StringType(), T.StringType())), T.StructField("ts", T.LongType()), T.StructField("value", T.DoubleType())])
#: Columns of every instant and range vector.
VECTOR = ["metric_name", "labels", "ts_us", "value"]


class BadQuery(ValueError):
    """The request can't be answered as asked (HTTP 400, bad_data)."""


class UnsupportedPromQL(BadQuery):
    """Valid PromQL outside the subset."""
