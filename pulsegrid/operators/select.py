"""Selectors: matchers on series, time-bounded scans of samples, latest samples."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import at_micros, micros
from ..plans.promql import Matcher, Selector
from ..schema import BadQuery


def matcher(m: Matcher) -> Column:
    """A missing label is an empty one; patterns match whole values and have no look-around or back-references."""
    own = F.col("metric_name") if m.label == "__name__" else F.coalesce(F.col("labels")[m.label], F.lit(""))
    if m.op == "=":
        return own == m.value
    if m.op == "!=":
        return own != m.value
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", m.value):
        raise BadQuery(f"pattern {m.value!r} isn't linear")
    legal_pattern(m.value)
    hit = own.rlike(f"\\A(?s:{m.value})\\z")
    return hit if m.op == "=~" else ~hit


def legal_pattern(pattern: str) -> None:
    """Refuses, on the driver, what the executors' engine could not compile."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(f"(?s:{pattern})")
    except (Py4JJavaError, IllegalArgumentException) as e:
        raise BadQuery(f"bad pattern {pattern!r}: {e}") from None


def matching_series(series: DataFrame, s: Selector) -> DataFrame:
    if s.name is not None:
        series = series.where(F.col("metric_name") == s.name)
    for m in s.matchers:
        series = series.where(matcher(m))
    return series


def bounded(samples: DataFrame, low_us: int, high_us: int) -> DataFrame:
    """(series_id, ts_us, value) of the closed interval; the day partition is bounded explicitly, as it can't be derived from the time."""
    if "timestamp_day" in samples.columns:
        samples = samples.where(F.col("timestamp_day").between(F.to_date(at_micros(low_us)), F.to_date(at_micros(high_us))))
    samples = samples.where(F.col("timestamp").between(at_micros(low_us), at_micros(high_us)))
    return samples.select("series_id", micros(F.col("timestamp")).alias("ts_us"), "value")


def selected(series: DataFrame, samples: DataFrame, low_us: int, high_us: int) -> DataFrame:
    """Samples of the series; only ids are joined, labels come after the aggregate."""
    return bounded(samples, low_us, high_us).join(series.select("series_id"), "series_id")


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """The last sample of each series; of equal times the greatest value."""
    last = rows.groupBy("series_id", *keys).agg(F.max(F.struct("ts_us", "value")).alias("s"))
    return last.select("series_id", *keys, "s.ts_us", "s.value")


def labelled(rows: DataFrame, series: DataFrame) -> DataFrame:
    return rows.join(series, "series_id").select("metric_name", "labels", "ts_us", "value")
