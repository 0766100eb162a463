"""Operators on vectors: aggregates, ranks, arithmetic, comparison, matching, sets, quantiles.

A vector has the columns metric_name, labels, ts_us and value. Every operator is
written once: a grid only adds ts_us to its keys.
"""

from __future__ import annotations

from math import isfinite, isnan

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import ARITHMETIC, COMPARE, drop_labels, finite, keep_labels, label_key
from ..plans.promql import Aggregate, Binary
from ..schema import BadQuery

CALLS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": lambda c: F.count(c).cast("double"), "group": lambda c: F.lit(1.0), "stddev": F.stddev_pop, "stdvar": F.var_pop}


def group_labels(node: Aggregate) -> Column:
    return drop_labels(F.col("labels"), list(node.labels)) if node.without else keep_labels(F.col("labels"), list(node.labels))


def aggregate(v: DataFrame, node: Aggregate, only_finite: bool) -> DataFrame:
    got = v.where("value is not null").select(group_labels(node).alias("labels"), "ts_us", "value").groupBy("labels", "ts_us").agg(CALLS[node.function](F.col("value")).alias("value"))
    got = got.select(F.lit("").alias("metric_name"), "labels", "ts_us", "value")
    return got.where(finite(F.col("value"))) if only_finite else got.where("value is not null")


def aggregate_series(rows: DataFrame, series: DataFrame, node: Aggregate, only_finite: bool) -> DataFrame:
    """aggregate of (series_id, ts_us, value): groups are formed among the series and named by their least id; no label meets a sample."""
    key = label_key(group_labels(node))
    of = series.select("series_id", key.alias("key"), F.min("series_id").over(Window.partitionBy(key)).alias("group"))
    got = rows.where("value is not null").join(of.select("series_id", "group"), "series_id").groupBy("group", "ts_us").agg(CALLS[node.function](F.col("value")).alias("value"))
    got = got.where(finite(F.col("value"))) if only_finite else got.where("value is not null")
    named = of.where("series_id = group").select("group", F.map_from_entries("key").alias("labels"))
    return got.join(named, "group").select(F.lit("").alias("metric_name"), "labels", "ts_us", "value")


def rank(v: DataFrame, node: Aggregate) -> DataFrame:
    """topk and bottomk; ties go by metric and labels."""
    n = int(node.count) if isfinite(node.count) and node.count > 0 else 0
    key = label_key(F.col("labels"))
    order = [F.col("value").desc() if node.function == "topk" else F.col("value").asc(), F.col("metric_name"), key]
    w = Window.partitionBy("ts_us", label_key(group_labels(node))).orderBy(*order)
    return v.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def with_scalar(v: DataFrame, node: Binary, scalar: float, scalar_left: bool) -> DataFrame:
    own, other = F.col("value"), F.lit(float(scalar))
    a, b = (other, own) if scalar_left else (own, other)
    if node.op in COMPARE:
        hit = COMPARE[node.op](a, b)
        if not node.bool:
            return v.where(hit)
        value = F.when(hit, 1.0).otherwise(0.0)
    else:
        value = ARITHMETIC[node.op](a, b)
    return v.select(F.lit("").alias("metric_name"), "labels", "ts_us", value.alias("value"))


def match_labels(node: Binary) -> Column:
    if node.match == "on":
        return keep_labels(F.col("labels"), list(node.labels))
    return drop_labels(F.col("labels"), list(node.labels) if node.match else [])


def with_vector(left: DataFrame, right: DataFrame, node: Binary) -> DataFrame:
    """Matches by labels and time.

    Of several on a side that should have one, the last by labels counts, and of
    those the greatest value: a matching of many to many is not refused.
    """
    key = label_key(match_labels(node)).alias("key")
    if node.op in ("and", "unless"):
        return left.withColumn("key", key).join(right.select(key, "ts_us").distinct(), ["key", "ts_us"], "left_semi" if node.op == "and" else "left_anti").select(*left.columns)
    if node.op == "or":
        rest = right.withColumn("key", key).join(left.select(key, "ts_us").distinct(), ["key", "ts_us"], "left_anti").select(*left.columns)
        return left.unionByName(rest)
    many, one = (right, left) if node.group == "right" else (left, right)
    last = lambda v: v.groupBy(key, "ts_us").agg(F.max(F.struct(label_key(F.col("labels")).alias("k"), "value")).alias("s"))
    ones = last(one).select("key", "ts_us", F.col("s.value").alias("one"), F.map_from_entries("s.k").alias("one_labels"))
    if node.group is None:
        many = many.withColumn("key", key).groupBy("key", "ts_us").agg(F.max(F.struct(label_key(F.col("labels")).alias("k"), "value", "metric_name")).alias("s")).select("key", "ts_us", F.col("s.metric_name").alias("metric_name"), F.map_from_entries("s.k").alias("labels"), "s.value")
    else:
        many = many.withColumn("key", key)
    both = many.join(ones, ["key", "ts_us"])
    a, b = (F.col("one"), F.col("value")) if node.group == "right" else (F.col("value"), F.col("one"))
    labels = F.col("labels")
    if node.group is None and node.match == "on":
        labels = keep_labels(labels, list(node.labels))
    elif node.group is None:
        labels = drop_labels(labels, list(node.labels))
    elif node.include:
        labels = F.map_concat(drop_labels(labels, list(node.include)), keep_labels(F.col("one_labels"), list(node.include)))
    name = F.lit("")
    if node.op in COMPARE:
        hit = COMPARE[node.op](a, b)
        if node.bool:
            value = F.when(hit, 1.0).otherwise(0.0)
        else:
            both, value, name = both.where(hit), F.col("value"), F.col("metric_name")
    else:
        value = ARITHMETIC[node.op](a, b)
    return both.select(name.alias("metric_name"), labels.alias("labels"), "ts_us", value.alias("value")).where("value is not null")


def with_series(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame], node: Binary) -> DataFrame:
    """with_vector for (samples, series) of one metric on each side, matched by all labels: series meet first, then samples by id and time."""
    once = lambda rows: rows.groupBy("series_id", "ts_us").agg(F.max("value").alias("value"))
    key = label_key(F.col("labels")).alias("key")
    pairs = left[1].select("series_id", key).join(right[1].select(F.col("series_id").alias("other"), key), "key").select("series_id", "other")
    ones = once(right[0]).select(F.col("series_id").alias("other"), "ts_us", F.col("value").alias("one"))
    both = once(left[0]).join(pairs, "series_id").join(ones, ["other", "ts_us"])
    a, b, name = F.col("value"), F.col("one"), F.lit("")
    if node.op in COMPARE and not node.bool:
        both, name = both.where(COMPARE[node.op](a, b)), F.col("metric_name")
        value = a
    else:
        value = F.when(COMPARE[node.op](a, b), 1.0).otherwise(0.0) if node.op in COMPARE else ARITHMETIC[node.op](a, b)
    got = both.select("series_id", "ts_us", value.alias("value")).where("value is not null")
    return got.join(left[1], "series_id").select(name.alias("metric_name"), "labels", "ts_us", "value")


def histogram_quantile(v: DataFrame, q: float) -> DataFrame:
    """Quantile of cumulative buckets, which are few in each histogram: they meet as one sorted array."""
    le = F.expr("CASE WHEN lower(labels['le']) IN ('+inf', 'inf') THEN double('Infinity') WHEN lower(labels['le']) = '-inf' THEN double('-Infinity') ELSE try_cast(labels['le'] AS double) END")
    rows = v.select(drop_labels(F.col("labels"), ["le"]).alias("labels"), "ts_us", le.alias("le"), F.col("value").alias("cum")).where("le is not null and not isnan(le)")
    g = rows.groupBy("labels", "ts_us").agg(F.sort_array(F.collect_list(F.struct("le", "cum"))).alias("b")).where("size(b) >= 2")
    g = g.withColumn("total", F.element_at("b", -1)["cum"]).where("total > 0 and not isnan(total)")
    if isnan(q):
        value = F.lit(None).cast("double")
    elif q <= 0:
        value = F.expr("get(filter(b, x -> x.cum > 0), 0).le")
    elif q >= 1:
        value = F.expr("array_max(transform(filter(b, x -> abs(x.le) < double('Infinity')), x -> x.le))")
    else:
        g = g.withColumn("want", F.col("total") * q)
        g = g.withColumn("i", F.expr("get(filter(transform(b, (x, i) -> CASE WHEN x.cum >= want THEN i END), i -> i IS NOT NULL), 0)")).where("i is not null")
        g = g.withColumn("x", F.expr("b[i]")).withColumn("p", F.expr("CASE WHEN i > 0 THEN b[i - 1] ELSE named_struct('le', 0D, 'cum', 0D) END"))
        value = F.expr("CASE WHEN abs(x.le) = double('Infinity') THEN p.le WHEN x.cum - p.cum <= 0 THEN x.le ELSE p.le + (want - p.cum) / (x.cum - p.cum) * (x.le - p.le) END")
    return g.select(F.lit("").alias("metric_name"), "labels", "ts_us", value.alias("value")).where(finite(F.col("value")))


def constant(node: Binary, a: float, b: float) -> float:
    """Two scalars, by IEEE rules: nothing raises."""
    if node.op in COMPARE:
        if not node.bool:
            raise BadQuery("comparison of scalars needs bool")
        return float({"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[node.op])
    with np.errstate(all="ignore"):
        x, y = np.float64(a), np.float64(b)
        return float({"+": np.add, "-": np.subtract, "*": np.multiply, "/": np.divide, "%": np.fmod, "^": np.power, "atan2": np.arctan2}[node.op](x, y))
