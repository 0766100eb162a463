"""rate, irate, increase and delta over an evaluation grid.

Window bounds of a grid, (e - range, e], cut time into panes as wide as the
greatest common divisor of range and step. The step from a sample to the one
before it depends on these two alone, so it is computed once for each series; a
pane sums the steps within it and keeps what its first and last sample have, and a
window combines panes: it counts the step into a pane if it holds the sample
before. The first sample of a pane or window is the one whose sample before lies
outside, so that all aggregates are sums, minima and maxima of numbers. A pane lies in the windows of the grid points lo to hi, found by integer
arithmetic, so there is no range join. Samples are sorted and shuffled once, by
series; panes, windows and what each of them sums need no further shuffle, and
only panes are repeated for overlapping windows. An instant query with its
closed window is a grid of one point and a range longer by a microsecond.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import finite


def on_grid(rows: DataFrame, start: int, step: int, points: int, range_us: int) -> DataFrame:
    """rows once for each grid point whose window holds ts_us, with eval_us."""
    if points == 1:
        return rows.where(F.col("ts_us").between(start - range_us + 1, start)).withColumn("eval_us", F.lit(start))
    lo = F.greatest(F.lit(0), F.expr(f"(ts_us - {start} + {step - 1}) div {step}"))
    # Exact division floors below zero only from the left, so the end is floored by hand.
    hi = F.least(F.lit(points - 1), F.expr(f"cast(floor((ts_us + {range_us} - {start} - 1) / cast({step} as decimal(20, 0))) as bigint)"))
    rows = rows.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi")
    return rows.withColumn("i", F.explode(F.sequence("lo", "hi"))).withColumn("eval_us", F.lit(start) + F.col("i") * step).drop("lo", "hi", "i")


def range_function(rows: DataFrame, function: str, start: int, step: int, points: int, range_us: int) -> DataFrame:
    """(series_id, ts_us, value) at each grid point, from samples of series."""
    if points == 1:
        rows = rows.where(F.col("ts_us").between(start - range_us + 1, start))
    order = Window.partitionBy("series_id").orderBy("ts_us", "value")
    rows = rows.withColumns({"before": F.lag("value").over(order), "before_us": F.lag("ts_us").over(order), "after_us": F.lead("ts_us").over(order)})
    rows = rows.withColumn("up", F.when(F.col("value") >= F.col("before"), F.col("value") - F.col("before")).otherwise(F.col("value")))
    width = range_us if points == 1 else gcd(range_us, step)
    # Panes end at start + k * width; a time on a bound belongs to the pane that ends there.
    k = F.floor((F.col("ts_us") - start + (width - 1)) / F.lit(width).cast("decimal(20, 0)")).cast("long")
    rows = rows.withColumn("pane_us", F.lit(start) + k * width)
    opens = F.col("before_us").isNull() | (F.col("before_us") <= F.col("pane_us") - width)
    ends = F.col("after_us").isNull() | (F.col("after_us") > F.col("pane_us"))
    panes = rows.groupBy("series_id", "pane_us").agg(
        F.count("*").alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.max(F.when(opens, F.col("before_us"))).alias("before_us"), F.max(F.when(ends, F.col("after_us"))).alias("after_us"),
        F.sum(F.when(~opens, F.col("up"))).alias("inner"), F.sum(F.when(opens, F.col("up"))).alias("joint"), F.sum(F.when(opens, F.col("value"))).alias("first"),
        F.sum(F.when(ends, F.col("value"))).alias("last"), F.sum(F.when(ends, F.col("up"))).alias("last_up"), F.max(F.when(ends, F.col("before_us"))).alias("last_before_us"),
    )
    out = on_grid(panes.withColumnRenamed("pane_us", "ts_us"), start, step, points, range_us - width + 1)
    opens = F.col("before_us").isNull() | (F.col("before_us") <= F.col("eval_us") - range_us)
    ends = F.col("after_us").isNull() | (F.col("after_us") > F.col("eval_us"))
    got = out.groupBy("series_id", "eval_us").agg(
        F.sum("n").alias("n"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
        F.coalesce(F.sum("inner"), F.lit(0.0)).alias("inner"), F.coalesce(F.sum(F.when(~opens, F.col("joint"))), F.lit(0.0)).alias("joints"),
        F.sum(F.when(opens, F.col("first"))).alias("first"), F.sum(F.when(ends, F.col("last"))).alias("last"), F.sum(F.when(ends, F.col("last_up"))).alias("last_up"), F.max(F.when(ends, F.col("last_before_us"))).alias("last_before_us"),
    )
    span, up = (F.col("last_us") - F.col("first_us")).cast("double"), F.col("inner") + F.col("joints")
    if function == "delta":
        got, value = got.where("n >= 2"), F.col("last") - F.col("first")
    elif function == "irate":
        got = got.where(f"last_before_us > eval_us - {range_us} and last_us > last_before_us")
        value = F.col("last_up") * 1e6 / (F.col("last_us") - F.col("last_before_us")).cast("double")
    else:
        got, value = got.where("n >= 2 and last_us > first_us"), up * 1e6 / span if function == "rate" else up
    return got.select("series_id", F.col("eval_us").alias("ts_us"), value.alias("value")).where(finite(F.col("value")))
