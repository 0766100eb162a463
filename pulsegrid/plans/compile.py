"""Compiles a PromQL tree into one lazy DataFrame, for an instant or a grid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rangefn, select, vector
from ..schema import BadQuery, UnsupportedPromQL
from .promql import Aggregate, Binary, Negate, Number, Quantile, RangeCall, RANKED, Selector

MAX_POINTS = 11_000
LOOKBACK_US = 300_000_000


@dataclass(frozen=True)
class Context:
    series: DataFrame
    samples: DataFrame
    start: int
    end: int
    step: int | None = None  # None: an instant query at start
    lookback: int = LOOKBACK_US
    aligned: bool = False  # range selectors at grid points with the lookback, else as raw samples

    @property
    def instant(self) -> bool:
        return self.step is None

    @property
    def points(self) -> int:
        return 1 if self.instant else max(0, (self.end - self.start) // self.step + 1)


def compiled(node, c: Context) -> DataFrame:
    """The vector of node; instant results have the time of the query, but for a bare selector."""
    if not c.instant and c.step <= 0:
        raise BadQuery("step must be above 0")
    value = evaluate(node, c)
    if isinstance(value, float):
        at = c.series.sparkSession.range(c.points).select((F.lit(c.start) + F.col("id") * (c.step or 0)).alias("ts_us"))
        return at.select(F.lit("").alias("metric_name"), F.expr("map('', '')").alias("labels"), "ts_us", F.lit(value).alias("value")).withColumn("labels", F.map_filter("labels", lambda k, _: k != ""))
    return value


def evaluate(node, c: Context) -> DataFrame | float:
    if isinstance(node, Number):
        return node.value
    if isinstance(node, Selector):
        if node.range_us is not None:
            raise UnsupportedPromQL("a range selector outside of a range function")
        return selector(node, c)
    if isinstance(node, RangeCall):
        return range_call(node, c)
    if isinstance(node, Aggregate) and node.function not in RANKED and (isinstance(node.inner, RangeCall) or pure(node.inner)):
        # Samples and range functions of series are summed by ids; labels come back after.
        rows, series = range_rows(node.inner, c) if isinstance(node.inner, RangeCall) else selector_rows(node.inner, c)
        return vector.aggregate_series(now(rows, c), series, node, isinstance(node.inner, RangeCall))
    if isinstance(node, Aggregate):
        inner = now(vector_of(node.inner, c, node.function), c)
        if node.function in RANKED:
            return vector.rank(inner, node)
        return vector.aggregate(inner, node, isinstance(node.inner, RangeCall))
    if isinstance(node, Quantile):
        return vector.histogram_quantile(now(vector_of(node.inner, c, "histogram_quantile"), c), node.q)
    if isinstance(node, Negate):
        inner = evaluate(node.inner, c)
        return -inner if isinstance(inner, float) else now(inner, c).select(F.lit("").alias("metric_name"), "labels", "ts_us", (-F.col("value")).alias("value"))
    if isinstance(node, Binary) and not c.instant and node.op not in ("and", "or", "unless") and node.match is None and all(pure(x) and x.name for x in (node.left, node.right)):
        return vector.with_series(selector_rows(node.left, c), selector_rows(node.right, c), node)
    if isinstance(node, Binary):
        left, right = evaluate(node.left, c), evaluate(node.right, c)
        if isinstance(left, float) and isinstance(right, float):
            return vector.constant(node, left, right)
        if node.op in ("and", "or", "unless") and (isinstance(left, float) or isinstance(right, float)):
            raise BadQuery(f"{node.op} takes two vectors")
        if isinstance(left, float):
            return vector.with_scalar(now(right, c), node, left, True)
        if isinstance(right, float):
            return vector.with_scalar(now(left, c), node, right, False)
        return vector.with_vector(now(left, c), now(right, c), node)
    raise UnsupportedPromQL(type(node).__name__)


def vector_of(node, c: Context, name: str) -> DataFrame:
    got = evaluate(node, c)
    if isinstance(got, float):
        raise BadQuery(f"{name} takes a vector")
    return got


def now(v: DataFrame, c: Context) -> DataFrame:
    return v.withColumn("ts_us", F.lit(c.start)) if c.instant else v


def shifted(node: Selector, c: Context) -> tuple[int, int]:
    """First and last time that the selector looks at."""
    start, end = (node.at_us, node.at_us) if node.at_us is not None else (c.start, c.end)
    return start - node.offset_us, end - node.offset_us


def pure(node) -> bool:
    return isinstance(node, Selector) and node.range_us is None


def selector(node: Selector, c: Context) -> DataFrame:
    return select.labelled(*selector_rows(node, c))


def selector_rows(node: Selector, c: Context) -> tuple[DataFrame, DataFrame]:
    """(series_id, ts_us, value) and the series."""
    series = select.matching_series(c.series, node)
    start, end = shifted(node, c)
    if c.instant:
        return select.latest(select.selected(series, c.samples, start - c.lookback, start)), series
    if node.at_us is not None or c.aligned:
        points = 1 if node.at_us is not None else c.points
        limit(points)
        rows = rangefn.on_grid(select.selected(series, c.samples, start - c.lookback, end), start, c.step, points, c.lookback + 1)
        got = select.latest(rows, "eval_us").withColumn("ts_us", F.col("eval_us"))
        return spread(got, node, c).select("series_id", "ts_us", "value"), series
    got = select.selected(series, c.samples, start, end)
    return got.withColumn("ts_us", F.col("ts_us") + node.offset_us) if node.offset_us else got, series


def range_call(node: RangeCall, c: Context) -> DataFrame:
    return select.labelled(*range_rows(node, c))


def range_rows(node: RangeCall, c: Context) -> tuple[DataFrame, DataFrame]:
    """(series_id, ts_us, value) and the series."""
    s = node.selector
    series = select.matching_series(c.series, s)
    start, end = shifted(s, c)
    points = 1 if s.at_us is not None else c.points
    limit(c.points)
    # The window of an instant is closed at both ends, those of a grid are open at the left.
    width = s.range_us + int(c.instant)
    rows = select.selected(series, c.samples, start - width + 1, end)
    got = rangefn.range_function(rows, node.function, start, c.step or 1, points, width) if points else rangefn.range_function(rows.where("false"), node.function, start, 1, 1, width)
    return spread(got, s, c), series


def spread(got: DataFrame, node: Selector, c: Context) -> DataFrame:
    """Back to the query's times: undoes an offset, and repeats what @ fixed at every point."""
    if node.at_us is not None:
        every = F.transform(F.sequence(F.lit(0), F.lit(c.points - 1)), lambda i: F.lit(c.start) + i * (c.step or 0))
        return got.withColumn("ts_us", F.explode(every)) if c.points else got.where("false")
    return got.withColumn("ts_us", F.col("ts_us") + node.offset_us) if node.offset_us else got


def limit(points: int) -> None:
    if points > MAX_POINTS:
        raise BadQuery(f"{points} evaluation points; at most {MAX_POINTS}")
