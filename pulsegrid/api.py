"""Queries over a pair of series and samples tables, and their JSON forms."""

from __future__ import annotations

import time as clock
from datetime import date, datetime, timezone
from decimal import Decimal
from math import isinf, isnan

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import select
from .plans.compile import LOOKBACK_US, Context, compiled
from .plans.promql import Selector, duration_us, parse, time_us
from .schema import BadQuery
from .sources.store import MetricStore, register_views

MAX_ROWS = 100_000


class Engine:
    def __init__(self, series: DataFrame, samples: DataFrame, lookback: str | float = LOOKBACK_US / 1e6) -> None:
        self.series_table, self.samples_table, self.lookback = series, samples, duration_us(lookback)
        self.spark: SparkSession = series.sparkSession

    @classmethod
    def of_store(cls, store: MetricStore, **options) -> Engine:
        return cls(store.series(), store.samples(), **options)

    def query(self, text: str, time: str | float | datetime | None = None) -> DataFrame:
        """An instant query, now unless a time is given."""
        t = time_us(clock.time() if time is None else time)
        return compiled(parse(text), Context(self.series_table, self.samples_table, t, t, lookback=self.lookback))

    def query_range(self, text: str, start, end, step, aligned: bool = False) -> DataFrame:
        """A query at start, start + step, ... up to end."""
        return compiled(parse(text), Context(self.series_table, self.samples_table, time_us(start), time_us(end), duration_us(step), self.lookback, aligned))

    def labels(self) -> DataFrame:
        """Names of all labels, and __name__."""
        names = self.series_table.select(F.explode(F.map_keys("labels")).alias("label"))
        return names.union(self.spark.range(1).select(F.lit("__name__"))).distinct().orderBy("label")

    def label_values(self, label: str) -> DataFrame:
        own = F.col("metric_name") if label == "__name__" else F.col("labels")[label]
        return self.series_table.select(own.alias("value")).where("value is not null").distinct().orderBy("value")

    def series(self, *matches: str) -> DataFrame:
        """(series_id, metric_name, labels) of the series that any selector matches."""
        out = None
        for m in matches:
            s = parse(m)
            if not isinstance(s, Selector):
                raise BadQuery("match[] takes selectors")
            found = select.matching_series(self.series_table, s)
            out = found if out is None else out.unionByName(found)
        return self.series_table.where("false") if out is None else out.dropDuplicates(["series_id"])

    def sql(self, text: str, max_rows: int = MAX_ROWS) -> dict:
        """Rows of any statement over the views, at most max_rows of them."""
        began = clock.time()
        register_views(self.spark, self.series_table, self.samples_table)
        df = self.spark.sql(text)
        rows = df.limit(max_rows + 1).collect()
        return {"columns": [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields], "rows": [{k: rendered(v) for k, v in r.asDict(recursive=True).items()} for r in rows[:max_rows]], "row_count": min(len(rows), max_rows), "elapsed_ms": round((clock.time() - began) * 1000), "truncated": len(rows) > max_rows}


def rendered(v):
    """A result value in JSON."""
    if isinstance(v, float) and (isnan(v) or isinf(v)):
        return "NaN" if isnan(v) else "Infinity" if v > 0 else "-Infinity"
    if isinstance(v, datetime):
        v = v.astimezone(timezone.utc) if v.tzinfo else v
        return v.strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, dict):
        return {str(k): rendered(x) for k, x in v.items() if k is not None}
    if isinstance(v, (list, tuple)):
        return [rendered(x) for x in v]
    return v if v is None or isinstance(v, (bool, int, float, str)) else str(v)


def number(v: float) -> str:
    """Decimals, never an exponent."""
    if isnan(v) or isinf(v):
        return "NaN" if isnan(v) else "+Inf" if v > 0 else "-Inf"
    return format(Decimal(repr(v)), "f").removesuffix(".0")


def _metric(r) -> dict:
    return ({"__name__": r["metric_name"]} if r["metric_name"] else {}) | dict(sorted(r["labels"].items()))


def vector_json(v: DataFrame) -> dict:
    rows = sorted(v.collect(), key=lambda r: (r["metric_name"], sorted(r["labels"].items())))
    return {"status": "success", "data": {"resultType": "vector", "result": [{"metric": _metric(r), "value": [r["ts_us"] / 1e6, number(r["value"])]} for r in rows]}}


def matrix_json(v: DataFrame) -> dict:
    series: dict = {}
    for r in sorted(v.collect(), key=lambda r: (r["metric_name"], sorted(r["labels"].items()), r["ts_us"])):
        series.setdefault((r["metric_name"], tuple(sorted(r["labels"].items()))), (_metric(r), []))[1].append([r["ts_us"] / 1e6, number(r["value"])])
    return {"status": "success", "data": {"resultType": "matrix", "result": [{"metric": m, "values": p} for m, p in series.values()]}}


def error_json(e: Exception) -> tuple[int, dict]:
    bad = isinstance(e, BadQuery)
    return (400 if bad else 500), {"status": "error", "errorType": "bad_data" if bad else "internal", "error": str(e)}


def plain_error_json(e: Exception, reading: bool = True) -> tuple[int, dict]:
    """The error form of SQL (a statement that fails is the caller's matter) and of ingest (reading: of a body that can't be read, else of a store that can't be written)."""
    return (400 if reading else 503), {"error": str(e)}


def ingest_json(rows: DataFrame) -> dict:
    """The answer to one request of validated rows: how many were accepted, and the rejects in order."""
    bad = rows.where("reason is not null").select("index", "reason").orderBy("index").collect()
    return {"accepted": rows.where("reason is null").count(), "rejected": [{"index": r["index"], "reason": r["reason"]} for r in bad]}
