"""Column expressions: series ids, label maps, IEEE arithmetic, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def label_key(labels: Column) -> Column:
    """A label map as a sorted array of entries: comparable, and free of the ambiguity of joined text."""
    return F.array_sort(F.map_entries(labels))


def series_id(metric: Column, labels: Column) -> Column:
    """A stable 63-bit id of metric and labels, whatever the order of the labels."""
    return F.shiftrightunsigned(F.xxhash64(metric, label_key(labels)), 1)


def sorted_labels(labels: Column) -> Column:
    return F.map_from_entries(label_key(labels))


def keep_labels(labels: Column, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, _: k.isin(*names) if names else F.lit(False))


def drop_labels(labels: Column, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, _: ~k.isin(*names)) if names else labels


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < INF)


def divide(a: Column, b: Column) -> Column:
    """IEEE division: zero divisors give NaN or a signed infinity."""
    minus = F.signum(a) * F.when(b.cast("string") == "-0.0", -1.0).otherwise(1.0) < 0
    return F.when(b == 0, F.when((a == 0) | F.isnan(a), NAN).when(minus, -INF).otherwise(INF)).otherwise(a / F.when(b != 0, b))


def modulo(a: Column, b: Column) -> Column:
    return F.when((b == 0) | F.isnan(b) | F.isnan(a) | (F.abs(a) == INF), NAN).when(F.abs(b) == INF, a).otherwise(a % F.when(b != 0, b))


ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide, "%": modulo, "^": F.pow, "atan2": F.atan2}


def _ordered(test):
    """Spark holds NaN equal to itself and above all; IEEE comparisons with NaN are false."""
    return lambda a, b: ~F.isnan(a) & ~F.isnan(b) & test(a, b)


COMPARE = {
    "==": _ordered(lambda a, b: a == b), "!=": lambda a, b: F.isnan(a) | F.isnan(b) | (a != b),
    "<": _ordered(lambda a, b: a < b), "<=": _ordered(lambda a, b: a <= b), ">": _ordered(lambda a, b: a > b), ">=": _ordered(lambda a, b: a >= b),
}


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone, in a UTC session."""
    return F.unix_micros(ts.cast("timestamp"))


def at_micros(us: int) -> Column:
    return F.timestamp_micros(F.lit(us)).cast("timestamp_ntz")
