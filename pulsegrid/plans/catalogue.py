"""Queries over the event tables, one for each operator, with independent SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from tempfile import mkdtemp
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Engine
from ..sources import tables
from ..functions.expr import micros
from ..sources.ingest import parse_json, rejected, validated
from ..sources.store import MetricStore, new_series, register_views

DAY = 86_400_000_000
T0 = 1_705_708_800_000_000  # 2024-01-20 00:00 UTC
#: The grid of range queries spans the whole table, which covers January.
START, STEP, POINTS = T0 - 19 * DAY, DAY // 2, 61
END = START + (POINTS - 1) * STEP
LOOKBACK = 3 * DAY
WINDOW = 5 * DAY

KEY = "event_type, user_id"
GAUGE = "SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) AS us, value FROM events"
COUNTER = "SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) AS us, CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) % 7 AS DOUBLE) AS value FROM events"
BUCKETS = (
    "SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, le, epoch_us(ts) AS us, CAST(sum(CASE WHEN value <= CAST(le AS DOUBLE) THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, user_id, le ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS value "
    "FROM events, (VALUES ('10'), ('50'), ('100'), ('250'), ('+Inf')) v(le)"
)
#: name -> (query, SQL)
_BOTH: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}
#: name -> (text, tables, labels, instant, aligned) of those that are PromQL
PROMQL: dict[str, tuple[str, Callable, list[str], bool, bool]] = {}


def latest(base: str, key: str = KEY, t: int = T0) -> str:
    return f"SELECT {key}, us, value FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY us DESC, value DESC) AS rn FROM ({base}) WHERE us BETWEEN {t - LOOKBACK} AND {t}) WHERE rn = 1"


def windowed(base: str, function: str, key: str = KEY, instant: bool = True, start: int | None = None) -> str:
    """A range function per series and evaluation time, by a range join and lag."""
    first, n = (T0 if start is None else start, 1) if instant else (START, POINTS)
    low = ">=" if instant else ">"
    up = "CASE WHEN value >= pv THEN value - pv ELSE value END"
    value, having = {
        "increase": (f"sum(CASE WHEN pv IS NULL THEN 0 ELSE {up} END)", "count(*) >= 2 AND max(us) > min(us)"),
        "rate": (f"sum(CASE WHEN pv IS NULL THEN 0 ELSE {up} END) * 1e6 / (max(us) - min(us))", "count(*) >= 2 AND max(us) > min(us)"),
        "irate": (f"max(CASE WHEN rd = 1 THEN ({up}) * 1e6 / (us - pu) END)", "count(*) >= 2 AND max(CASE WHEN rd = 1 THEN us - pu END) > 0"),
        "delta": ("arg_max(value, us) - arg_min(value, us)", "count(*) >= 2"),
    }[function]
    return (
        f"SELECT e AS us, {key}, {value} AS value FROM (SELECT e, {key}, us, value, lag(value) OVER w AS pv, lag(us) OVER w AS pu, row_number() OVER (PARTITION BY e, {key} ORDER BY us DESC, value DESC) AS rd "
        f"FROM ({base}) JOIN (SELECT {first} + i * {STEP} AS e FROM range({n}) r(i)) ON us {low} e - {WINDOW} AND us <= e WINDOW w AS (PARTITION BY e, {key} ORDER BY us, value)) GROUP BY e, {key} HAVING {having}"
    )


def _query(text: str, source: Callable, labels: list[str], instant: bool, aligned: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: answer(Engine(*source(spark, sf_dir), lookback=LOOKBACK / 1e6), text, labels, instant, aligned)


def answer(engine: Engine, text: str, labels: list[str], instant: bool, aligned: bool) -> DataFrame:
    """The vector of a query with its labels as columns."""
    v = engine.query(text, T0 / 1e6) if instant else engine.query_range(text, START / 1e6, END / 1e6, STEP / 1e6, aligned)
    return v.select("metric_name", *(F.col("labels")[k].alias(k) for k in labels), "ts_us", F.round("value", 6).alias("value"))


def add(name: str, text: str, source: Callable, labels: list[str], sql: str, metric: str = "", instant: bool = True, aligned: bool = False) -> None:
    """sql gives the labels, us and value."""
    columns = "".join(f"{k}, " for k in labels)
    PROMQL[name] = (text, source, labels, instant, aligned)
    _BOTH[name] = (_query(text, source, labels, instant, aligned), f"SELECT '{metric}' AS metric_name, {columns}CAST(us AS BIGINT) AS ts_us, round(CAST(value AS DOUBLE), 6) AS value FROM ({sql})")


BOTH = ["event_type", "user_id"]
G, C, H = tables.gauge, tables.counter, tables.histogram
raw = f"SELECT {KEY}, us, value FROM ({GAUGE}) WHERE us BETWEEN {START} AND {END}"

add("f11_instant_selector", "event_value", G, BOTH, latest(GAUGE), "event_value")
add("f2_label_equal", 'event_value{event_type="click"}', G, BOTH, f"SELECT * FROM ({latest(GAUGE)}) WHERE event_type = 'click'", "event_value")
add("f3_label_not_equal", 'event_value{event_type!="click"}', G, BOTH, f"SELECT * FROM ({latest(GAUGE)}) WHERE event_type <> 'click'", "event_value")
add("f4_label_pattern", 'event_value{user_id=~"1.*",event_type!~"c.*"}', G, BOTH, f"SELECT * FROM ({latest(GAUGE)}) WHERE user_id LIKE '1%' AND event_type NOT LIKE 'c%'", "event_value")
add("f5_name_pattern", '{__name__=~"event_v.+"}', G, BOTH, latest(GAUGE), "event_value")
add("f12_range_selector", "event_value", G, BOTH, raw, "event_value", instant=False)
grid = f"SELECT {START} + i * {STEP} AS e FROM range({POINTS}) r(i)"
aligned = f"SELECT {KEY}, e AS us, value FROM (SELECT *, row_number() OVER (PARTITION BY e, {KEY} ORDER BY us DESC, value DESC) AS rn FROM ({GAUGE}) JOIN ({grid}) ON us BETWEEN e - {LOOKBACK} AND e) WHERE rn = 1"
add("f12_range_selector_aligned", "event_value", G, BOTH, aligned, "event_value", instant=False, aligned=True)
add("q20_offset", "rate(event_total[5d] offset 2d)", C, BOTH, f"SELECT {KEY}, {T0} AS us, value FROM ({windowed(COUNTER, 'rate', start=T0 - 2 * DAY)})", "event_total")

t1 = T0 - 3 * DAY
add("q20_at", f"event_value @ {t1 // 1_000_000}", G, BOTH, latest(GAUGE, t=t1), "event_value")
add("q20_at_range", f"increase(event_total[5d] @ {t1 // 1_000_000})", C, BOTH, f"SELECT {KEY}, e AS us, value FROM ({windowed(COUNTER, 'increase', start=t1).replace('us >= e', 'us > e')}), ({grid})", "event_total", instant=False)
add("f2_string_escapes", r'event_value{event_type="\x63l\u0069ck",user_id!="\r\n"}', G, BOTH, f"SELECT * FROM ({latest(GAUGE)}) WHERE event_type = 'click'", "event_value")

for n, function in enumerate(("increase", "rate", "irate", "delta"), 1):
    for instant in (True, False):
        add(f"r{n}_{function}_{'instant' if instant else 'range'}", f"{function}(event_total[5d])", C, BOTH, windowed(COUNTER, function, instant=instant), "event_total", instant)

at = f"{T0} AS us"
for op in ("sum", "avg", "min", "max", "count"):
    sql = "count(*)" if op == "count" else f"{op}(value)"
    add(f"a1_{op}_instant_by", f"{op} by (event_type) (event_value)", G, ["event_type"], f"SELECT event_type, {at}, {sql} AS value FROM ({latest(GAUGE)}) GROUP BY event_type")
for op, sql in {"group": "1", "stddev": "stddev_pop(value)", "stdvar": "var_pop(value)"}.items():
    add(f"a15_{op}", f"{op} by (event_type) (event_value)", G, ["event_type"], f"SELECT event_type, {at}, {sql} AS value FROM ({latest(GAUGE)}) GROUP BY event_type")
add("a1_sum_instant_all", "sum(event_value)", G, [], f"SELECT {at}, sum(value) AS value FROM ({latest(GAUGE)}) HAVING count(*) > 0")
add("a2_sum_instant_without", "sum without (user_id) (event_value)", G, ["event_type"], f"SELECT event_type, {at}, sum(value) AS value FROM ({latest(GAUGE)}) GROUP BY event_type")
add("a3_sum_range_by", "sum by (event_type) (event_value)", G, ["event_type"], f"SELECT event_type, us, sum(value) AS value FROM ({raw}) GROUP BY event_type, us", instant=False)
add("a4_max_range_without", "max without (event_type) (event_value)", G, ["user_id"], f"SELECT user_id, us, max(value) AS value FROM ({raw}) GROUP BY user_id, us", instant=False)
for kind, instant in (("instant", True), ("range", False)):
    rate = windowed(COUNTER, "rate", instant=instant)
    add(f"a{5 if instant else 7}_sum_rate_{kind}_by", "sum(rate(event_total[5d])) by (event_type)", C, ["event_type"], f"SELECT event_type, us, sum(value) AS value FROM ({rate}) GROUP BY event_type, us", instant=instant)
    add(f"a{6 if instant else 8}_avg_rate_{kind}_without", "avg without (event_type) (rate(event_total[5d]))", C, ["user_id"], f"SELECT user_id, us, avg(value) AS value FROM ({rate}) GROUP BY user_id, us", instant=instant)
    add(f"a{9 if instant else 10}_nested_{kind}", "max(sum by (event_type) (increase(event_total[5d])))", C, [], f"SELECT us, max(value) AS value FROM (SELECT event_type, us, sum(value) AS value FROM ({windowed(COUNTER, 'increase', instant=instant)}) GROUP BY event_type, us) GROUP BY us", instant=instant)


def ranked(sql: str, n: int, by: str, top: bool = True) -> str:
    return f"SELECT {KEY}, us, value FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY value {'DESC' if top else 'ASC'}, event_type, user_id) AS rn FROM ({sql})) WHERE rn <= {n}"


now = f"SELECT {KEY}, {at}, value FROM ({latest(GAUGE)})"
add("k1_topk_instant_by", "topk by (event_type) (3, event_value)", G, BOTH, ranked(now, 3, "event_type"), "event_value")
add("k1_bottomk_instant", "bottomk(5, event_value)", G, BOTH, ranked(now, 5, "us", False), "event_value")
add("k2_topk_instant_without", "topk without (user_id) (2, event_value)", G, BOTH, ranked(now, 2, "event_type"), "event_value")
add("k5_topk_range_by", "topk by (event_type) (1, event_value)", G, BOTH, ranked(raw, 1, "us, event_type"), "event_value", instant=False)
add("k6_topk_range_without", "topk without (event_type) (1, event_value)", G, BOTH, ranked(raw, 1, "us, user_id"), "event_value", instant=False)
for kind, instant in (("instant", True), ("range", False)):
    up = windowed(COUNTER, "increase", instant=instant)
    add(f"k{3 if instant else 7}_topk_increase_{kind}_by", "topk(2, increase(event_total[5d])) by (event_type)", C, BOTH, ranked(up, 2, "us, event_type"), "event_total", instant)
    add(f"k{4 if instant else 8}_bottomk_increase_{kind}_without", "bottomk without (user_id) (2, increase(event_total[5d]))", C, BOTH, ranked(up, 2, "us, event_type", False), "event_total", instant)
add("k9_topk_generic_instant", "topk(2, sum by (event_type) (event_value))", G, ["event_type"], f"SELECT event_type, {at}, value FROM (SELECT event_type, sum(value) AS value FROM ({latest(GAUGE)}) GROUP BY event_type) ORDER BY value DESC LIMIT 2")
add("k10_topk_generic_range", "topk(1, sum by (event_type) (increase(event_total[5d])))", C, ["event_type"], f"SELECT event_type, us, value FROM (SELECT *, row_number() OVER (PARTITION BY us ORDER BY value DESC, event_type) AS rn FROM (SELECT event_type, us, sum(value) AS value FROM ({windowed(COUNTER, 'increase', instant=False)}) GROUP BY event_type, us)) WHERE rn = 1", instant=False)

held = f"SELECT {KEY}, {at}, value FROM ({latest(COUNTER)})"
counts = f"SELECT {KEY}, us, value FROM ({COUNTER}) WHERE us BETWEEN {START} AND {END}"
for op, sql in {"plus": ("+", "value + 3"), "minus": ("-", "value - 3"), "times": ("*", "value * 3"), "over": ("/", "value / 3"), "modulo": ("%", "value % 3"), "power": ("^", "power(value, 3)")}.items():
    add(f"b1_{op}_scalar", f"event_total {sql[0]} 3", C, BOTH, f"SELECT {KEY}, us, {sql[1]} AS value FROM ({held})")
add("b1_divide_by_zero", "event_total / 0", C, BOTH, f"SELECT {KEY}, us, CASE WHEN value = 0 THEN CAST('nan' AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END AS value FROM ({held})")
add("b2_filter_instant", "event_total > 3", C, BOTH, f"SELECT * FROM ({held}) WHERE value > 3", "event_total")
add("b3_compare_bool", "event_total >= bool 4", C, BOTH, f"SELECT {KEY}, us, CASE WHEN value >= 4 THEN 1 ELSE 0 END AS value FROM ({held})")
add("b4_scalar_left_filter", "3 < event_total", C, BOTH, f"SELECT * FROM ({held}) WHERE value > 3", "event_total")
add("b5_scalar_range", "event_total * 2", C, BOTH, f"SELECT {KEY}, us, value * 2 AS value FROM ({counts})", instant=False)
add("b6_scalar_generic", "rate(event_total[5d]) * 1000", C, BOTH, f"SELECT {KEY}, us, value * 1000 AS value FROM ({windowed(COUNTER, 'rate')})")
V = tables.both
#: Two metrics; on the right only some series and times, so that what has no match shows.
some = f"SELECT * FROM ({COUNTER}) WHERE user_id NOT LIKE '1%' AND value <> 2"
matched = f"FROM ({now}) g JOIN ({held}) h ON g.event_type = h.event_type AND g.user_id = h.user_id"
add("b7_vector_vector_instant", 'event_value - event_total{user_id!~"1.*"}', V, BOTH, f"SELECT g.event_type, g.user_id, g.us, g.value - h.value AS value {matched} WHERE g.user_id NOT LIKE '1%'")
add("b7_filter_vector_vector", "event_value >= event_total", V, BOTH, f"SELECT g.event_type, g.user_id, g.us, g.value {matched} WHERE g.value >= h.value", "event_value")
add("b7_bool_vector_vector", "event_value < bool event_total", V, BOTH, f"SELECT g.event_type, g.user_id, g.us, CASE WHEN g.value < h.value THEN 1 ELSE 0 END AS value {matched}")
meeting = f"FROM (SELECT event_type, user_id, us, max(value) AS value FROM ({raw}) GROUP BY ALL) g JOIN (SELECT event_type, user_id, us, max(value) AS value FROM ({counts}) GROUP BY ALL) h USING (event_type, user_id, us)"
add("b8_vector_vector_range", 'event_value + event_total{event_type!="click"}', V, BOTH, f"SELECT event_type, user_id, us, g.value + h.value AS value {meeting} WHERE event_type <> 'click'", instant=False)
add("b8_filter_range", "event_value > event_total", V, BOTH, f"SELECT event_type, user_id, us, g.value AS value {meeting} WHERE g.value > h.value", "event_value", instant=False)
both = f"SELECT a.event_type, a.user_id, a.us, a.value / b.value AS value FROM ({windowed(COUNTER, 'increase')}) a JOIN ({windowed(COUNTER, 'rate')}) b ON a.event_type = b.event_type AND a.user_id = b.user_id WHERE b.value <> 0"
add("b9_vector_vector_generic", "increase(event_total[5d]) / (rate(event_total[5d]) > 0)", C, BOTH, both)
sums = f"SELECT event_type, sum(value) AS s FROM ({latest(COUNTER)}) GROUP BY event_type"
add("j14_on_group_left", "event_total - on (event_type) group_left sum by (event_type) (event_total)", C, BOTH, f"SELECT h.event_type, h.user_id, us, value - s AS value FROM ({held}) h JOIN ({sums}) s ON h.event_type = s.event_type")
add("j14_on", "sum by (event_type) (event_total) / on (event_type) count by (event_type) (event_total)", C, ["event_type"], f"SELECT event_type, {at}, avg(value) AS value FROM ({latest(COUNTER)}) GROUP BY event_type")
least = f"SELECT event_type, min(value) AS s FROM ({latest(GAUGE)}) GROUP BY event_type"
add("j14_ignoring", "event_total * ignoring (user_id) group_left min without (user_id) (event_value)", V, BOTH, f"SELECT h.event_type, h.user_id, us, value * s AS value FROM ({held}) h JOIN ({least}) s ON h.event_type = s.event_type")
add("j14_group_right", "sum by (event_type) (event_total) / on (event_type) group_right event_value", V, BOTH, f"SELECT g.event_type, g.user_id, us, CASE WHEN value = 0 THEN CAST('inf' AS DOUBLE) ELSE s / value END AS value FROM ({now}) g JOIN ({sums}) s ON g.event_type = s.event_type")
add("j14_include", 'sum by (user_id) (event_value) + on (user_id) group_left (event_type) event_total{event_type="view"}', V, BOTH, f"SELECT h.event_type, h.user_id, h.us, t + h.value AS value FROM ({held}) h JOIN (SELECT user_id, sum(value) AS t FROM ({latest(GAUGE)}) GROUP BY user_id) g ON g.user_id = h.user_id WHERE h.event_type = 'view'")
add("b10_scalar_scalar", "2 * (3 + 4) ^ 2", C, [], f"SELECT {at}, 98 AS value")
for i, (text, value) in enumerate((("0 ^ -1", "CAST('inf' AS DOUBLE)"), ("10 ^ 400", "CAST('inf' AS DOUBLE)"), ("(-8) ^ 0.5", "CAST('nan' AS DOUBLE)"), ("Inf % 2", "CAST('nan' AS DOUBLE)"), ("-7 % 3", "-1"), ("-1 / 0", "CAST('-inf' AS DOUBLE)"), ("1 atan2 2", "atan2(1, 2)"), ("-2 ^ 2", "-4"), ("2 >= bool 2", "1"))):
    add(f"b10_scalars_{i}", text, C, [], f"SELECT {at}, {value} AS value")
add("b11_atan2", "event_value atan2 event_total", V, BOTH, f"SELECT g.event_type, g.user_id, g.us, atan2(g.value, h.value) AS value {matched}")
add("b11_and", "event_total and event_total > 3", C, BOTH, f"SELECT * FROM ({held}) WHERE value > 3", "event_total")
add("b11_or", "event_total < 2 or event_total > 4", C, BOTH, f"SELECT * FROM ({held}) WHERE value < 2 OR value > 4", "event_total")
add("b11_unless", "event_total unless event_total > 3", C, BOTH, f"SELECT * FROM ({held}) WHERE value <= 3", "event_total")
add("b12_minus", "-event_total", C, BOTH, f"SELECT {KEY}, us, 0 - value AS value FROM ({held})")
add("b13_parentheses", "(2) * (sum by (event_type) ((event_total)))", C, ["event_type"], f"SELECT event_type, {at}, sum(value) * 2 AS value FROM ({latest(COUNTER)}) GROUP BY event_type")


def quantile(inner: str, by: str, q: float) -> str:
    """inner: by, us, le and value of buckets."""
    le = "CAST(le AS DOUBLE)"
    lag = lambda c: f"coalesce(lag({c}) OVER w, 0)"
    if q >= 1:
        return f"SELECT {by}, us, max(CASE WHEN le <> '+Inf' THEN {le} END) AS value FROM ({inner}) GROUP BY {by}, us HAVING max(value) > 0 AND count(*) >= 2"
    return (
        f"SELECT {by}, us, value FROM (SELECT {by}, us, row_number() OVER (PARTITION BY {by}, us ORDER BY b) AS rn, CASE WHEN isinf(b) THEN pb WHEN c - pc <= 0 THEN b ELSE pb + ({q} * total - pc) / (c - pc) * (b - pb) END AS value FROM "
        f"(SELECT {by}, us, {le} AS b, value AS c, {lag(le)} AS pb, {lag('value')} AS pc, last_value(value) OVER (PARTITION BY {by}, us ORDER BY {le} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total "
        f"FROM ({inner}) WINDOW w AS (PARTITION BY {by}, us ORDER BY {le})) WHERE total > 0 AND c >= {q} * total) WHERE rn = 1"
    )


bucket_key = f"{KEY}, le"
for kind, instant in (("instant", True), ("range", False)):
    inner = windowed(BUCKETS, "increase", bucket_key, instant)
    add(f"h{1 if instant else 2}_quantile_{kind}", "histogram_quantile(0.5, increase(event_value_bucket[5d]))", H, BOTH, quantile(inner, KEY, 0.5), instant=instant)
    summed = f"SELECT event_type, le, us, sum(value) AS value FROM ({inner}) GROUP BY event_type, le, us"
    add(f"h3_quantile_of_sum_{kind}", "histogram_quantile(0.9, sum by (event_type, le) (increase(event_value_bucket[5d])))", H, ["event_type"], quantile(summed, "event_type", 0.9), instant=instant)
odd = f"SELECT event_type, le, us, sum(value) AS value FROM ({windowed(BUCKETS, 'increase', bucket_key)}) WHERE le <> '250' GROUP BY event_type, le, us"
add("h4_odd_bounds", "histogram_quantile(0.5, sum by (event_type, le) (increase(event_value_bucket[5d])))", tables.odd_buckets, ["event_type"], quantile(odd, "event_type", 0.5))
add("h3_quantile_one", "histogram_quantile(1, sum by (event_type, le) (increase(event_value_bucket[5d])))", H, ["event_type"], quantile(f"SELECT event_type, le, us, sum(value) AS value FROM ({windowed(BUCKETS, 'increase', bucket_key)}) GROUP BY event_type, le, us", "event_type", 1))


def m1_label_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(*H(spark, sf_dir)).labels()


def m2_label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(*G(spark, sf_dir)).label_values("event_type")


def m3_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = Engine(*G(spark, sf_dir)).series('event_value{event_type="click"}', 'event_value{user_id=~"1.*"}')
    return got.select("metric_name", F.col("labels")["event_type"].alias("event_type"), F.col("labels")["user_id"].alias("user_id"))


def m4_metric_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, *G(spark, sf_dir))
    return spark.sql("SELECT metric_name, labels['event_type'] AS event_type, count(*) AS n, max(unix_micros(CAST(timestamp AS TIMESTAMP))) AS last_us FROM sk_metric GROUP BY 1, 2")


def m5_rate_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, *C(spark, sf_dir))
    return spark.sql("SELECT labels['event_type'] AS event_type, labels['user_id'] AS user_id, unix_micros(CAST(timestamp AS TIMESTAMP)) AS ts_us, round(value_per_sec, 9) AS value_per_sec FROM sk_rate_of")


def m8_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, *G(spark, sf_dir))
    return spark.sql("SELECT CAST(date_trunc('DAY', timestamp) AS DATE) AS day, count(*) AS n, count(DISTINCT series_id) AS series FROM samples GROUP BY ROLLUP (1) HAVING count(*) > 1")


def i1_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as wire samples, an hour of which a fixed clock accepts; every tenth has a reserved label, every eleventh a bad name."""
    e = tables.events(spark, sf_dir)
    label = F.when(F.col("event_id") % 10 == 0, "__user").otherwise("user")
    name = F.when(F.col("event_id") % 11 == 0, "event-value").otherwise("event_value")
    wire = e.select(F.col("event_id").alias("index"), name.alias("metric"), F.create_map(label, "user_id").alias("labels"), F.expr("ts_us div 1000").alias("ts"), "value")
    return rejected(validated(wire, T0 // 1000)).groupBy("reason").agg(F.count("*").alias("n"))


def i5_json_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each user and kind of event, cut short for every fifth user; the clock is each sample's own."""
    e = tables.events(spark, sf_dir)
    sample = F.struct(F.lit("event_value").alias("metric"), F.create_map(F.lit("user"), "user_id").alias("labels"), F.expr("ts_us div 1000").alias("ts"), "value")
    bodies = e.groupBy("event_type", "user_id").agg(F.to_json(F.struct(F.collect_list(sample).alias("samples"))).alias("body"))
    bodies = bodies.select(F.when(F.col("user_id").cast("long") % 5 == 0, F.expr("substring(body, 1, length(body) - 3)")).otherwise(F.col("body")).alias("body"))
    rows = validated(parse_json(bodies), F.col("ts"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("reason").isNull(), F.col("series_id"))).alias("series"), F.round(F.sum("value"), 3).alias("total"))


def j12_new_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of events that a store which holds the clicks doesn't know."""
    series, samples = G(spark, sf_dir)
    accepted = samples.join(series, "series_id").withColumnRenamed("metric_name", "metric")
    known = series.where("labels['event_type'] = 'click'")
    return new_series(accepted, known).groupBy("metric_name", F.col("labels")["event_type"].alias("event_type")).agg(F.count("*").alias("n"))


def s11_store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams write their batch 0, one of them twice, a third adds more; a day is compacted; what the store holds by day."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"file://{mkdtemp()}"
    series, samples = G(spark, sf_dir)
    accepted = samples.join(series, "series_id").select("series_id", F.col("metric_name").alias("metric"), "labels", micros(F.col("timestamp")).alias("ts_us"), "value")
    third = F.pmod(F.col("ts_us"), F.lit(3))
    store = MetricStore(spark, f"{folder.rstrip('/')}/store-{uuid4().hex}")
    store.append(accepted.where(third == 0), 0, "a")
    store.append(accepted.where(third == 1), 0, "b")
    store.append(accepted.where(third == 0), 0, "a")
    store.append(accepted.where(third == 2), 1, "a")
    store.append(accepted.where("false"), 2, "a")
    store.compact(date(2024, 1, 20))
    rows = store.samples().join(store.series(), "series_id")
    return rows.groupBy(F.col("timestamp_day").alias("day"), "metric_name").agg(F.count("*").alias("n"), F.countDistinct("series_id").alias("series"), F.round(F.sum("value"), 3).alias("total"))


_MS = T0 // 1000
for f, sql in (
    (m1_label_names, "SELECT unnest(['__name__', 'event_type', 'le', 'user_id']) AS label"),
    (m2_label_values, "SELECT DISTINCT event_type AS value FROM events"),
    (m3_series, "SELECT DISTINCT 'event_value' AS metric_name, event_type, CAST(user_id AS VARCHAR) AS user_id FROM events WHERE event_type = 'click' OR CAST(user_id AS VARCHAR) LIKE '1%'"),
    (m4_metric_view, "SELECT 'event_value' AS metric_name, event_type, count(*) AS n, max(epoch_us(ts)) AS last_us FROM events GROUP BY event_type"),
    (m5_rate_view, f"SELECT {KEY}, us AS ts_us, round((value - lag(value) OVER w) / nullif((us - lag(us) OVER w) / 1e6, 0), 9) AS value_per_sec FROM ({COUNTER}) WINDOW w AS (PARTITION BY {KEY} ORDER BY us, value)"),
    (m8_sql, "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT (event_type, user_id)) AS series FROM events GROUP BY ROLLUP (1) HAVING count(*) > 1"),
    (i1_validate, f"""SELECT CASE WHEN event_id % 11 = 0 THEN 'metric name ''event-value'' contains invalid characters (must match [a-zA-Z_][a-zA-Z0-9_]*)' WHEN event_id % 10 = 0 THEN 'label name ''__user'' is reserved (starts with ''__'')'
        WHEN epoch_us(ts) // 1000 < {_MS} - 3600000 THEN 'timestamp ' || epoch_us(ts) // 1000 || ' ms is too old: now={_MS} ms, grace=3600000 ms' WHEN epoch_us(ts) // 1000 > {_MS} + 300000 THEN 'timestamp ' || epoch_us(ts) // 1000 || ' ms is in the future: now={_MS} ms, grace=300000 ms' END AS reason, count(*) AS n
        FROM events GROUP BY 1 HAVING reason IS NOT NULL"""),
    (i5_json_requests, """SELECT NULL AS reason, count(*) AS n, count(DISTINCT user_id) AS series, round(sum(value), 3) AS total FROM events WHERE user_id % 5 <> 0
        UNION ALL SELECT 'request is not valid JSON', count(DISTINCT (event_type, user_id)), 0, NULL FROM events WHERE user_id % 5 = 0 HAVING count(*) > 0"""),
    (j12_new_series, "SELECT 'event_value' AS metric_name, event_type, count(DISTINCT user_id) AS n FROM events WHERE event_type <> 'click' GROUP BY event_type"),
    (s11_store_round_trip, "SELECT CAST(ts AS DATE) AS day, 'event_value' AS metric_name, count(*) AS n, count(DISTINCT (event_type, user_id)) AS series, round(sum(value), 3) AS total FROM events GROUP BY 1"),
):
    _BOTH[f.__name__] = (f, sql)

QUERIES = {name: f for name, (f, _) in _BOTH.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _BOTH.items()}
