"""The golden set: hand-computed answers over a few series, and what the parser refuses."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.api import Engine, matrix_json, number, vector_json
from pulsegrid.plans.promql import Binary, Negate, duration_us, parse, time_us
from pulsegrid.schema import BadQuery, UnsupportedPromQL
from pulsegrid.sources.store import as_tables

T = 1_714_800_000
ROWS = [("smoke", {"job": "smoke"}, [(0, 1)])]
for job, status, vs in (("smoke", "ok", (0, 10, 20, 30, 40)), ("smoke", "err", (0, 5, 10, 15, 20)), ("other", "ok", (0, 20, 40, 60, 80))):
    ROWS.append(("v8", {"job": job, "status": status}, list(zip((-40, -30, -20, -10, 0), vs, strict=True))))
for job, vs in (("A", (5, 8, 9, 10)), ("B", (1, 2, 8, 10))):
    ROWS += [("hq", {"job": job, "le": le}, [(-30, 0), (0, v)]) for le, v in zip(("0.1", "0.5", "1.0", "+Inf"), vs, strict=True)]
for name, a, b in (("vv_lhs", 300, 10), ("vv_rhs", 2, 5)):
    ROWS += [(name, {"job": "api", "status": s}, [(0, v)]) for s, v in (("200", a), ("500", b))]
ROWS.append(("resets", {"job": "r"}, [(-40, 5), (-30, 9), (-20, 2), (-10, 4), (-10, 6)]))
ROWS.append(("bare", {}, [(0, 7)]))


@pytest.fixture(scope="module")
def engine(spark):
    flat = [(m, labels, (T + at) * 1_000_000, float(v)) for m, labels, points in ROWS for at, v in points]
    series, samples = as_tables(spark.createDataFrame(flat, "metric string, labels map<string,string>, ts_us long, value double"))
    return Engine(series.cache(), samples.cache())


def got(v):
    return {tuple(sorted(r["labels"].items())): round(r["value"], 6) for r in v.collect()}


def L(**labels):
    return tuple(sorted(labels.items()))


INSTANT = [
    ('v8{status="ok"}', {L(job="other", status="ok"): 80, L(job="smoke", status="ok"): 40}),
    ("sum(v8) by (job)", {L(job="smoke"): 60, L(job="other"): 80}),
    ("topk(1, v8)", {L(job="other", status="ok"): 80}),
    ('v8{job="other"} * 2', {L(job="other", status="ok"): 160}),
    ("rate(v8[1m])", {L(job="smoke", status="ok"): 1, L(job="smoke", status="err"): 0.5, L(job="other", status="ok"): 2}),
    ("sum(rate(v8[1m])) by (job)", {L(job="smoke"): 1.5, L(job="other"): 2}),
    ("histogram_quantile(0.9, rate(hq[1m]))", {L(job="A"): 1, L(job="B"): 1}),
    ("histogram_quantile(0.5, rate(hq[1m]))", {L(job="A"): 0.1, L(job="B"): 0.75}),
    ("histogram_quantile(0, rate(hq[1m]))", {L(job="A"): 0.1, L(job="B"): 0.1}),
    ("histogram_quantile(1, rate(hq[1m]))", {L(job="A"): 1, L(job="B"): 1}),
    ("vv_lhs / vv_rhs", {L(job="api", status="200"): 150, L(job="api", status="500"): 2}),
    ("topk(1, rate(v8[1m])) by (job)", {L(job="smoke", status="ok"): 1, L(job="other", status="ok"): 2}),
    ("increase(resets[1m])", {L(job="r"): 10}),
    ("delta(resets[1m])", {L(job="r"): 1}),
    ('v8{missing="", job=~"sm.*", status!~"e.*"}', {L(job="smoke", status="ok"): 40}),
    ("count(nothing)", {}),
    ("bare + bare", {(): 14}),
    ("sum without (job) (bare)", {(): 7}),
    ("-(v8{status=\"err\"})", {L(job="smoke", status="err"): -20}),
    ("topk(0, v8)", {}),
    ("1 + 2 * 3", {(): 7}),
    ("v8 offset 10s", {L(job="smoke", status="ok"): 30, L(job="smoke", status="err"): 15, L(job="other", status="ok"): 60}),
    (f"v8{{status=\"err\"}} @ {T - 20}", {L(job="smoke", status="err"): 10}),
]


@pytest.mark.parametrize("text,want", INSTANT, ids=[t for t, _ in INSTANT])
def test_instant(engine, text, want):
    assert got(engine.query(text, T)) == want


def test_range_equals_instant_at_each_point(engine):
    v = engine.query_range("sum(rate(v8[30s])) by (job)", T - 15, T, "15s")
    at = {(r["labels"]["job"], r["ts_us"]): r["value"] for r in v.collect()}
    # Windows of a grid are open at the left: 30 s hold three samples, not four.
    assert at == {("smoke", T * 10**6): 1.5, ("other", T * 10**6): 2.0, ("smoke", (T - 15) * 10**6): 1.5, ("other", (T - 15) * 10**6): 2.0}


def test_window_bounds(engine):
    assert got(engine.query("delta(v8{status=\"err\"}[40s])", T)) == {L(job="smoke", status="err"): 20}
    assert got(engine.query_range("delta(v8{status=\"err\"}[40s])", T, T, 1)) == {L(job="smoke", status="err"): 15}


def test_json(engine):
    assert vector_json(engine.query("bare", T))["data"]["result"] == [{"metric": {"__name__": "bare"}, "value": [T, "7"]}]
    m = matrix_json(engine.query_range("vv_lhs", T - 10, T, 5))["data"]["result"]
    assert [x["values"] for x in m] == [[[T, "300"]], [[T, "10"]]]


def test_metadata_and_sql(engine):
    assert [r[0] for r in engine.labels().collect()] == ["__name__", "job", "le", "status"]
    assert {"smoke", "other"} <= {r[0] for r in engine.label_values("job").collect()}
    assert engine.series("v8").count() == 3
    assert engine.series('v8{job="smoke"}', 'v8{status="ok"}').count() == 3
    out = engine.sql("SELECT metric_name, count(*) AS n FROM sk_metric GROUP BY 1 ORDER BY 1", max_rows=2)
    assert out["row_count"] == 2 and out["truncated"] and out["rows"][0] == {"metric_name": "bare", "n": 1}


@pytest.mark.parametrize("text", ["", "sum(", "v8{a}", "rate(v8)", "v8[5m", "v8 + bool 1", "1 > 2 extra", "{}", 'v8{a=~"(?=x)"}'])
def test_bad(engine, text):
    with pytest.raises(BadQuery):
        engine.query(text, T)


@pytest.mark.parametrize("text", ["abs(v8)", "quantile(0.5, v8)", "v8[5m]", "rate(v8[5m:1m])"])
def test_unsupported(engine, text):
    with pytest.raises((UnsupportedPromQL, BadQuery)):
        engine.query(text, T)


def test_too_many_points(engine):
    with pytest.raises(BadQuery):
        engine.query_range("rate(v8[1m])", 0, 11_001, 1)


def test_precedence():
    assert parse("2 ^ 3 ^ 2") == Binary("^", parse("2"), Binary("^", parse("3"), parse("2")))
    assert parse("-2 ^ 2") == Negate(parse("2 ^ 2"))
    assert duration_us("1.5h") == 5_400_000_000 and duration_us(".5m") == 30_000_000 and duration_us(" 2d") == 172_800_000_000
    for bad in ("1.5h30m", "h", "", "5x"):
        with pytest.raises(BadQuery):
            duration_us(bad)
    assert duration_us("1h30m") == 5_400_000_000 and time_us("1970-01-01T00:00:01Z") == 1_000_000


def test_ieee(spark):
    from pulsegrid.functions.expr import COMPARE, divide, modulo

    r = spark.range(1).select(*(f(F.lit(a), F.lit(b)) for f in (divide, modulo) for a, b in ((1.0, 0.0), (-1.0, 0.0), (1.0, -0.0), (0.0, 0.0)))).first()
    assert str(list(r)) == "[inf, -inf, -inf, nan, nan, nan, nan, nan]"
    assert spark.range(1).select(COMPARE["=="](F.lit(float("nan")), F.lit(float("nan")))).first()[0] is False


def test_string_literals():
    value = lambda text: parse(f"m{{a={text}}}").matchers[0].value
    assert value(r'"\r\x41\101\u00e9\U0001F600\\\""') == '\rAAé😀\\"' and value("`\\n`") == "\\n" and value(r"'\xc3\xa9'") == "é"
    for bad in (r'"\q"', r'"\xff"', r'"\ud800"'):
        with pytest.raises(BadQuery):
            value(bad)


@pytest.mark.parametrize(("text", "want"), [("0 ^ -1", "inf"), ("10 ^ 400", "inf"), ("(-8) ^ 0.5", "nan"), ("Inf % 2", "nan"), ("5 % 0", "nan"), ("0 / 0", "nan"), ("-1 / 0", "-inf"), ("7 % -4", "3.0"), ("1 < bool 2", "1.0"), ("NaN == bool NaN", "0.0")])
def test_scalars(engine, text, want):
    assert str(engine.query(text, T).first()["value"]) == want


def test_numbers():
    assert [number(v) for v in (1e300, 1e-7, -0.0, 3.0, 0.1, float("inf"), float("-inf"), float("nan"))] == ["1" + "0" * 300, "0.0000001", "-0", "3", "0.1", "+Inf", "-Inf", "NaN"]


def test_pattern_is_refused_on_the_driver(engine):
    with pytest.raises(BadQuery):
        engine.query('{a=~"("}', T)


def test_many_to_many_takes_the_last(spark):
    rows = [("m", {"a": "1", "b": "x"}, 1, 2.0), ("m", {"a": "1", "b": "y"}, 1, 3.0), ("n", {"a": "1", "c": "x"}, 1, 5.0), ("n", {"a": "1", "c": "y"}, 1, 7.0)]
    e = Engine(*as_tables(spark.createDataFrame(rows, "metric string, labels map<string,string>, ts_us long, value double")))
    assert [(r["labels"], r["value"]) for r in e.query("m * on (a) n", 1e-6).collect()] == [({"a": "1"}, 21.0)]
    got = e.query("m * on (a) group_left n", 1e-6).collect()
    assert sorted((r["labels"]["b"], r["value"]) for r in got) == [("x", 14.0), ("y", 21.0)]


def test_range_functions_by_plain_loop(spark):
    """Panes against a loop over samples, with ties, resets, gaps, odd steps and ranges."""
    rng = random.Random(11)
    points = {s: sorted((rng.randrange(0, 400), float(rng.randrange(0, 6))) for _ in range(60)) for s in "abc"}
    rows = [("m", {"s": s}, t * 1_000_000, v) for s, ps in points.items() for t, v in ps]
    e = Engine(*as_tables(spark.createDataFrame(rows, "metric string, labels map<string,string>, ts_us long, value double")))
    for function, span, step in (("increase", 60, 20), ("rate", 35, 14), ("irate", 50, 50), ("delta", 13, 29), ("increase", 7, 60)):
        want = {}
        for s, ps in points.items():
            for at in range(0, 401, step):
                w = [p for p in ps if at - span < p[0] <= at]
                ups = [b[1] - a[1] if b[1] >= a[1] else b[1] for a, b in zip(w, w[1:])]  # noqa: B905
                took = w[-1][0] - w[0][0] if w else 0
                if len(w) < 2 or (function in ("increase", "rate") and not took) or (function == "irate" and w[-1][0] == w[-2][0]):
                    continue
                want[s, at] = {"increase": lambda: sum(ups), "rate": lambda: sum(ups) / took, "irate": lambda: ups[-1] / (w[-1][0] - w[-2][0]), "delta": lambda: w[-1][1] - w[0][1]}[function]()
        got = {(r["labels"]["s"], r["ts_us"] // 1_000_000): r["value"] for r in e.query_range(f"{function}(m[{span}s])", 0, 400, step).collect()}
        assert got == pytest.approx(want), (function, span, step)
