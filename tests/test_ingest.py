from __future__ import annotations

import json
import struct

import pytest
from pyspark.sql import functions as F

from pulsegrid.api import Engine, ingest_json
from pulsegrid.schema import WIRE
from pulsegrid.sources import ingest, remote_write
from pulsegrid.sources.store import CatalogStore, MetricStore
from pulsegrid.streaming.ingest import Metrics, start_ingest, stop_ingest, stream_id

NOW = 1_714_800_000_000


def wire(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "index int, metric string, labels map<string,string>, ts long, value double")


def test_validation_order_and_bounds(spark):
    ok = [("a", {"k": "v"}, NOW - 3_600_000, 1.0), ("a", {}, NOW + 300_000, 2.0)]
    bad = [("", {}, NOW, 1.0), ("foo:bar", {}, NOW, 1.0), ("1foo", {"__x": "y"}, NOW, 1.0), ("a", {"__x": "y"}, NOW, 1.0), ("a", {"b-c": "y"}, NOW, 1.0), ("a", {}, NOW, float("nan")), ("a", {}, NOW - 3_600_001, 1.0), ("a", {}, NOW + 300_001, 1.0), ("a", {}, None, 1.0), (None, {}, NOW, 1.0)]
    rows = ingest.validated(wire(spark, *ok, *bad), NOW)
    assert ingest.accepted(rows).count() == 2
    got = {r["index"]: r["reason"] for r in ingest.rejected(rows).collect()}
    assert sorted(got) == list(range(2, 12))
    assert "empty" in got[2] and "metric" in got[4] and "reserved" in got[5] and "label" in got[6] and "finite" in got[7] and "old" in got[8] and "future" in got[9]


def test_series_id_ignores_the_order_of_labels(spark):
    a = spark.sql("SELECT map('x', '1', 'y', '2') AS l UNION ALL SELECT map('y', '2', 'x', '1')")
    from pulsegrid.functions.expr import series_id

    ids = {r[0] for r in a.select(series_id(F.lit("m"), F.col("l"))).collect()}
    assert len(ids) == 1 and min(ids) >= 0


def test_store_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    day = NOW - NOW % 86_400_000
    samples = [{"metric": "m", "labels": {"a": str(i % 2)}, "ts": day + (i - 2) * 1000, "value": i} for i in range(4)] + [{"metric": "bad name", "ts": day, "value": 1}]
    (tmp_path / "in" / "r.json").write_text(json.dumps({"samples": samples}))
    store, seen = MetricStore(spark, str(tmp_path / "store")), []
    stream = ingest.read_json(spark, str(tmp_path / "in"), streaming=True)
    start_ingest(stream, store, str(tmp_path / "check"), now_ms=day, every=None, on_rejects=lambda df, n: seen.extend(df.collect())).awaitTermination()
    assert [r["index"] for r in seen] == [4]
    assert store.series().count() == 2 and store.samples().count() == 4
    assert store.samples().select("timestamp_day").distinct().count() == 2
    # The same batch of the same stream again replaces itself; a direct append adds.
    rows = ingest.accepted(ingest.validated(ingest.read_json(spark, str(tmp_path / "in")), day))
    store.append(rows, 0, stream_id(spark, str(tmp_path / "check")))
    assert store.samples().count() == 4 and store.series().count() == 2
    store.append(rows)
    assert store.samples().count() == 8 and store.series().count() == 2
    v = Engine.of_store(store).query("sum by (a) (m)", (day + 1000) / 1000)
    assert {r["labels"]["a"]: r["value"] for r in v.collect()} == {"0": 2.0, "1": 3.0}
    plan = Engine.of_store(store).query("m", (day + 1000) / 1000)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(timestamp_day" in plan


def test_two_streams_and_a_restarted_one(spark, tmp_path):
    """Batch 0 of another stream, or of one that starts anew, replaces nothing; a batch that runs again does."""
    day = NOW - NOW % 86_400_000 + 3_600_000
    store, metrics = MetricStore(spark, str(tmp_path / "store")), Metrics()

    def run(folder, check, n, first=0):
        (tmp_path / folder).mkdir(exist_ok=True)
        samples = [{"metric": "m", "labels": {"s": folder}, "ts": day + first + i, "value": i} for i in range(n)]
        (tmp_path / folder / f"{first}.json").write_text(json.dumps({"samples": samples}))
        q = start_ingest(ingest.read_json(spark, str(tmp_path / folder), streaming=True, maxFilesPerTrigger=1), store, str(tmp_path / check), now_ms=day, every=None, metrics=metrics)
        q.awaitTermination()
        stop_ingest(q)

    run("a", "check_a", 5)
    run("b", "check_b", 3)
    assert store.samples().count() == 8
    run("a", "check_a", 2, first=100)  # restarted: batch 1
    assert store.samples().count() == 10
    run("a", "check_new", 0, first=200)  # a new checkpoint reads all files again, as another stream
    assert store.samples().count() == 17
    assert metrics.values['pulsegrid_ingest_accepted_total{endpoint="stream"}'] == 17 and 'pulsegrid_flush_total{result="ok"}' in metrics.text()
    with pytest.raises(ValueError):
        store.append(ingest.accepted(ingest.validated(wire(spark, ("a", {}, day, 1.0)), day)), 0)
    before = sorted(map(str, store.samples().collect()))
    day_of = store.samples().first()["timestamp_day"]
    store.append(ingest.accepted(ingest.validated(wire(spark, ("a", {}, day, 1.0)), day)))
    store.append(ingest.accepted(ingest.validated(wire(spark, ("a", {}, day, 1.0)), day)), 0, "other")
    store.append(ingest.accepted(ingest.validated(wire(spark, ("a", {}, day, 1.0)), day)), 1, "other")
    store.compact(day_of)
    folders = [f.name for f in (tmp_path / "store" / "samples" / f"timestamp_day={day_of}").iterdir() if f.name.startswith("batch=")]
    assert sum(f.startswith("batch=compacted") for f in folders) == 1 and "batch=other-b1" in folders and "batch=other-b0" not in folders
    after = sorted(map(str, store.samples().collect()))
    assert len(after) == len(before) + 3 and set(before) <= set(after)
    store.compact(day_of)
    assert sorted(map(str, store.samples().collect())) == after


def test_catalog_store(spark):
    store = CatalogStore(spark, "metrics_test")
    rows = ingest.accepted(ingest.validated(wire(spark, ("a", {"k": "v"}, NOW, 1.0), ("a", {}, NOW, 2.0)), NOW))
    for batch in (0, 0, 1):
        store.append(rows, batch, "s")
    assert store.samples().count() == 4 and store.series().count() == 2
    assert Engine.of_store(store).query("sum(a)", NOW / 1000).first()["value"] == 3.0
    spark.sql("DROP DATABASE metrics_test CASCADE")


def test_corrupt_requests_are_reported(spark, tmp_path):
    whole = json.dumps({"samples": [{"metric": "m", "labels": {}, "ts": NOW, "value": 1}]})
    bodies = {"a": whole, "b": whole[:-4], "c": "{}", "d": '{"samples": []}', "e": '{"samples": [{"metric": "m", "ts": "x", "value": 1}]}', "f": '{"samples": [null]}'}
    for name, body in bodies.items():
        (tmp_path / f"{name}.json").write_text(body)
    for rows in (ingest.read_json(spark, str(tmp_path)), ingest.parse_json(spark.createDataFrame([(b,) for b in bodies.values()], "body string"))):
        rows = ingest.validated(rows, NOW)
        assert ingest.accepted(rows).count() == 1
        assert sorted(r["reason"] for r in ingest.rejected(rows).collect()) == ["metric name is empty", "request has no samples", "request is not valid JSON", "request is not valid JSON"]


def test_reject_texts(spark):
    bad = [("foo-bar", {}, NOW, 1.0), ("a", {"__x": "y"}, NOW, 1.0), ("a", {"b-c": "y"}, NOW, 1.0), ("a", {}, NOW, float("nan")), ("a", {}, NOW, float("-inf")), ("a", {}, NOW - 3_600_001, 1.0), ("a", {}, NOW + 300_001, 1.0), ("a", {"z": "1", "b-c": "y", "__x": "y"}, NOW, 1.0)]
    rows = ingest.validated(wire(spark, *bad), NOW)
    assert [r["reason"] for r in ingest.rejected(rows).orderBy("index").collect()] == [
        "metric name 'foo-bar' contains invalid characters (must match [a-zA-Z_][a-zA-Z0-9_]*)", "label name '__x' is reserved (starts with '__')", "label name 'b-c' is invalid (must match [a-zA-Z_][a-zA-Z0-9_]*)",
        "value is not finite: NaN", "value is not finite: -Infinity", "timestamp 1714796399999 ms is too old: now=1714800000000 ms, grace=3600000 ms", "timestamp 1714800300001 ms is in the future: now=1714800000000 ms, grace=300000 ms", "label name '__x' is reserved (starts with '__')",
    ]
    assert ingest_json(rows)["accepted"] == 0 and ingest_json(rows)["rejected"][0]["index"] == 0


def pb(number, payload):
    return bytes([number << 3 | 2]) + varint(len(payload)) + payload


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def snappy(b):
    out = varint(len(b))
    for i in range(0, len(b), 60):
        part = b[i : i + 60]
        out += bytes([(len(part) - 1) << 2]) + part
    return out


def series(labels, samples):
    body = b"".join(pb(1, pb(1, k.encode()) + pb(2, v.encode())) for k, v in labels.items())
    return pb(1, body + b"".join(pb(2, b"\x09" + struct.pack("<d", v) + b"\x10" + varint(ts)) for ts, v in samples))


def test_remote_write(spark):
    good = snappy(series({"__name__": "m", "__x": "y", "job": "a"}, [(5, 1.5), (6, 2.5)]) + series({"job": "b"}, [(7, 1.0)]))
    rows = remote_write.decoded(spark.createDataFrame([(1, good), (2, b"garbage"), (3, b""), (4, snappy(b"\xff\xff"))], "request long, body binary"))
    assert sorted(r["request"] for r in rows.where("error is not null").collect()) == [2, 4]
    flat = remote_write.flattened(rows).collect()
    assert sorted((r["metric"], r["labels"], r["ts"], r["value"]) for r in flat) == [("m", {"job": "a"}, 5, 1.5), ("m", {"job": "a"}, 6, 2.5)]


def test_remote_write_odd_bodies(spark):
    twice = snappy(pb(1, pb(1, pb(1, b"__name__") + pb(2, b"m")) + pb(1, pb(1, b"j") + pb(2, b"a")) + pb(1, pb(1, b"j") + pb(2, b"b")) + pb(2, b"\x09" + struct.pack("<d", 1.0) + b"\x10" + varint(NOW))))
    none = snappy(series({"job": "b"}, [(7, 1.0), (8, 1.0)]) + series({"__name__": "", "x": "y"}, [(7, 1.0)]) + series({"__name__": "bad name"}, [(NOW, 1.0)]))
    rows = remote_write.decoded(spark.createDataFrame([(1, None), (2, twice), (3, none)], "request long, body binary"))
    assert [(r["request"], r["reason"]) for r in remote_write.failed(rows).collect()] == [(1, "remote_write decode: body is missing")]
    checked = ingest.validated(remote_write.flattened(rows), NOW)
    assert [(r["metric"], r["labels"]) for r in ingest.accepted(checked).collect()] == [("m", {"j": "b"})]
    assert [r["index"] for r in ingest.rejected(checked).collect()] == [3]
    assert [tuple(r) for r in remote_write.nameless(rows).collect()] == [(3, 2)]


def test_snappy_copies():
    assert remote_write.unsnappy(bytes([8, 4]) + b"ab" + bytes([(6 - 4) << 2 | 1, 2])) == b"abababab"


def test_wire_schema():
    assert WIRE.names == ["metric", "labels", "ts", "value"]
