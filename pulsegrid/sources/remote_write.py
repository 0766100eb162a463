"""Remote write: raw-snappy protobuf bodies to wire rows. Decoding is Python, as neither format has a reader here; it runs once, at ingest."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 32 << 20
SCHEMA = "request long, index int, series int, labels array<struct<name:string,value:string>>, ts long, value double, error string"


class BadBody(ValueError):
    """A body that can't be decoded (HTTP 400)."""


def varint(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(b) or shift > 63:
            raise BadBody("bad varint")
        out |= (b[at] & 127) << shift
        at, shift, more = at + 1, shift + 7, b[at] & 128
        if not more:
            return out, at


def unsnappy(b: bytes) -> bytes:
    """One raw snappy block."""
    size, at = varint(b, 0)
    if size > MOST_BYTES:
        raise BadBody("body is too large")
    out = bytearray()
    while at < len(b):
        tag, at = b[at], at + 1
        if tag & 3 == 0:  # literal
            n = tag >> 2
            if n >= 60:
                extra = n - 59
                n, at = int.from_bytes(b[at : at + extra], "little"), at + extra
            if at + n + 1 > len(b):
                raise BadBody("snappy literal is cut short")
            out += b[at : at + n + 1]
            at += n + 1
        else:  # copy from what is out already
            need = (0, 1, 2, 4)[tag & 3]
            if at + need > len(b):
                raise BadBody("snappy copy is cut short")
            tail = int.from_bytes(b[at : at + need], "little")
            n, back = ((tag >> 2 & 7) + 4, (tag >> 5) << 8 | tail) if tag & 3 == 1 else ((tag >> 2) + 1, tail)
            at += need
            if not 0 < back <= len(out):
                raise BadBody("snappy offset is out of range")
            for _ in range(n):
                out.append(out[-back])
        if len(out) > size:
            break
    if len(out) != size:
        raise BadBody("snappy length differs")
    return bytes(out)


def fields(b: bytes) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of a protobuf message."""
    at = 0
    while at < len(b):
        key, at = varint(b, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(b, at)
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = b[at : at + n], at + n
            if len(value) < n:
                raise BadBody("field is cut short")
        elif kind == 2:
            n, at = varint(b, at)
            value, at = b[at : at + n], at + n
            if len(value) < n:
                raise BadBody("field is cut short")
        else:
            raise BadBody(f"wire type {kind}")
        yield key >> 3, kind, value


def decode(body: bytes | None) -> list[tuple[int, list[dict], int, float]]:
    """(number of the series, labels, ts in ms, value) of each sample of a compressed write request. Of labels of one name the last counts."""
    if body is None:
        raise BadBody("body is missing")
    if len(body) > MOST_BYTES:
        raise BadBody("body is too large")
    out, place = [], -1
    for number, kind, series in fields(unsnappy(body)) if body else ():
        if number != 1 or kind != 2:
            continue
        place += 1
        labels, samples = {}, []
        for n, k, value in fields(series):
            if k != 2:
                continue
            own = {i: v for i, _, v in fields(value)}
            try:
                if n == 1:
                    labels[own.get(1, b"").decode()] = own.get(2, b"").decode()
                elif n == 2:
                    ts = own.get(2, 0)
                    samples.append((ts - (1 << 64) if ts >> 63 else ts, struct.unpack("<d", own.get(1, bytes(8)))[0]))
            except (AttributeError, UnicodeDecodeError, struct.error) as e:
                raise BadBody(str(e)) from None
        named = [{"name": k, "value": v} for k, v in labels.items()]
        out.extend((place, named, ts, value) for ts, value in samples)
    return out


def decoded(bodies: DataFrame) -> DataFrame:
    """(request, body) -> a row for each sample, or one with the error of a body that can't be decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for request, body in zip(b["request"], b["body"], strict=True):
                try:
                    rows.extend((request, i, *sample, None) for i, sample in enumerate(decode(None if body is None else bytes(body))))
                except BadBody as e:
                    rows.append((request, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["request", "index", "series", "labels", "ts", "value", "error"]).astype({"index": "Int32", "series": "Int32", "ts": "Int64"})

    return bodies.select(F.col("request").cast("long").alias("request"), "body").mapInPandas(run, SCHEMA)


def metric_name() -> Column:
    return F.get(F.filter("labels", lambda x: x["name"] == "__name__"), F.lit(0))["value"]


def flattened(rows: DataFrame) -> DataFrame:
    """Wire rows with their request and index: __name__ becomes the metric, other labels of that kind go, samples without a name go."""
    own = F.filter("labels", lambda x: ~x["name"].startswith("__"))
    labels = F.map_from_entries(F.transform(own, lambda x: F.struct(x["name"], x["value"])))
    return rows.where("error is null").select("request", "index", metric_name().alias("metric"), labels.alias("labels"), "ts", "value").where("metric is not null and metric != ''")


def failed(rows: DataFrame) -> DataFrame:
    """(request, reason) of bodies that can't be decoded (HTTP 400)."""
    return rows.where("error is not null").select("request", F.concat(F.lit("remote_write decode: "), "error").alias("reason"))


def nameless(rows: DataFrame) -> DataFrame:
    """(request, series): how many series with samples went for want of a name."""
    return rows.where("error is null").where(F.coalesce(metric_name(), F.lit("")) == "").groupBy("request").agg(F.countDistinct("series").alias("series"))
