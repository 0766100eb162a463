"""Structured Streaming ingest: validated micro-batches into a store.

The acceptance window is on the wall clock, as for single requests; it is no
watermark. New series are found by an anti-join at each commit. The id that the
query keeps in its checkpoint and the batch number make a batch that runs again
replace itself, and nothing else. How much a batch takes is the source's matter
(maxFilesPerTrigger, maxBytesPerTrigger), as is the removal of files that are
done (cleanSource).
"""

from __future__ import annotations

import json
import time
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.ingest import accepted, rejected, validated
from ..sources.store import MetricStore

PREFIX = "pulsegrid"


class Metrics:
    """Counters of ingest, in the text form that scrapers read."""

    def __init__(self) -> None:
        self.values: Counter = Counter()

    def add(self, name: str, value: float, **labels: str) -> None:
        own = ",".join(f'{k}="{v}"' for k, v in sorted(labels.items()))
        self.values[f"{PREFIX}_{name}" + (f"{{{own}}}" if own else "")] += value

    def text(self) -> str:
        return "".join(f"{k} {v}\n" for k, v in sorted(self.values.items()))


def stream_id(spark, checkpoint: str) -> str:
    """The id of the query that owns a checkpoint; restarts keep it, another checkpoint has another."""
    return json.loads("".join(r["value"] for r in spark.read.text(f"{checkpoint}/metadata").collect()))["id"]


def start_ingest(wire: DataFrame, store: MetricStore, checkpoint: str, now_ms: int | None = None, every: str | None = "300 seconds", on_rejects: Callable[[DataFrame, int], None] | None = None, metrics: Metrics | None = None) -> StreamingQuery:
    """Starts writing a stream of wire rows; without a trigger interval it takes what is there and stops."""
    told = metrics or Metrics()

    def write(batch: DataFrame, number: int) -> None:
        rows, began, result = validated(batch, now_ms).persist(), time.time(), "error"
        try:
            store.append(accepted(rows), number, stream_id(batch.sparkSession, checkpoint))
            if on_rejects:
                on_rejects(rejected(rows), number)
            good, bad = rows.agg(F.count_if(F.col("reason").isNull()), F.count_if(F.col("reason").isNotNull())).first()
            told.add("ingest_accepted_total", good, endpoint="stream")
            told.add("ingest_rejected_total", bad, endpoint="stream")
            result = "ok"
        finally:
            told.add("flush_total", 1, result=result)
            told.add("flush_duration_seconds_sum", time.time() - began)
            rows.unpersist()

    writer = wire.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stop_ingest(query: StreamingQuery) -> None:
    """A last flush of all that has arrived, then the end."""
    if query.isActive:
        query.processAllAvailable()
        query.stop()
