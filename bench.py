"""Times the headline queries over a written store and prints one line of JSON.

The event tables are written as metric stores first, which is not timed: the
queries read them as they would read a store in use.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.api import Engine
from pulsegrid.functions.expr import micros
from pulsegrid.plans import catalogue
from pulsegrid.sources.store import MetricStore

NAMES = ["m8_sql", "k3_topk_increase_instant_by", "a5_sum_rate_instant_by", "a7_sum_rate_range_by", "h3_quantile_of_sum_range", "r2_rate_range", "a3_sum_range_by", "b8_vector_vector_range", "f12_range_selector_aligned", "m5_rate_view"]
VIEWS = {"m8_sql": (catalogue.G, "SELECT CAST(date_trunc('DAY', timestamp) AS DATE) AS day, count(*) AS n, count(DISTINCT series_id) AS series FROM samples GROUP BY ROLLUP (1) HAVING count(*) > 1"), "m5_rate_view": (catalogue.C, "SELECT labels['event_type'] AS event_type, labels['user_id'] AS user_id, timestamp, round(value_per_sec, 9) AS value_per_sec FROM sk_rate_of")}


def written(spark: SparkSession, source, sf_dir: str, folder: str) -> MetricStore:
    store = MetricStore(spark, f"{folder}/{source.__name__}")
    series, samples = source(spark, sf_dir)
    store.append(samples.join(series, "series_id").select("series_id", F.col("metric_name").alias("metric"), "labels", micros(F.col("timestamp")).alias("ts_us"), "value"))
    return store


def query(spark: SparkSession, name: str, stores: dict) -> DataFrame:
    if name in VIEWS:
        source, text = VIEWS[name]
        stores[source].register_views()
        return spark.sql(text)
    text, source, labels, instant, aligned = catalogue.PROMQL[name]
    return catalogue.answer(Engine.of_store(stores[source], lookback=catalogue.LOOKBACK / 1e6), text, labels, instant, aligned)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="bench-")
    try:
        sources = {catalogue.PROMQL[n][1] for n in NAMES if n not in VIEWS} | {s for s, _ in VIEWS.values()}
        stores = {s: written(spark, s, sf_dir, folder) for s in sources}
        took = {}
        query(spark, NAMES[0], stores).count()
        for name in NAMES:
            began = time.time()
            query(spark, name, stores).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
