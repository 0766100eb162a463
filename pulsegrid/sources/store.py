"""Storage of series and samples as Parquet, samples partitioned by day, and the helper views."""

from __future__ import annotations

import re
from datetime import date
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import series_id, sorted_labels
from ..schema import SAMPLES, SERIES

#: Bytes a written file is meant to have is left to Spark; rows are clustered by series, which gives row groups narrow ranges.
SAMPLE_ORDER = ["timestamp_day", "series_id", "timestamp"]


class MetricStore:
    """Two tables below a path; samples lie in a folder for each day and batch."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.series_path, self.samples_path = spark, path, f"{path}/series", f"{path}/samples"

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    @property
    def _files(self):
        return self._path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, path: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self._files.listStatus(self._path(path))) if self._files.exists(self._path(path)) else []

    def _read(self, path: str, schema) -> DataFrame:
        if not self._files.exists(self._path(path)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def series(self) -> DataFrame:
        return self._read(self.series_path, SERIES)

    def samples(self) -> DataFrame:
        return self._read(self.samples_path, T.StructType([*SAMPLES.fields, T.StructField("timestamp_day", T.DateType()), T.StructField("batch", T.StringType())])).drop("batch")

    def append(self, accepted: DataFrame, batch_id: int | None = None, stream: str | None = None) -> None:
        """Writes (series_id, metric, labels, ts_us, value): new series first, so that no sample is ever without one.

        A batch number makes a repeated batch of the same stream replace what its
        first try wrote. stream must tell streams apart for ever: the id that a
        query keeps in its checkpoint does.
        """
        if (batch_id is None) != (stream is None):
            raise ValueError("a batch number counts within a stream: give both or none")
        self._add_series(new_series(accepted, self.series()))
        batch = "direct" if batch_id is None else f"{stream}-b{batch_id}"
        self._add_samples(sample_rows(accepted).withColumn("batch", F.lit(batch)), replace=batch_id is not None)

    def _add_series(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.series_path)

    def _add_samples(self, rows: DataFrame, replace: bool) -> None:
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") if replace else rows.write.mode("append")
        writer.partitionBy("timestamp_day", "batch").parquet(self.samples_path)

    def compact(self, day: date) -> None:
        """Rewrites the batches of a day as one folder, but for the last of each stream, which may run again.

        The rows are staged with a list of what they stand for, then the old
        folders go and the staged one moves in. A run that was cut short is
        finished by the next; between the two steps readers miss rows.
        """
        self.finish_compaction()
        folder, last = f"{self.samples_path}/timestamp_day={day}", {}
        batches = [b for b in self._list(folder) if b.startswith("batch=")]
        for b in batches:
            if m := re.fullmatch(r"batch=(.+)-b(\d+)", b):
                last[m[1]] = max(last.get(m[1], -1), int(m[2]))
        old = [b for b in batches if not any(b == f"batch={s}-b{n}" for s, n in last.items())]
        if len(old) < 2:
            return
        staged = f"{self.path}/_compact/{day}_{uuid4().hex}"
        rows = self.spark.read.schema(SAMPLES).parquet(*(f"{folder}/{b}" for b in old))
        rows.repartitionByRange("series_id").sortWithinPartitions("series_id", "timestamp").write.parquet(staged)
        self.spark.createDataFrame([(b,) for b in old], "batch string").coalesce(1).write.text(f"{staged}.old")
        self.finish_compaction()

    def finish_compaction(self) -> None:
        """Puts staged days in place whose list of old folders is complete."""
        fs, top = self._files, f"{self.path}/_compact"
        for name in self._list(top):
            if not name.endswith(".old") or not fs.exists(self._path(f"{top}/{name}/_SUCCESS")):
                continue
            day, key = name.removesuffix(".old").split("_")
            folder = f"{self.samples_path}/timestamp_day={day}"
            for r in self.spark.read.text(f"{top}/{name}").collect():  # folders of one day
                fs.delete(self._path(f"{folder}/{r['value']}"), True)
            if fs.exists(self._path(f"{top}/{day}_{key}")):
                fs.rename(self._path(f"{top}/{day}_{key}"), self._path(f"{folder}/batch=compacted-{key}"))
            fs.delete(self._path(f"{top}/{name}"), True)

    def register_views(self) -> None:
        register_views(self.spark, self.series(), self.samples())


class CatalogStore(MetricStore):
    """The same two tables in a database of the session's catalog."""

    def __init__(self, spark: SparkSession, database: str) -> None:
        self.spark, self.database = spark, database
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.series (series_id BIGINT, metric_name STRING, labels MAP<STRING, STRING>) USING parquet")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.samples (series_id BIGINT, timestamp TIMESTAMP_NTZ, value DOUBLE, timestamp_day DATE, batch STRING) USING parquet PARTITIONED BY (timestamp_day, batch)")

    def series(self) -> DataFrame:
        return self.spark.table(f"{self.database}.series")

    def samples(self) -> DataFrame:
        return self.spark.table(f"{self.database}.samples").drop("batch")

    def _add_series(self, rows: DataFrame) -> None:
        rows.write.insertInto(f"{self.database}.series")

    def _add_samples(self, rows: DataFrame, replace: bool) -> None:
        conf, key = self.spark.conf, "spark.sql.sources.partitionOverwriteMode"
        mode = conf.get(key)
        conf.set(key, "dynamic")  # insertInto takes no option of that name
        try:
            rows.select("series_id", "timestamp", "value", "timestamp_day", "batch").write.insertInto(f"{self.database}.samples", overwrite=replace)
        finally:
            conf.set(key, mode)

    def compact(self, day: date) -> None:
        raise NotImplementedError("tables of a catalog are compacted by their format")


def new_series(accepted: DataFrame, known: DataFrame) -> DataFrame:
    """The series of accepted rows that are not known, a row for each."""
    rows = accepted.select("series_id", F.col("metric").alias("metric_name"), "labels").dropDuplicates(["series_id"])
    return rows.join(known.select("series_id"), "series_id", "left_anti").select(*SERIES.names)


def sample_rows(accepted: DataFrame) -> DataFrame:
    """Sample rows with their day. A day may be large: several tasks write it, each with its range of series."""
    rows = accepted.select("series_id", F.timestamp_micros("ts_us").cast("timestamp_ntz").alias("timestamp"), "value").withColumn("timestamp_day", F.to_date("timestamp"))
    return rows.repartitionByRange("timestamp_day", "series_id").sortWithinPartitions(*SAMPLE_ORDER)


def register_views(spark: SparkSession, series: DataFrame, samples: DataFrame) -> None:
    """series, samples, sk_metric (samples with their labels) and sk_rate_of (change per second to the sample before, without resets).

    sk_rate_of sorts ids, times and values only; the metric's name is one of its
    partition columns, so that a filter on it reaches the series.
    """
    series.createOrReplaceTempView("series")
    samples.createOrReplaceTempView("samples")
    spark.sql("CREATE OR REPLACE TEMP VIEW sk_metric AS SELECT series_id, timestamp, value, metric_name, labels FROM samples JOIN series USING (series_id)")
    spark.sql(
        """CREATE OR REPLACE TEMP VIEW sk_rate_of AS
        WITH named AS (SELECT series_id, metric_name, unix_micros(CAST(timestamp AS TIMESTAMP)) AS us, timestamp, value FROM samples JOIN (SELECT series_id, metric_name FROM series) USING (series_id)),
        steps AS (SELECT series_id, metric_name, timestamp, value - lag(value) OVER step AS up, us - lag(us) OVER step AS took FROM named WINDOW step AS (PARTITION BY series_id, metric_name ORDER BY timestamp, value))
        SELECT series_id, timestamp, metric_name, labels, up / NULLIF(took / 1e6, 0) AS value_per_sec FROM steps JOIN (SELECT series_id, labels FROM series) USING (series_id)"""
    )


def as_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metric, labels, ts_us, value) as series and samples."""
    rows = rows.withColumn("labels", sorted_labels(F.col("labels"))).withColumn("series_id", series_id(F.col("metric"), F.col("labels")))
    series = rows.groupBy("series_id").agg(F.first("metric").alias("metric_name"), F.first("labels").alias("labels"))
    return series, rows.select("series_id", F.timestamp_micros("ts_us").cast("timestamp_ntz").alias("timestamp"), "value")
