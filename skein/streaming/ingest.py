"""Incremental upkeep of the catalog: each arriving batch of rows is merged, latest row per key, into the table written last.

An extension: everything else here is batch.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from skein.operators.catalog import upsert
from skein.sources.files import CATALOG_SCHEMA


def latest_version(spark: SparkSession, table: str) -> str | None:
    """Path of the newest complete version of a table of versions v00000, v00001, ..."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    done = sorted(s.getPath().toString() for s in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return done[-1] if done else None


def ingest(spark: SparkSession, incoming: str, table: str, checkpoint: str, schema: str = CATALOG_SCHEMA) -> StreamingQuery:
    """Merge all files that are in ``incoming`` and not yet seen; a batch that is run again writes the same version again."""

    def merge(batch: DataFrame, number: int) -> None:
        before = latest_version(spark, table)
        target = f"{table}/v{number:05d}"
        if before and Path(before).name >= Path(target).name:
            return
        rows = batch if before is None else batch.unionByName(spark.read.parquet(before))
        upsert(rows).write.mode("overwrite").parquet(target)

    stream = spark.readStream.schema(schema).parquet(incoming)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
