"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.streaming.state import last_versions


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def ingest_available(spark: SparkSession, source: str, target: str, checkpoint: str, keys: Sequence[str], fmt: str = "parquet") -> None:
    """Append the rows of new files in source whose keys target doesn't have yet; a rerun adds nothing.

    The file source remembers files in the checkpoint; within foreachBatch, rows meet the target by an anti
    join, so a batch that is repeated after a failure is idempotent.
    """
    schema = spark.read.format(fmt).load(source).schema

    def add(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        new = batch.dropDuplicates(list(keys))
        if _exists(session, target):
            new = new.join(session.read.schema(schema).parquet(target).select(*keys), list(keys), "left_anti")  # only the keys are read
        new.write.mode("append").parquet(target)

    query = spark.readStream.format(fmt).schema(schema).load(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def upsert_available(spark: SparkSession, source: str, target: str, checkpoint: str, keys: Sequence[str], fmt: str = "parquet", version: str | None = None) -> None:
    """Write the rows of new files as versions into target; current_rows() has the last version of each key.

    Of a key's rows in one batch the one with the largest `version` counts; without such a column, any of them.

    A batch overwrites its own partition (the checkpoint's hash and the batch's number), so one that is repeated
    after a failure changes nothing, and no batch reads what is there.
    """
    schema = spark.read.format(fmt).load(source).schema
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def put(batch: DataFrame, number: int) -> None:
        last = last_versions(batch, keys, version) if version else batch.dropDuplicates(list(keys))
        rows = last.withColumns({"_at": F.current_timestamp(), "_order": F.lit(number)})
        rows.write.mode("overwrite").parquet(f"{target}/_run={run}/_batch={number}")

    query = spark.readStream.format(fmt).schema(schema).load(source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current_rows(spark: SparkSession, target: str, keys: Sequence[str]) -> DataFrame:
    """The last version of each key that upsert_available() wrote."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(target)
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_at", "_order")).alias("v"))
    return last.select(*keys, *[F.col(f"v.{c}").alias(c) for c in rest if not c.startswith("_")])


def changed_texts(incoming: DataFrame, state: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of incoming that state doesn't have under the same key with the same text, by content hash: what is to be done anew."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    known = state.select(key, F.col("digest").alias("__d")).distinct()
    rows = incoming.withColumn("digest", digest)
    return rows.join(known, (rows[key] == known[key]) & (rows["digest"] == known["__d"]), "left_anti")


def windowed_counts(events: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by key and tumbling window of a stream or table; rows later than the watermark are dropped by a stream."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n")).select("w.start", "w.end", key, "n")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: events no further apart than the gap."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select("w.start", "w.end", key, "n")
