"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []

#: Largest Arrow batch handed to Python, so that very long texts don't pile up in one batch.
ARROW_BATCH_BYTES = 8 << 20
ARROW_BATCH_ROWS = 4000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); without one a temporary folder, but in local mode alone."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _OWN_DIR:
            _OWN_DIR[app] = tempfile.mkdtemp(prefix="tessera-")
        path = _OWN_DIR[app]
    return f"{path.rstrip('/')}/{app}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """What is materialised within goes when the block ends, so results must be written or collected before."""
    first = len(_WRITTEN)
    try:
        yield
    finally:
        for spark, path in _WRITTEN[first:]:
            _delete(spark, path)
        del _WRITTEN[first:]


@atexit.register
def _remove_written() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # the session is already gone
            return


def bounded_batches(spark: SparkSession, most_bytes: int = ARROW_BATCH_BYTES) -> None:
    """Bound Arrow batches by bytes as well as rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))


def give_back() -> None:
    """Return the free memory of a task that is done to the system, as its Python worker stays and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


#: A key is hot if more than one row in so many has it; so fewer keys than that are hot.
HOT_SHARE = 20_000


def join_hot(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows joined with keys, which are distinct and have their number of rows as n (dropped); total is the number of all rows.

    Hot keys are broadcast, fewer than HOT_SHARE since their rows add up to total, and all others are joined by
    a shuffle, so no task gets the rows of a very common key.
    """
    hot = F.broadcast(keys.filter(F.col("n") > total // HOT_SHARE).drop("n"))
    cold = keys.filter(F.col("n") <= total // HOT_SHARE).drop("n")
    return rows.join(hot, on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, folds: int) -> Column:
    """crc32 of the id's decimal text modulo folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(folds)


def hash_share(column: Column, seed: int) -> Column:
    """A seeded pseudo-random number in [0, 1) that depends on the column's value alone."""
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(1 << 31)) / F.lit(float(1 << 31))


def input_gb(df: DataFrame) -> float:
    """Catalyst's size estimate of df in GB: file sizes for scans."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString()) / 1e9
