"""Derived tables that are built once and read by many queries.

A stored table is Parquet in spark.checkpoint.dir, which the driver and all executors share, partitioned by the
columns that queries select on, so each reads the partitions it needs. Without that setting a temporary folder
serves local mode; on a cluster its absence is an error. A store belongs to one application and is deleted when
the process ends. A table is built again when names, sizes or times of the entries of its input folder have changed;
drop() forgets what was built from one.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_STORED: dict[tuple[str, str, str], tuple[SparkSession, str, StructType, tuple]] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []
_OWN_DIR: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    path, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _OWN_DIR:
            _OWN_DIR[app] = tempfile.mkdtemp(prefix="tessera-store-")
        path = _OWN_DIR[app]
    return f"{path.rstrip('/')}/{app}"


def _state(spark: SparkSession, base: str) -> tuple:
    """Names, sizes and times of the entries of a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in files.listStatus(path))) if files.exists(path) else ()


def stored(spark: SparkSession, base: str, name: str, make: Callable[[], DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """The table `name` derived from the inputs at base; make() builds it the first time."""
    key, state = (spark.sparkContext.applicationId, base, name), _state(spark, base)
    if key in _STORED and _STORED[key][3] != state:
        _delete(*_STORED.pop(key)[:2])
    if key not in _STORED:
        df, path = make(), f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
        _STORED[key] = (spark, path, df.schema, state)
    _, path, schema, _ = _STORED[key]
    return spark.read.schema(schema).parquet(path)


def is_stored(spark: SparkSession, base: str, name: str) -> bool:
    """Whether the table `name` is there and its inputs are as they were."""
    key = (spark.sparkContext.applicationId, base, name)
    return key in _STORED and _STORED[key][3] == _state(spark, base)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder: lineage ends there, and what tasks decided, such as blocks, stays as it is."""
    spark, path = df.sparkSession, f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, base: str) -> None:
    """Delete and forget all that was derived from the inputs at base."""
    for key in [k for k in _STORED if k[:2] == (spark.sparkContext.applicationId, base)]:
        _delete(*_STORED.pop(key)[:2])


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in [*(v[:2] for v in _STORED.values()), *_WRITTEN]:
        try:
            _delete(spark, path)
        except Exception:  # the session is already gone
            return
