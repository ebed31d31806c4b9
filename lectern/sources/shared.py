"""Intermediate tables in the folder that the driver and all executors share.

Lineage is cut by writing parquet there: a lost executor then costs a re-read, never a re-run of
what came before. The folder is the cluster's ``spark.checkpoint.dir``; a local one is used only
where that setting is absent (tests on one machine).
"""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL = "/tmp/lectern-shared"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder, without a trailing slash. Without the setting, a local folder on one machine; an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{_LOCAL}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; it is removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as parquet to the shared folder and read back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes one path, on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _written[:] = [x for x in _written if x[1] != path]


def discard(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing will read again."""
    remove(df.sparkSession, df.stored_path)


@contextmanager
def collected() -> Iterator[list[str]]:
    """Afterwards, the paths that were written within and are still there."""
    before = {path for _, path in _written}
    found: list[str] = []
    yield found
    found += [path for _, path in _written if path not in before]


@atexit.register
def _clean() -> None:
    for spark, path in list(_written):
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
    _written.clear()
