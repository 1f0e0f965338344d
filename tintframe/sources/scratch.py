"""Tables that a job writes for itself in the shared folder, and the folder's end."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tintframe-')}"


def root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only for a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return shared or _own_folder()


def _store(spark: SparkSession, path: str) -> tuple:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def remove(spark: SparkSession, path: str) -> None:
    store, there = _store(spark, path)
    store.delete(there, True)


@functools.cache
def _folder(spark: SparkSession, application: str) -> str:
    path = f"{root(spark)}/tintframe-{application}"
    store, there = _store(spark, path)
    atexit.register(_end, spark, path, there.toUri().getPath() if store.getUri().getScheme() == "file" else None)
    return path


def _end(spark: SparkSession, path: str, local: str | None) -> None:
    """Remove the application's folder; after the session's end only one that the driver sees as well."""
    if spark.sparkContext._jsc is not None:
        remove(spark, path)
    elif local:
        shutil.rmtree(local, ignore_errors=True)


def folder(spark: SparkSession, name: str) -> str:
    """A new path under the application's own folder, which goes when the driver ends in order."""
    return f"{_folder(spark, spark.sparkContext.applicationId)}/{uuid.uuid4().hex}-{name}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it again: later steps start from the table, also after a loss."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
