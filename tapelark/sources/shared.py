"""The folder that driver and executors share, and tables that a session writes there once."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tapelark.errors import BadInput

_own: list[str] = []
_kept: dict[tuple[str, ...], str] = {}


def folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; where it names nothing, a folder of our own, on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise BadInput("spark.checkpoint.dir has to name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tapelark-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        root = f"file://{_own[0]}"
    return f"{root.rstrip('/')}/tapelark"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


@contextmanager
def written(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """``df`` written and read back, for as long as the block lasts. Unlike a cache it stays as it is when a table that it came from is written to."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def once(spark: SparkSession, key: tuple[str, ...], make: Callable[[], DataFrame], order: tuple[str, ...] = ()) -> DataFrame:
    """A table that the first caller of a session writes, in order of some columns, and later ones read."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _kept or not exists(spark, f"{_kept[key]}/_SUCCESS"):
        df, path = make(), f"{folder(spark)}/{key[-1]}-{uuid.uuid4().hex[:12]}"
        df = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
        df.write.parquet(path)
        _kept[key] = path
    return spark.read.parquet(_kept[key])
