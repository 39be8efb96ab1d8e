"""Tables in the folder that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession

from changelens.errors import EngineError

#: Where a session on one machine, which names no folder, has its tables.
_LOCAL: list[str] = []
#: Folders that this process has written and not removed.
WRITTEN: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; on a cluster the session must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise EngineError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
        folder = _LOCAL[0]
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


def written(df: DataFrame, name: str, where: Column | None = None, **measures: Column) -> tuple[DataFrame, Row | None]:
    """The rows where ``where`` holds, written and read again, and aggregates over all
    rows, taken while they are written: one pass makes the table and checks it."""
    seen = Observation(name) if measures else None
    if seen:
        df = df.observe(seen, *(c.alias(n) for n, c in measures.items()))
    path = shared_path(df.sparkSession, name)
    (df if where is None else df.where(where)).write.parquet(path)
    row = Row(**{n: seen.get[n] for n in measures}) if seen else None
    return df.sparkSession.read.schema(df.schema).parquet(path), row


@contextmanager
def held(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """The rows, written and read again, for as long as the block lasts."""
    path = shared_path(df.sparkSession, name)
    try:
        df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        release(df.sparkSession, [path])


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of what is written by now, which stay until the
    driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def release(spark: SparkSession, paths: Iterable[str] | None = None) -> None:
    """Remove written folders (all of this process, if none are named) that nothing reads any more."""
    for path in list(WRITTEN if paths is None else paths):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if path in WRITTEN:
            WRITTEN.remove(path)
