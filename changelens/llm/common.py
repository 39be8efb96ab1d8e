"""Small helpers that several operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"
#: The same six characters, for ``translate``.
SPACES = " \t\n\x0b\x0c\r"


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


#: The temporary folder of sessions on one machine.
_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none and runs on one machine, as in tests, a temporary one
    is made and remembered here; on a cluster that is an error, as no executor could read
    what another one writes there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
        path = _LOCAL[0]
    return path.rstrip("/")


#: Folders of intermediate tables written by this process and not removed yet.
WRITTEN: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: this cuts the lineage,
    and lost executors cost no recomputation of what is before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0, keep: Iterable[DataFrame] = ()) -> None:
    """Remove the intermediate tables written after the first ``since`` ones, but those
    that ``keep`` reads. Call it once nothing that isn't computed yet reads them."""
    needed = {file.rsplit("/", 2)[-2] for df in keep for file in df.inputFiles()}
    for path in [p for p in WRITTEN[since:] if p.rsplit("/", 1)[-1] not in needed]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        WRITTEN.remove(path)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of what is written by now: they stay until the
    driver collects its garbage, which may be never within a job of many steps."""
    gc.collect()
    spark._jvm.System.gc()


#: Bits of a sieve, by hash of the id; more ids let more others through, that is all.
SIEVE_BITS = 1 << 26


def sieve(ids: DataFrame, name: str) -> Callable[[Column], Column]:
    """An expression that is true for each id among the column ``name`` of ``ids``, and for
    few others. It holds the ids' bits (8 MB, whatever the input's size), so rows that a
    join can't concern needn't be shuffled for it; the join itself must follow."""
    spark = ids.sparkSession
    place = lambda x: F.pmod(F.xxhash64(x.cast("long")), F.lit(SIEVE_BITS))
    bits = ids.select(place(F.col(f"`{name}`")).alias("h")).groupBy(F.expr("h div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(h % 64 as int)))").alias("bits")).toArrow()
    held = np.zeros(SIEVE_BITS // 64, np.int64)
    held[bits.column("at").to_numpy()] = bits.column("bits").to_numpy()
    sent = spark.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def may_be(h: pd.Series) -> pd.Series:
        at = h.to_numpy()
        return pd.Series((sent.value[at >> 6] >> (at & 63)) & 1 == 1)

    return lambda x: may_be(place(x))


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    parts = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    return F.coalesce(parts, F.array().cast("array<string>"))
