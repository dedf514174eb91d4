"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that may be broadcast (a hash table of about 24 bytes each); above it the plans shuffle.
BROADCAST_IDS = 1_000_000
#: Bits of the table that stands for more ids than that.
MARKS = 1 << 25
#: Spark's setting for deleting a query's shuffle files at its end.
_DELETES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch; Spark's own size, as its setting reads where nobody has set it.
BATCH, _SPARKS_BATCH = 4 << 20, "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session without that setting (tests) gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the file system that the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut: a reliable checkpoint in the shared folder.

    The files of the shuffles that made it are deleted at once. By itself Spark leaves them until the driver's JVM happens to
    collect its garbage, and the disk holds the shuffles of all steps.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_DELETES, None)
    spark.conf.set(_DELETES, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # planned here, under the setting
    finally:
        if before is None:
            spark.conf.unset(_DELETES)
        else:
            spark.conf.set(_DELETES, before)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few bytes, as texts can be long; a size that the user has set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == _SPARKS_BATCH:
        spark.conf.set(name, str(BATCH))


def marks(ids: DataFrame, hashed: Column, bits: int) -> np.ndarray:
    """``bits`` bits in longs, in which each id's hash sets one: a table of one size, however many ids there are."""
    slot = F.pmod(hashed, F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    rows = ids.select(F.shiftright(slot, 6).cast("int").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return table


def parted(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of ``df`` whose ``key`` may be in the column ``key`` of ``ids``, rows whose ``key`` isn't): no row of an id is in the second."""
    name = "".join(["_", *df.columns])
    table = F.broadcast(df.sparkSession.createDataFrame(pa.table({name: pa.array([marks(ids, F.xxhash64(key), MARKS)])})))
    slot = F.pmod(F.xxhash64(df[key].cast(ids.schema[key].dataType)), F.lit(MARKS))
    hit = F.getbit(F.element_at(name, (F.shiftright(slot, 6) + 1).cast("int")), F.pmod(slot, F.lit(64)).cast("int")) == 1
    return df.join(table, hit, "left_semi"), df.join(table, hit, "left_anti")


def likely(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids`` (one column), without a shuffle of ``df``; for ids that are too many to broadcast some others too."""
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids), key, "left_semi") if few else parted(df, ids, key)[0]


def narrowed(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids`` (one column, distinct).

    The ids are broadcast if a count proves that they are few. Else both sides are shuffled, ``df`` without most of the rows
    that aren't in ``ids``.
    """
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids), key, "left_semi") if few else parted(df, ids, key)[0].join(ids, key, "left_semi")
