"""What the corpus operators share: tables, scratch space, batches of texts."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows of an Arrow batch handed to Python; texts may be very long, so bytes bound it first.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000
#: White space of the text contracts: space, tab to carriage return.
SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches(spark: SparkSession) -> None:
    """Bounds the batches of Python operators by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text(name: str = "text") -> Column:
    """A text column whose nulls are empty texts."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(docs: DataFrame, name: str) -> str:
    """name, with underscores put before it until no column of docs has it in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on a local master only, one of our own where that is unset."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # noqa: BLE001  the session has ended before the interpreter
        pass


def input_bytes(df: DataFrame) -> int:
    """The size of df by Spark's statistics, which come from file sizes and cost no scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/wayfare-{uuid.uuid4().hex}"


def materialize(df: DataFrame, *partition_by: str, path: str = "") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut there, lost executors recompute from the files.

    The files stay until the application ends, as results that are still lazy may read them.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark)
    atexit.register(_drop_quietly, spark, path)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """materialize() for tables that nothing reads after the block: they are deleted at its end, and shuffles that are done can go."""
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        paths.append(scratch_path(spark))
        return materialize(df, path=paths[-1])

    try:
        yield keep
    finally:
        for path in paths:
            _drop_quietly(spark, path)
        spark.sparkContext._jvm.System.gc()  # shuffle files go when the driver no longer holds their plans


#: Range of sample_key().
KEYS = 1 << 31


def sample_key(hashed: str) -> Column:
    """A key in [0, KEYS) from a column of 64-bit hashes: rows of the least keys are a sample that no partitioning changes."""
    return F.pmod(F.col(hashed), F.lit(KEYS))


def sample_bound(rows: int, most: int) -> int:
    """Below this key lie about one and a half times ``most`` of ``rows`` rows, so that a top-k over them stays small on any number of tasks."""
    return KEYS if rows <= most else max(1, int(KEYS * min(1.0, 1.5 * most / rows)))
