"""Shared folder, written tables and small helpers used by several operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch sent to Python; documents are whole texts, so the default of 10,000 is too many.
BATCH_ROWS = 1000
#: Parts that the rows of one join key are dealt into.
SALTS = 64


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small; everything else stays as the session has it."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where
    that is unset and everything runs on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        where = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="platen-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        where = "file://" + folder
        spark.sparkContext.setCheckpointDir(where)
    return where


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/platen/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage ends there, and
    a lost executor loses nothing of it."""
    spark, path = df.sparkSession, new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever it is stored."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Written tables of one computation. ``done`` writes its result beside them and removes them, so that a finished
    computation leaves nothing but its result in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.root, self.count = spark, name, new_dir(spark, f"{name}-scratch"), 0

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        remove(self.spark, self.root)

    def done(self, df: DataFrame) -> DataFrame:
        out = written(df, self.name)
        self.remove()
        return out


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``left`` left-joined to ``right``, which has one row a key, however many rows of ``left`` share a key: rows meet by
    key and a salt from the column ``by``. The distinct (key, salt) pairs, at most SALTS a key, get ``right``'s row first.
    A null in a key matches nothing."""
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS)).alias("_salt")
    left = left.select("*", salt)
    pairs = left.select(*keys, "_salt").distinct().join(right, keys)
    return left.join(pairs, [*keys, "_salt"], "left").drop("_salt")


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a broadcast hint if it is proven to have at most ``most`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def release() -> None:
    """Give memory that a Python worker has freed back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
