"""Tables that cut lineage, in the folder that the cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests, a temporary folder becomes it."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001  the session has ended
            return


atexit.register(_clean)


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


#: A table that joins send to all executors passes through the driver, and stays there until it is collected.
SENT = 1 << 20


@contextmanager
def small_broadcasts(spark: SparkSession):
    """Joins planned inside send tables of up to SENT bytes by themselves, whatever larger size is set."""
    name, held = "spark.sql.autoBroadcastJoinThreshold", spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    before = spark.conf.get(name, None)
    if held > SENT:
        spark.conf.set(name, SENT)
    try:
        yield
    finally:
        if held > SENT:
            spark.conf.set(name, before) if before else spark.conf.unset(name)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """Arrow stages that are planned and run inside get batches of about size: two tasks of an executor
    hold a batch, its copy in a Python worker and the answer at once."""
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, size)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before) if before else spark.conf.unset(BATCH)


#: Share of the driver's largest heap at which what is no longer used is given back.
HEAP = 0.35


def give_back(spark: SparkSession) -> bool:
    """Plans of tables written so far are garbage in the driver, which Java lets grow up to the largest heap
    before it collects it. Collects it, where the heap is beyond HEAP, and so returns its memory."""
    jvm = spark._jvm.java.lang
    runtime = jvm.Runtime.getRuntime()
    if runtime.totalMemory() <= HEAP * runtime.maxMemory():
        return False
    gc.collect()  # Python's references hold plans, too
    jvm.System.gc()
    return True


class Table:
    """A DataFrame written as Parquet to the shared folder. df reads it; drop() removes it early."""

    def __init__(self, df: DataFrame, name: str = "t"):
        self.spark = df.sparkSession
        self.path = f"{folder(self.spark)}/quillon-{name}-{uuid.uuid4().hex}"
        with small_batches(self.spark), small_broadcasts(self.spark):
            df.write.parquet(self.path)
        _written.append((self.spark, self.path))
        give_back(self.spark)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop(self.spark, self.path)


def free(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as set it apart from df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
