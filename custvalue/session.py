"""Session helpers: checkpoint folder and lineage cuts."""

from __future__ import annotations

import gc
import tempfile
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting one only where none is named.

    The cluster names a shared folder in ``spark.checkpoint.dir``. A private
    temporary folder is used in local mode alone: on a cluster the executors
    could not read it, so a missing setting is an error there.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is not None:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the executors")
        configured = tempfile.mkdtemp(prefix="custvalue-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back from there.

    Used where several consumers must see the very same rows and partitions
    (global ordering), or where recomputing a wide aggregate per consumer would
    repeat a shuffle of the transactions. Survives the loss of executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a private folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free_disk(spark: SparkSession) -> None:
    """Let Spark remove shuffle files and checkpoints that nothing refers to.

    It does so when the driver collects its garbage, which a driver with memory
    to spare puts off for half an hour.
    """
    gc.collect()
    spark._jvm.System.gc()


FREE_EVERY = 3.0  # seconds between two collections while disk is freed, or 20 times what the last one took
_freeing, _next_free = threading.Lock(), 0.0


def _free_again(spark: SparkSession, every: float) -> None:
    """Free disk if it is time; jobs that run at once share the time."""
    global _next_free
    with _freeing:
        began = time.monotonic()
        if began >= _next_free:
            free_disk(spark)
            ended = time.monotonic()
            _next_free = ended + max(every, 20 * (ended - began))


@contextmanager
def freeing_disk(spark: SparkSession, every: float | None = None) -> Iterator[None]:
    """Free disk every few seconds, for work inside of many stages whose shuffles are read once each."""
    every, done = FREE_EVERY if every is None else every, threading.Event()

    def run() -> None:
        while not done.wait(every):
            _free_again(spark, every)

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()


def slices(spark: SparkSession) -> int:
    """Number of range partitions used for globally ordered work."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
