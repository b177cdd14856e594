"""Helpers shared by the operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import types
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Only a local session without one gets a folder of its
    own; on a cluster it would be out of the executors' reach."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="lodestone-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark's own file systems have it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(df: DataFrame) -> None:
    """Lets go of what finished steps have shuffled: Spark deletes those files when the driver
    has collected what referred to them, which an idle driver does too seldom."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.java.lang.System.gc()


def process_cache() -> dict:
    """A dictionary that lives as long as this Python process, over tasks."""
    name = "_lodestone_process_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name].__dict__


#: Rows of a batch between the JVM and Python: texts are long, so it holds fewer than usual.
BATCH_ROWS = 1500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _returned_memory(fn, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A worker serves many tasks: what one has freed goes back to the system."""
    try:
        yield from fn(batches)
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a bounded worker memory. It lowers the session's rows per Arrow
    batch to BATCH_ROWS if they are more."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    return df.mapInArrow(partial(_returned_memory, fn), schema)


def text_of(df: DataFrame, *ids: str) -> DataFrame:
    """The id columns and last _text, the text with null read as empty; other columns are
    left behind."""
    return df.select(*[F.col(f"`{c}`") for c in ids], F.coalesce(F.col("text"), F.lit("")).alias("_text"))


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus
