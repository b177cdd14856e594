"""Lineage cuts in the folder that the session shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in spark.checkpoint.dir. Only a local session that names none gets
    a folder of its own; on a cluster it would be out of the executors' reach."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestone-"))
    return df.checkpoint(eager=True)
