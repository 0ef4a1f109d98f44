"""Cutting lineage in a way that survives the loss of executors, and giving back what is kept."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that spark.checkpoint.dir names.

    Where the session names none, a temporary folder is set once on a local master; on a cluster that is an error, as
    executors could not share it. With spark.cleaner.referenceTracking.cleanCheckpoints (local_session sets it) Spark
    deletes the files once nothing refers to them.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


_KEPT: list[DataFrame] = []


def kept(df: DataFrame) -> DataFrame:
    """Cached blocks; lost ones are computed again from the lineage, which stays whole. release gives them back."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _KEPT.append(df)
    return df


def release() -> None:
    """Unpersists everything kept so far. A result that still refers to it is right all the same, and computes it again."""
    while _KEPT:
        try:
            _KEPT.pop().unpersist()
        except Exception:  # noqa: BLE001  its session has ended, and its blocks with it
            continue


#: Rows of a small table that may be broadcast.
FEW_ROWS = 20_000


def few(df: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, else as it is, for Spark to join by shuffling."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
