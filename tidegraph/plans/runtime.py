"""Session helpers shared by the operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for reliable checkpoints.

    A cluster names it in ``spark.checkpoint.dir``; only a local session may leave it unset (tests), and gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    have = context.getCheckpointDir()
    if have is None:
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidegraph-checkpoint-"))
        have = context.getCheckpointDir()
    return have


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back; survives a lost executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` to be broadcast if it has at most ``most`` rows, which are counted; else as it is, to be joined by key."""
    return F.broadcast(df) if len(df.select(F.lit(1)).head(most + 1)) <= most else df
