"""Parquet tables by name, and cuts of a lineage."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder that driver and executors share: spark.checkpoint.dir; where that is unset, a local one in local mode (tests), and an error on a cluster."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            top = os.path.join(tempfile.gettempdir(), "galley-shared")
        context.setCheckpointDir(f"{top.rstrip('/')}/checkpoints")
    return df.checkpoint()
