"""Cutting lineage: what several views read is computed once and kept in the checkpoint folder, so that plans stay small and lost executors cost no more than a read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is named and Spark runs on one machine."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_treedex_index", None)
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = sc._treedex_index = "file://" + tempfile.mkdtemp(prefix="treedex-index-")
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()
