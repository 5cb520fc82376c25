"""Cutting lineage where a result is read several times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Only where that is unset and Spark runs on this machine alone, as in tests, a folder of this machine is used.
    """
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def cut(rows: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the session's folder, so that a lost executor loses none."""
    cut_folder(rows.sparkSession)
    return rows.checkpoint()
