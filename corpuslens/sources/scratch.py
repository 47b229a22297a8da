"""Intermediate results in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def held(df: DataFrame) -> DataFrame:
    """df computed once and kept by a reliable checkpoint, its rows and partitions fixed. The folder is that of
    spark.checkpoint.dir; where that is unset, a local session (tests) gets a temporary one, and a cluster an error."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="corpuslens-"))
    return df.checkpoint(eager=True)
