"""Cutting the lineage of driver loops."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the cluster names; one of our own only on a local master, as in tests."""
    session = df.sparkSession
    context = session.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = session.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a folder that driver and executors share is needed")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tastemill-"))
    return df.checkpoint()
