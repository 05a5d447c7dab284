"""Tables that several steps read, written once into the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """``df``, worked out and written by ``checkpoint()``: what reads it more than once doesn't compute it again, and a lost executor costs nothing.

    The folder is spark.checkpoint.dir; only a local session, which has one machine, may go without and gets a temporary one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = "file://" + tempfile.mkdtemp(prefix="posegrid-")
        context.setCheckpointDir(named)
    return df.checkpoint(eager=True)
