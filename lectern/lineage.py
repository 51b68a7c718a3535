"""Cutting the lineage of iterative plans so that lost executors can be survived."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint of ``df`` in the folder all executors share.

    The session's ``spark.checkpoint.dir`` is used when set.  Otherwise a local run gets a temporary
    folder and a cluster the warehouse, which it shares by definition.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        conf = df.sparkSession.conf
        shared = conf.get("spark.checkpoint.dir", None)
        if shared is None and context.master.startswith("local["):
            shared = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(shared or conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return df.checkpoint(eager=True)
