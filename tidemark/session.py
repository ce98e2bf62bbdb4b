"""The session that the warehouse's own jobs use."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints. Where it names none, a local session gets a new one;
    a cluster is refused, since its machines share no folder that could be guessed."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skewed-join splitting, and the RocksDB state store for streams.

    Facts read single keys of the maps that change data comes in; with inlined projections the optimizer replaces such
    a lookup by the value itself where an adapter has built the map. Nothing here sizes partitions: adaptive execution merges and splits them by what was written.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.optimizer.collapseProjectAlwaysInline": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    builder = SparkSession.builder.appName(app).config(map=settings)
    return (builder.master(master) if master else builder).getOrCreate()
