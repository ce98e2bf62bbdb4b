"""A session of this package's own, so that what its Python workers need changes nothing for other queries."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Rows of whole texts that a Python worker gets at a time.
BATCH_ROWS = 1000
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Shuffle files go when the action that wrote them ends. What is needed later lies in checkpoints; else files stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: WeakKeyDictionary[SparkSession, SparkSession] = WeakKeyDictionary()


def own_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark``, but batches of BATCH_ROWS rows where ``spark`` has Spark's default, and no shuffle files of ended actions.

    Settings are per session, while files, caches and executors are shared; ``spark`` stays as it is.
    """
    shared_folder(spark)
    if int(spark.conf.get(ROWS)) <= BATCH_ROWS:
        return spark
    if (own := _OWN.get(spark)) is None:  # one for each, since every session has Python workers of its own
        own = _OWN[spark] = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    if int(spark.conf.get(ROWS)) == 10000:  # Spark's default
        own.conf.set(ROWS, str(BATCH_ROWS))
    own.conf.set(CLEANUP, "true")
    return own


def in_own_session(docs: DataFrame) -> DataFrame:
    """The same rows as a DataFrame of :func:`own_session`: a union with nothing, of which the optimizer leaves nothing."""
    own = own_session(docs.sparkSession)
    none = own.range(1).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema])
    return docs if own is docs.sparkSession else none.union(docs)
