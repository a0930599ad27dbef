"""A continuous upsert: the newest version of each key as a streaming aggregate."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.operators import resolve
from keystrata.plans.store import Store

#: State is kept on the executors' disks and in the checkpoint, not in their heaps: it grows with the keys.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ["key", "value", "expiry_ns", "is_deleted", "seq"]


def newest(stream: DataFrame) -> DataFrame:
    """One state row a key; expiry stays in the state and is applied on reading, since a newer version may come."""
    version = F.struct(*(c for c in COLUMNS if c != "key"))
    return stream.groupBy("key").agg(F.max_by(version, F.col("seq")).alias("v")).select("key", "v.*")


def run_upsert(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Takes in all that is there; every batch's changed keys are written to ``folder``. Restarts from its checkpoint."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ON_DISK)
    try:
        query = newest(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    finally:
        conf.set(PROVIDER, before)
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))


def ingest(stream: DataFrame, store: Store, checkpoint: str) -> None:
    """Appends all that is there to a store, a commit a micro-batch; ``maxFilesPerTrigger`` of the reader bounds one.

    A batch that is repeated after a failure appends the same versions again, which leaves the state as it is.
    """
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, number: store.append(batch) and None).start()
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))


def read_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The newest of all that the batches wrote."""
    return resolve.latest(spark.read.parquet(folder).select(*COLUMNS))


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint
    folder; a temporary one only with a local master, where all are one process."""
    import re
    import tempfile

    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="keystrata-")
    return f"{top.rstrip('/')}/{label}-{uuid.uuid4().hex}"
