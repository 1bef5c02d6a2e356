"""Uploads as a stream: every micro-batch is validated and stored as one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from terralume.operators.validate import validate
from terralume.store import persist_batch


def store_stream(reports: DataFrame, root: str, checkpoint: str, name: str = "stream", available_now: bool = True) -> StreamingQuery:
    """Duplicates are looked for in a micro-batch. A repeated micro-batch keeps its id and is stored once."""

    def store(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch_id = f"{name}-{epoch}"
        if spark.read.parquet(f"{root}/upload_batches").filter(f"batch_id = '{batch_id}'").limit(1).count() == 0:
            batch = batch.persist()
            persist_batch(spark, root, name, validate(batch), batch_id=batch_id)
            batch.unpersist()

    w = reports.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
