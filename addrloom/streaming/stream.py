"""Resolving a stream of addresses: the batch plan on each micro-batch."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from addrloom.plans import resolve as plan


def resolve_stream(addresses: DataFrame, gaz: plan.Gazetteer, today: date, output: str, checkpoint: str, poi: DataFrame | None = None) -> StreamingQuery:
    """Write each micro-batch's results as Parquet to ``output``/batch=<id>; a batch that runs again replaces its own folder.

    Ranks are taken within an address, so batches do not depend on each other.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        plan.resolve(batch, gaz, today, poi).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return addresses.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
