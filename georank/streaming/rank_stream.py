"""Ranking of a stream of candidate rows: the batch expressions on each micro-batch, appended as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from georank.operators.rank import rank
from georank.settings import Settings


def rank_stream(candidates: DataFrame, out: str, checkpoint: str, mode: str = "public", zones: DataFrame | None = None, settings: Settings | None = None) -> StreamingQuery:
    """Start ranking a streaming DataFrame of candidates; each batch is written once, under its id, so a retry replaces it.

    zones is a table of red zones, which withhold rows as in a batch.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rank(batch, mode, zones, settings).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return candidates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
