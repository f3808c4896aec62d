"""Micro-batch matching of arriving records against a static pool."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import block, features


def match_stream(arrivals: DataFrame, pool: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **fit: float) -> StreamingQuery:
    """Block each micro-batch of s1 records against the pool and hand its features to ``sink(df, batch_id)``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        pairs = block.candidates(batch, pool, **fit)
        sink(features.features(features.attributes(pairs, batch, pool)), batch_id)

    return arrivals.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
