"""Linking new source records as they come (beyond the reference): the batch transforms on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkmill.operators import blocking
from linkmill.operators.assignment import baseline
from linkmill.operators.records import normalize_records


def link_batch(reference: DataFrame, batch: DataFrame, threshold: float = 1.0) -> DataFrame:
    """s1_id, cand_id, rscore of one batch of raw records against the normalised reference side."""
    found = blocking.generate_candidates(reference, normalize_records(batch), similar=blocking.plain_similarity)
    return baseline(found.select(F.col("q").alias("s1_id"), F.col("t").alias("cand_id"), "rscore"), threshold)


def link_stream(reference: DataFrame, stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, threshold: float = 1.0) -> StreamingQuery:
    """Each record has one owner at most and is decided in its own batch, so batches do not depend on one another;
    list caps hold per batch. ``sink`` gets a batch's links and its number, and should write idempotently."""

    def step(batch: DataFrame, number: int) -> None:
        sink(link_batch(reference, batch.dropDuplicates(["entity_id"]), threshold), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
