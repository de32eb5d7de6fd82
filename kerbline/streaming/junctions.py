"""Junction reports that follow arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kerbline.operators.junction_state import JunctionState

MERGE_EVERY = 20  # batches


def follow(stream: DataFrame, folder: str, state_path: str, merge_every: int = MERGE_EVERY) -> StreamingQuery:
    """Apply every batch of a stream of scored tickets to the state in ``folder``.

    The stream may hand a batch over again after a failure; its number is the same, so nothing counts twice.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        state = JunctionState(batch.sparkSession, folder)
        state.apply(batch_id, batch)
        if batch_id % merge_every == merge_every - 1:
            state.merge()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", state_path).trigger(availableNow=True).start()
