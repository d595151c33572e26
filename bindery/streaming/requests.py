"""Answers a stream of requests with the batch operator: each micro-batch of requests is a small table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from bindery.operators.recommend import gallery, recommend_batch


def answer_stream(requests: DataFrame, index: DataFrame, catalogue: DataFrame, path: str, checkpoint: str, present: Callable[[DataFrame], DataFrame] | None = None, **limits) -> StreamingQuery:
    """Append (query_id, pos, large_thumbnail, caption), or what ``present`` makes of the recommendations, to Parquet under
    ``path``, one folder for each micro-batch, so that a batch that runs again after a failure replaces its own answers."""

    def answer(batch: DataFrame, number: int) -> None:
        found = recommend_batch(index, catalogue, batch, **limits)
        out = present(found) if present else gallery(found, "query_id", "pos")
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

