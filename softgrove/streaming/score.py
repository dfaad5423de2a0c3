"""Score a stream with a fitted model.

Scoring is a projection without state, so a model scores a stream as it scores a
table; no watermark is needed and any output mode works.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(stream: DataFrame, model, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append scored rows to a Parquet folder, exactly once per input row."""
    writer = (
        model.transform(stream).writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    return writer.trigger(**(trigger or {"availableNow": True})).start()
