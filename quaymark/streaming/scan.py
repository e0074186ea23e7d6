"""Detection as a stream: rows are scanned as they arrive, with the batch detectors' own plans.

Rules are a narrow transformation and stream as they are. Entropy hits are suppressed on flagged lines and reduced to one
per line; both need only one file's rows, which arrive together, so each micro-batch is scanned whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quaymark.operators import detect


def rule_findings(contents: DataFrame) -> DataFrame:
    """Rule findings of a streaming DataFrame of contents."""
    return detect.secrets(contents)


def counted(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes", *keys: str) -> DataFrame:
    """Events per window and key, closed once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def scan_into(contents: DataFrame, path: str, checkpoint: str, threshold: float = 4.5, once: bool = False) -> StreamingQuery:
    """Scans arriving contents into a table of findings; a batch that runs again replaces its own part."""

    def write(batch: DataFrame, number: int) -> None:
        detect.scan(batch, threshold).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = contents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
