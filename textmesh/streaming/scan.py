"""Scans of streams: every row is a complete text, so the scan has no state
and the batch operators apply to streaming DataFrames as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame

from textmesh.operators.scan import scan
from textmesh.plans.matcher import Matcher


def scan_stream(stream: DataFrame, matcher: Matcher, column: str, keys: list[str], sink: str, checkpoint: str):
    """Starts a query that appends the events of all available rows to Parquet
    files at `sink`, and ends; the files are written exactly once."""
    events = scan(stream, matcher, column, keys)
    return events.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
