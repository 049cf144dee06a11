"""Sensitive-content scan of pages as they come: a stateless projection, the same as in a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from paperloom.functions.patterns import Pattern
from paperloom.plans.redact import hits


def scan_stream(pages: DataFrame, patterns: list[Pattern], target: str, checkpoint: str, **options) -> StreamingQuery:
    """Append the hits of a stream of pages to a table of files; ends when what is there has been read."""
    return hits(pages, patterns, **options).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
