"""Ingest and streaming queries on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame

from budgetlens.sources.catalog import file_catalog
from budgetlens.streaming.activity import activity_windows, events_ingest


def table_files(spark, sf_dir) -> DataFrame:
    """Q23: the catalogue of the table files (metadata only)."""
    c = file_catalog(spark, sf_dir, "*.parquet")
    return c.select("name", "extension", "content_type", "size_bytes", "size_text")


def activity_windows_stream(spark, sf_dir) -> DataFrame:
    """R2: daily windows per event type from a stream over events."""
    return activity_windows(spark, sf_dir)


def events_bronze(spark, sf_dir) -> DataFrame:
    """Events ingested incrementally into bronze, summarised."""
    return events_ingest(spark, sf_dir)


QUERIES = {
    "activity_windows_stream": activity_windows_stream,
    "events_bronze": events_bronze,
}
