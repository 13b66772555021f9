"""Report sinks (S12, S13): the ordered blocks and the chart data as
tables, plus the rendered Markdown, keyed by a timestamped report id."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetlens.functions.fmt import report_id


def new_report_id(spark) -> str:
    """``yyyyMMdd_HHmmss`` of the session's current time (F16)."""
    return spark.range(1).select(report_id(F.current_timestamp()).alias("id")).first().id


def write_report(blocks: DataFrame, markdown: DataFrame, root: str, rid: str) -> None:
    """Blocks as JSON lines partitioned by report id, Markdown as text;
    directories are created as needed (S12)."""
    (blocks.withColumn("report_id", F.lit(rid)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("report_id")
        .json(os.path.join(root, "blocks")))
    markdown.coalesce(1).write.mode("overwrite").text(os.path.join(root, "markdown", f"report_id={rid}"))


def write_chart_data(charts: dict[str, DataFrame], root: str, rid: str) -> None:
    """Each chart's tidy data as its own Parquet table."""
    for name, df in charts.items():
        df.write.mode("overwrite").parquet(os.path.join(root, "chart_data", name, f"report_id={rid}"))
