"""Stored summary rows (``Total``) and how each operator treats them.

The departmental files carry a ``Total`` row that the reference sometimes
sums with the data (doubling sums), sometimes drops, and sometimes uses as
the answer. Every operator here takes ``totals``:

* ``'exclude'`` (default): summary rows are removed before aggregating.
* ``'as_is'``: rows are used as stored, which reproduces the reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOTAL = "Total"
TOTALS_MODES = ("exclude", "as_is")


def check_mode(totals: str) -> str:
    if totals not in TOTALS_MODES:
        raise ValueError(f"totals must be one of {TOTALS_MODES}, not {totals!r}")
    return totals


def is_summary(key: str | Column, marker: str = TOTAL) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return k.eqNullSafe(F.lit(marker))


def apply_totals(df: DataFrame, key: str, totals: str = "exclude",
                 marker: str = TOTAL) -> DataFrame:
    """Drop summary rows (null-safe: rows with a NULL key stay)."""
    if check_mode(totals) == "as_is":
        return df
    return df.filter(~is_summary(key, marker))


def has_summary(key: str, marker: str = TOTAL) -> Column:
    """Aggregate: does any row carry the summary marker?"""
    return F.max(is_summary(key, marker).cast("int")) == 1


def summary_or_sum(key: str, measure: str, order: str = "ord",
                   marker: str = TOTAL) -> Column:
    """Aggregate: the stored summary value when a summary row exists (the
    first one in file order), else the sum of the rows (A19)."""
    stored = F.min_by(F.col(measure), F.when(is_summary(key, marker), F.col(order)))
    return F.when(has_summary(key, marker), stored).otherwise(F.sum(F.col(measure)))


def with_rollup_total(df: DataFrame, key: str, aggs: list[Column],
                      marker: str = TOTAL) -> DataFrame:
    """Group by ``key`` and append the grand-total row labelled ``marker``
    (``GROUP BY ROLLUP``); a NULL group key stays NULL (A19)."""
    out = df.rollup(key).agg(*aggs, F.grouping(key).alias("_is_total"))
    label = F.when(F.col("_is_total") == 1, F.lit(marker)).otherwise(F.col(key))
    return out.withColumn(key, label).drop("_is_total")
