"""Series helpers: positional drops and guarded lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from budgetlens.operators.aggregate import attach_scalars


def drop_last(df: DataFrame, order: str, small: bool = False) -> DataFrame:
    """Drop the row with the largest ``order`` (``df[:-1]``) (P5).

    By default the maximum is a one-row aggregate read as a scalar
    subquery, so no row is moved to a single partition. ``small=True`` is for inputs that
    are already aggregated series (one row per period): a window over them
    reads the input once instead of twice.
    """
    if small:
        last = F.max(order).over(Window.partitionBy())
        return df.withColumn("_last", last).filter(F.col(order) < F.col("_last")).drop("_last")
    last = df.agg(F.max(order).alias("_last"))
    return attach_scalars(df, last).filter(F.col(order) < F.col("_last")).drop("_last")


def drop_last_if_summary(df: DataFrame, key: str, order: str, marker: str = "Total",
                         small: bool = False) -> DataFrame:
    """Drop the last row by position only when a summary row exists (the
    reference's ``s[:-1] if 'Total' in keys else s``) (P5 + P6). ``small``
    as in :func:`drop_last`."""
    last = F.max(order)
    is_summary = F.max((F.col(key) == F.lit(marker)).cast("int"))
    if small:
        w = Window.partitionBy()
        out = df.withColumn("_last", last.over(w)) \
                .withColumn("_has", F.coalesce(is_summary.over(w), F.lit(0)))
    else:
        facts = df.agg(last.alias("_last"), F.coalesce(is_summary, F.lit(0)).alias("_has"))
        out = attach_scalars(df, facts)
    return out.filter((F.col("_has") == 0) | (F.col(order) < F.col("_last"))).drop("_last", "_has")


def in_period(month: str, start: str | None = None, end: str | None = None,
              fmt: str = "MMM-yyyy", keep_unparsed: bool = True) -> Column:
    """Predicate: the month text (``Apr-2023``) falls in ``[start, end]``
    (``yyyy-MM-dd`` dates, compared on the month's first day). Rows whose
    key is not a month (a ``Total`` row) are kept when ``keep_unparsed``
    (the totals policy decides about them)."""
    d = F.try_to_date(F.col(month), fmt)
    cond = F.lit(True)
    if start:
        cond = cond & (d >= F.trunc(F.to_date(F.lit(start)), "month"))
    if end:
        cond = cond & (d <= F.to_date(F.lit(end)))
    return (d.isNull() & F.lit(keep_unparsed)) | (d.isNotNull() & cond)


def contains_value(c: str, value) -> Column:
    """Aggregate: does the column hold ``value``?"""
    return F.coalesce(F.max((F.col(c) == F.lit(value)).cast("int")), F.lit(0)) == 1


def lookup_first(key: str, value: str, wanted, order: str = "ord",
                 missing: str = "N/A") -> Column:
    """Aggregate: text of ``value`` on the first row (by ``order``) whose
    ``key`` equals ``wanted``; ``missing`` when there is none (P7)."""
    hit = F.min_by(F.col(f"`{value}`"), F.when(F.col(f"`{key}`") == F.lit(wanted), F.col(order)))
    return F.coalesce(hit.cast("string"), F.lit(missing))
