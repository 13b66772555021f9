"""Presentation formats of the report.

Numbers stay raw doubles through the pipeline; these helpers are applied
only in the final projection. ``format_string`` rounds half-up while
Python's ``%.1f`` rounds the exact binary value, so text can differ in rare
ties; numeric columns are the ones to compare.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from budgetlens.functions.safe import col_


def fixed(c: str | Column, decimals: int) -> Column:
    """``x`` rounded half-to-even to ``decimals`` places; the value that
    the fixed-point texts print (so the printed digits do not depend on the
    formatter's own rounding rule)."""
    return F.bround(col_(c).cast("double"), decimals)


def currency(c: str | Column, decimals: int = 2, unit: str = " Cr") -> Column:
    """``Rs. 12.34 Cr`` (F1)."""
    v = fixed(c, decimals)
    return F.when(v.isNotNull(), F.format_string(f"Rs. %.{decimals}f{unit}", v))


def pct_text(c: str | Column, decimals: int = 1) -> Column:
    """``53.4%`` (F2); NULL stays NULL."""
    v = fixed(c, decimals)
    return F.when(v.isNotNull(), F.format_string(f"%.{decimals}f%%", v))


def num_text(c: str | Column, decimals: int = 0) -> Column:
    """``5992`` (F2 without the sign); NULL stays NULL."""
    v = fixed(c, decimals)
    return F.when(v.isNotNull(), F.format_string(f"%.{decimals}f", v))


def int_text(c: str | Column) -> Column:
    """``str(int(x))``: truncation toward zero, then text."""
    return col_(c).cast("long").cast("string")


def round1(c: str | Column, decimals: int = 1) -> Column:
    """pandas ``Series.round``: half to even."""
    return F.bround(col_(c).cast("double"), decimals)


def composite_label(*parts: Column) -> Column:
    """Multi-line chart label."""
    return F.concat_ws("\n", *parts)


def period_text(d: str | Column) -> Column:
    """``March 2024``."""
    return F.date_format(col_(d), "MMMM yyyy")


def previous_month(d: str | Column) -> Column:
    """First day of the month before ``d``."""
    return F.add_months(F.trunc(col_(d), "month"), -1)


def report_id(ts: str | Column) -> Column:
    """``20240315_093000`` (F16)."""
    return F.date_format(col_(ts), "yyyyMMdd_HHmmss")


def normalise_weights(arr: str | Column) -> Column:
    """Scale an array of weights to sum to 1."""
    a = col_(arr)
    total = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), total))


def ascii_cell(c: str | Column) -> Column:
    """Table cell text: ``str(value)`` (``None`` for null) with non-ASCII runs
    removed; ``[Error]`` if the value has no text form (F18)."""
    v = col_(c)
    text = v.try_cast("string")
    cleaned = F.regexp_replace(text, r"[^\x00-\x7F]+", "")
    return F.when(v.isNull(), F.lit("None")).otherwise(F.coalesce(cleaned, F.lit("[Error]")))
