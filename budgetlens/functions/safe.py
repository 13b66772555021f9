"""Null- and zero-safe arithmetic (Spark 4 runs with ANSI mode on).

The reference guards some divisions (returning 0) and leaves others
unguarded (pandas yields inf/NaN). Under ANSI a plain division by zero
throws, so both flavours are expressed with explicit semantics.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimals that sums of money given as doubles keep.
MONEY_SCALE = 6


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money_sum(c: str | Column, scale: int = MONEY_SCALE) -> Column:
    """Order-independent sum of a money column, exact to ``scale`` decimals; an
    empty or all-null group gives 0."""
    kind = f"decimal(38,{scale})"
    return F.coalesce(F.sum(col_(c).cast(kind)), F.lit(0).cast(kind))


def as_double(c: str | Column) -> Column:
    return col_(c).cast("double")


def guarded_pct(num: str | Column, den: str | Column) -> Column:
    """``num / den * 100`` when ``den > 0``, else 0 (the reference's guard)."""
    n, d = as_double(num), as_double(den)
    return F.when(d > 0, F.try_divide(n, d) * F.lit(100.0)).otherwise(F.lit(0.0))


def row_pct(num: str | Column, den: str | Column) -> Column:
    """Unguarded percentage: NULL where the denominator is 0 or NULL."""
    return F.try_divide(as_double(num), as_double(den)) * F.lit(100.0)


def sum_or_zero(c: str | Column) -> Column:
    """pandas sums skip nulls and give 0 for an all-null group; Spark gives
    NULL, hence the coalesce."""
    return F.coalesce(F.sum(col_(c)), F.lit(0))


def pairwise(a: str | Column, b: str | Column) -> tuple[Column, Column]:
    """Both values where both are non-null, else both NULL."""
    x, y = as_double(a), as_double(b)
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def safe_corr(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation over pairwise-complete rows; NULL for a constant
    column (``corr`` itself raises DIVIDE_BY_ZERO under ANSI)."""
    x, y = pairwise(a, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def exact_total(c: str | Column, scale: int = MONEY_SCALE) -> Column:
    """Order-independent sum of a DOUBLE column whose values carry at most
    ``scale`` decimals (money and its products): summed as DECIMAL, so the
    result does not depend on how rows are spread over tasks."""
    return F.sum(col_(c).cast(f"decimal(38,{scale})")).cast("double")


def cents(c: str | Column, scale: int = 2) -> Column:
    """A DOUBLE with at most ``scale`` decimals as an exact integer count of
    ``10**-scale`` units (``rint`` snaps the binary representation back to
    the integer it stands for)."""
    return F.rint(col_(c) * F.lit(float(10 ** scale))).cast("long")


def units_sum(c: Column) -> Column:
    """Exact sum of integer units. Summed as DECIMAL(18,0): additions stay
    on Spark's long-backed fast path and widen (instead of overflowing) when
    a group's total passes 18 digits."""
    return F.sum(c.cast("decimal(18,0)"))


def units_to_double(c: str | Column, scale: int) -> Column:
    """Integer units -> DOUBLE value: exact integer divided by ``10**scale``,
    the correctly rounded double of the decimal value up to 2**53 units, within
    one unit in the last place beyond."""
    return col_(c).cast("double") / F.lit(float(10 ** scale))
