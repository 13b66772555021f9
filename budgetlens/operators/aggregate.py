"""Grouped and global aggregates.

All grouped aggregates are hash aggregates with a map-side partial step, so
a hot group key is collapsed to one row per task before the shuffle.
Scalars that must meet every row (a maximum, a grand total) are computed as
a one-row aggregate and attached as a scalar subquery: the aggregate runs
once (partial aggregates meet in one task, rows never do) and its value is
read by the projection, with no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from budgetlens.functions.safe import (as_double, exact_total, guarded_pct, money_sum, row_pct,
                                       units_to_double)

AGG_FUNCS = {
    "sum": F.sum,
    "avg": F.avg,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
}


def agg_map(spec: dict[str, str]) -> list[Column]:
    """``{'Budget Allocated': 'sum'}`` -> aliased aggregate columns; the
    pandas ``agg({...})`` plug point (section 2.11)."""
    out = []
    for measure, fn in spec.items():
        if fn not in AGG_FUNCS:
            raise ValueError(f"unsupported aggregate {fn!r}")
        out.append(AGG_FUNCS[fn](F.col(f"`{measure}`")).alias(measure))
    return out


def group_utilization(df: DataFrame, key: str, allocated: str, utilized: str,
                      out_key: str = None, scales: tuple[int, int] | None = None) -> DataFrame:
    """Per-group allocated / utilized sums and utilization % (A1, A2).

    Null keys are dropped (pandas ``groupby`` does the same); money is
    summed exactly and returned as DOUBLE. With ``scales`` the two columns
    hold exact integer units of ``10**-scale`` (pre-aggregated facts);
    otherwise they are values whose sum is exact to ``MONEY_SCALE`` decimals.
    """
    out_key = out_key or key

    def exact(c: str, scale: int | None) -> Column:
        if scale is not None:
            return units_to_double(F.coalesce(F.sum(F.col(f"`{c}`")), F.lit(0).cast("decimal(18,0)")), scale)
        if isinstance(df.schema[c].dataType, DecimalType):
            return as_double(F.coalesce(F.sum(F.col(f"`{c}`")), F.lit(0).cast(df.schema[c].dataType)))
        return as_double(money_sum(F.col(f"`{c}`")))

    sa, su = scales if scales else (None, None)
    g = (df.filter(F.col(f"`{key}`").isNotNull())
           .groupBy(F.col(f"`{key}`").alias(out_key))
           .agg(exact(allocated, sa).alias("allocated"), exact(utilized, su).alias("utilized")))
    return g.select(out_key, "allocated", "utilized",
                    guarded_pct("utilized", "allocated").alias("utilization_pct"))


def argmax_key(key: str, measure: str, tie: str = "ord") -> Column:
    """Aggregate: the key at the largest measure (A6). On ties the row with
    the smallest ``tie`` wins: the file position ``ord`` gives pandas'
    ``idxmax`` (first row); a name gives an alphabetical choice."""
    m = F.col(f"`{measure}`")
    rank = F.when(m.isNotNull(), F.struct((-m).alias("_neg"), F.col(f"`{tie}`").alias("_tie")))
    return F.min_by(F.col(f"`{key}`"), rank)


def scalar_row(one_row: DataFrame) -> Column:
    """A one-row frame (a global aggregate) as a struct-valued scalar
    subquery: it runs once, its value is injected into the consuming
    projection, and no join is planned."""
    return one_row.select(F.struct(*[F.col(f"`{c}`") for c in one_row.columns]).alias("_s")).scalar()


def attach_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row
    through a scalar subquery (no cross join, no single-partition window)."""
    # Two projections: the subquery is planned once, not once per column.
    step = df.select("*", scalar_row(scalars).alias("_s"))
    return step.withColumns({c: F.col("_s")[c] for c in scalars.columns}).drop("_s")


def normalise_to_max(df: DataFrame, measures: dict[str, str],
                     group: list[str] | None = None) -> DataFrame:
    """``out = measure / max(measure) * 100`` for each ``{measure: out}``
    (A11, W2), over the whole frame or per ``group``.

    The maxima are an aggregate, not a window: a window partitioned by the
    group would move each group, however large, into one task. Per-group
    maxima are joined back on the group key (Catalyst broadcasts them when
    they are small)."""
    aggs = [F.max(as_double(m)).alias(f"_max_{i}") for i, m in enumerate(measures)]
    if group:
        maxes = df.groupBy(*group).agg(*aggs)
        joined = df.join(maxes, group)
    else:
        joined = attach_scalars(df, df.agg(*aggs))
    for i, (m, out) in enumerate(measures.items()):
        joined = joined.withColumn(out, row_pct(as_double(m), F.col(f"_max_{i}")))
    return joined.drop(*[f"_max_{i}" for i in range(len(measures))])


def share_of_total(df: DataFrame, measure: str, out: str = "share_pct") -> DataFrame:
    """Each row's share of the column total, in percent."""
    total = df.agg(exact_total(measure).alias("_total"))
    return attach_scalars(df, total).withColumn(out, row_pct(as_double(measure), "_total")).drop("_total")


def distinct_values(df: DataFrame, c: str) -> DataFrame:
    """Distinct non-null values of a column."""
    return df.select(c).filter(F.col(c).isNotNull()).distinct()
