"""Distribution, correlation and trend operators.

Exact quantiles are computed by rank, not with the ``percentile`` aggregate:
``percentile`` keeps every distinct value of a group in one task, which a
group holding a third of all rows would not survive. Instead equal values are
counted first (the partial aggregate collapses a hot value in every task), the
distinct (group, value) pairs are range-partitioned (a hot group spreads over
many tasks), and only the slices that hold a requested rank are numbered.
``percentile_approx`` is offered for a bounded-memory sketch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from budgetlens.functions.safe import as_double, safe_corr
from budgetlens.operators.aggregate import attach_scalars

BOX_PROBS = (0.25, 0.5, 0.75)

#: Rows that one array holds when counted values are written out again.
EXPAND_CHUNK = 4096


def _counted(df: DataFrame, group: str, value: str) -> DataFrame:
    """``(g, v, c)``: the occurrences of each non-null value in each non-null group."""
    return (df.select(F.col(group).alias("g"), as_double(value).alias("v"))
              .filter(F.col("g").isNotNull() & F.col("v").isNotNull())
              .groupBy("g", "v").agg(F.count(F.lit(1)).alias("c")))


def sorted_value_counts(df: DataFrame, group: str, value: str) -> DataFrame:
    """``(g, v, c, pid)``: how often each value occurs in each group, and the
    range partition (by group, then value) that holds the pair.

    Null groups and values are left out. A repeated value is one row however
    often it occurs, so no value and no group can fill a partition. The table is
    written once to the shared checkpoint folder: all its readers see the
    same partitions, and a lost executor does not force another sort.
    """
    from budgetlens.session import materialize

    placed = _counted(df, group, value).repartitionByRange("g", "v").withColumn("pid", F.spark_partition_id())
    return materialize(placed, "value-counts")


def exact_quantiles(df: DataFrame, group: str, value: str, probs: tuple[float, ...] = BOX_PROBS,
                    counts: DataFrame | None = None) -> DataFrame:
    """``(g, n, q_0, q_1, ...)``: linear-interpolation quantiles (numpy's
    default, DuckDB's ``quantile_cont``) of ``value`` per ``group``.
    ``counts``: the output of :func:`sorted_value_counts`, if already built."""
    counts = counts if counts is not None else sorted_value_counts(df, group, value)
    # One row per (group, partition): the ranks before it and the group's size.
    by_group = Window.partitionBy("g")
    before = by_group.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    slices = (counts.groupBy("g", "pid").agg(F.sum("c").alias("slice_n"))
              .select("g", "pid", "slice_n", F.sum("slice_n").over(by_group).alias("n"),
                      F.coalesce(F.sum("slice_n").over(before), F.lit(0)).alias("first")))

    def ranks(p: float):
        h = (F.col("n") - 1) * F.lit(float(p))
        low = F.floor(h).cast("long")
        return h - low, low, F.least(low + 1, F.col("n") - 1)

    needed = F.lit(False)
    for p in probs:
        for r in ranks(p)[1:]:
            needed = needed | ((r >= F.col("first")) & (r < F.col("first") + F.col("slice_n")))
    # Only these slices are numbered: two a probability at most.
    within = Window.partitionBy("g", "pid").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    rows = (counts.join(slices.filter(needed), ["g", "pid"])
            .withColumn("end", F.col("first") + F.sum("c").over(within))
            .withColumn("start", F.col("end") - F.col("c")))

    def at(r):
        return F.max(F.when((r >= F.col("start")) & (r < F.col("end")), F.col("v")))

    picked = rows.groupBy("g", "n").agg(*[at(r).alias(f"_{side}_{i}") for i, p in enumerate(probs)
                                          for side, r in zip(("lo", "hi"), ranks(p)[1:])])
    return picked.select("g", "n", *[
        (F.col(f"_lo_{i}") + ranks(p)[0] * (F.col(f"_hi_{i}") - F.col(f"_lo_{i}"))).alias(f"q_{i}")
        for i, p in enumerate(probs)])


def approx_quantiles(df: DataFrame, group: str, value: str,
                     probs: tuple[float, ...] = BOX_PROBS, accuracy: int = 10000) -> DataFrame:
    """Same shape as :func:`exact_quantiles` from a mergeable sketch."""
    pa = F.percentile_approx(as_double(value), list(probs), accuracy)
    out = (df.filter(F.col(group).isNotNull() & F.col(value).isNotNull())
             .groupBy(F.col(group).alias("g"))
             .agg(F.count(F.lit(1)).alias("n"), pa.alias("_q")))
    return out.select("g", "n", *[F.col("_q")[i].alias(f"q_{i}") for i in range(len(probs))])


#: Size parameter of quantile sketches: a rank is off by at most about 0.4 % of the
#: rows (2.296 / k**0.9723, with 99 % confidence), also after merging.
SKETCH_K = 800


def quantile_sketches(df: DataFrame, keys: list[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """One mergeable quantile sketch for every group (A14): (keys, n, least,
    greatest, sketch), some kilobytes a row whatever the group's size. Stored by
    day, say, they give the quantiles of any range of days without the values.
    NULL and NaN values are left out; a group without values has n = 0."""
    v = F.col(f"`{value}`").cast("double")
    v = F.when(~F.isnan(v), v)
    return df.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(
        F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("greatest"),
        F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, keys: list[str], probabilities: tuple[float, ...] = (0.25, 0.5, 0.75),
                       k: int = SKETCH_K) -> DataFrame:
    """(keys, n, least, greatest, quantiles) of the merged sketches of each group;
    least and greatest are exact, quantiles are values of the data whose rank is
    near (``SKETCH_K``). Groups without values have no row."""
    own = [F.col(f"`{c}`") for c in keys]
    merged = sketches.filter("n > 0").groupBy(*own).agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    at = F.array(*[F.lit(float(p)) for p in probabilities])
    return merged.select(*own, "n", "least", "greatest", F.kll_sketch_get_quantile_double("sketch", at).alias("quantiles"))


def _fences(summary: DataFrame) -> DataFrame:
    iqr = F.col("q3") - F.col("q1")
    return summary.select("g", (F.col("q1") - 1.5 * iqr).alias("lo_fence"),
                          (F.col("q3") + 1.5 * iqr).alias("hi_fence"))


def box_summary(df: DataFrame, group: str, value: str, exact: bool = True,
                counts: DataFrame | None = None) -> DataFrame:
    """Per group: n, Q1, median, Q3, whiskers and outlier count.

    Whiskers are the most extreme values inside ``[Q1 - 1.5 IQR, Q3 + 1.5
    IQR]`` (matplotlib's rule); outliers are the values outside. In exact
    mode quantiles and whiskers come from the same written value counts
    (``counts``, if the caller has them), so the input is evaluated once.
    The join with the per-group fences is left to Catalyst, which broadcasts
    them when they are small.
    """
    if exact:
        d = counts if counts is not None else sorted_value_counts(df, group, value)
        qs = exact_quantiles(df, group, value, counts=d)
    else:
        d = _counted(df, group, value)
        qs = approx_quantiles(df, group, value)
    qs = qs.select("g", "n", F.col("q_0").alias("q1"), F.col("q_1").alias("median"),
                   F.col("q_2").alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col("v") >= F.col("q1") - 1.5 * iqr) & (F.col("v") <= F.col("q3") + 1.5 * iqr)
    # The statistics ride along, so no second join brings them back.
    stats = ("n", "q1", "median", "q3")
    return (d.select("g", "v", "c").join(qs, "g").groupBy("g", *stats)
             .agg(F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
                  F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
                  F.coalesce(F.sum(F.when(~inside, F.col("c"))), F.lit(0)).alias("n_outliers")))


def box_outliers(df: DataFrame, group: str, value: str, summary: DataFrame,
                 counts: DataFrame | None = None) -> DataFrame:
    """The outlying values themselves, one row for each occurrence:
    ``(g, v)`` (A14). ``counts`` as in :func:`box_summary`."""
    d = counts if counts is not None else _counted(df, group, value)
    out = d.join(_fences(summary), "g").filter((F.col("v") < F.col("lo_fence")) |
                                               (F.col("v") > F.col("hi_fence")))
    # A count becomes rows again in two steps, so no array is long.
    chunk = F.lit(EXPAND_CHUNK)
    parts = out.select("g", "v", F.col("c"), F.explode(F.sequence(F.lit(0), F.floor((F.col("c") - 1) / chunk)))
                       .alias("part"))
    size = F.least(chunk, F.col("c") - F.col("part") * chunk)
    return parts.select("g", "v", F.explode(F.array_repeat(F.lit(0), size.cast("int"))).alias("_")).drop("_")


def correlation_pairs(df: DataFrame, columns: list[str], names: list[str] | None = None,
                      lower_only: bool = True) -> DataFrame:
    """Pearson correlation of every pair, long form ``(var_x, var_y, corr)``
    (A15). With ``lower_only`` only pairs below the diagonal are produced,
    the heatmap's visible triangle (A16). One aggregate computes all pairs.
    """
    names = names or columns
    pairs = [(i, j) for i in range(len(columns)) for j in range(len(columns))
             if (i > j if lower_only else True)]
    aggs = [safe_corr(F.col(f"`{columns[i]}`"), F.col(f"`{columns[j]}`")).alias(f"c_{i}_{j}")
            for i, j in pairs]
    wide = df.agg(*aggs)
    stacked = F.explode(F.array(*[
        F.struct(F.lit(names[i]).alias("var_x"), F.lit(names[j]).alias("var_y"),
                 F.col(f"c_{i}_{j}").alias("corr"))
        for i, j in pairs]))
    return wide.select(stacked.alias("p")).select("p.var_x", "p.var_y", "p.corr")


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``(slope, intercept)`` of the least-squares line y = a x + b
    (A17), NULL for a constant x."""
    return df.agg(F.regr_slope(as_double(y), as_double(x)).alias("slope"),
                  F.regr_intercept(as_double(y), as_double(x)).alias("intercept"))


def with_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Fitted value and residual per row (A18); the one-row fit is read as a
    scalar subquery."""
    fit = linear_fit(df, x, y)
    out = attach_scalars(df, fit)
    trend = F.col("slope") * as_double(x) + F.col("intercept")
    return out.withColumn("trend", trend).withColumn("residual", as_double(y) - F.col("trend"))

