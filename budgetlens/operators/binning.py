"""Right-closed binning ``(lo, hi]`` and counts per bin.

``Bucketizer`` and ``width_bucket`` are left-closed, so bins are assigned
with one CASE expression (a projection, no join). Counting is a grouped
aggregate on the bin ordinal (partial aggregation collapses a hot bin
before the shuffle), right-joined to the bin table so that empty bins are
kept with 0, as pandas does for categoricals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from budgetlens.functions.safe import as_double, row_pct
from budgetlens.operators.aggregate import attach_scalars
from budgetlens.session import materialize


@dataclass(frozen=True)
class Bins:
    edges: tuple[float, ...]
    labels: tuple[str, ...]

    def __post_init__(self):
        if len(self.edges) != len(self.labels) + 1:
            raise ValueError("need one more edge than labels")
        if list(self.edges) != sorted(self.edges):
            raise ValueError("edges must increase")

    def rows(self):
        return [(i, lab, float(self.edges[i]), float(self.edges[i + 1]))
                for i, lab in enumerate(self.labels)]

    def table(self, spark: SparkSession) -> DataFrame:
        """``(bin_ord, bin, lo, hi)``: a handful of rows given as parameters."""
        return spark.createDataFrame(self.rows(), "bin_ord int, bin string, lo double, hi double")

    def ordinal(self, x: str | Column) -> Column:
        """0-based bin of ``x`` with ``lo < x <= hi``; NULL outside all bins."""
        v = as_double(x)
        expr = None
        for i, _, lo, hi in self.rows():
            cond = (v > F.lit(lo)) & (v <= F.lit(hi))
            expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
        return expr

    def label(self, x: str | Column) -> Column:
        v = as_double(x)
        expr = None
        for _, lab, lo, hi in self.rows():
            cond = (v > F.lit(lo)) & (v <= F.lit(hi))
            expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
        return expr


# The reference's two binnings.
COMPLETION_BINS = Bins((0, 25, 50, 75, 100), ("0-25%", "26-50%", "51-75%", "76-100%"))
IMPLEMENTATION_BINS = Bins((0, 55, 70, 85, 100),
                           ("Low (<=55%)", "Medium (56-70%)", "High (71-85%)", "Very High (>85%)"))


def assign_bins(df: DataFrame, x: str, bins: Bins) -> DataFrame:
    """Add ``bin_ord`` and ``bin``."""
    return df.withColumn("bin_ord", bins.ordinal(x)).withColumn("bin", bins.label(x))


def count_per_bin(df: DataFrame, x: str, bins: Bins) -> DataFrame:
    """``(bin_ord, bin, n, share_pct)`` for every bin, empty ones included,
    in bin order (A7, A8, A9). Values outside every bin are not counted."""
    spark = df.sparkSession
    counts = (df.select(bins.ordinal(x).alias("bin_ord"))
                .filter(F.col("bin_ord").isNotNull())
                .groupBy("bin_ord").agg(F.count(F.lit(1)).alias("n")))
    table = bins.table(spark).select("bin_ord", "bin")
    full = table.join(counts, "bin_ord", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    total = full.agg(F.sum("n").alias("_total"))
    out = attach_scalars(full, total).withColumn("share_pct", row_pct("n", "_total"))
    return out.select("bin_ord", "bin", "n", "share_pct").orderBy("bin_ord")


def count_outside(df: DataFrame, x: str, bins: Bins) -> DataFrame:
    """One row ``(n_below, n_above, n_null)``: what :func:`count_per_bin` leaves
    uncounted."""
    v = as_double(x)
    return df.agg(F.count_if(v <= F.lit(float(bins.edges[0]))).alias("n_below"),
                  F.count_if(v > F.lit(float(bins.edges[-1]))).alias("n_above"),
                  F.count_if(v.isNull()).alias("n_null"))


def sums_by_bin_table(df: DataFrame, x: str, bins: DataFrame, sums: dict[str, Column] | None = None,
                      lo: str = "lo", hi: str = "hi") -> DataFrame:
    """J3 with the bins in a table of any size: one row per bin (lo, hi], with the
    number ``n`` of rows whose ``x`` it holds and the given sums (NULL if empty).

    Bins must not overlap; gaps between them are allowed, what they hold and NULL
    or NaN values belong to no bin. Rows are added up by value first, so a hot
    value is one row; values and lower edges are then dealt together into ranges
    and written once, and a value takes the last lower edge below it, within its
    range or, from one row a range, before it. So there is no theta join, and no
    task holds more than its range. An empty bin table gives an empty result."""
    spark = df.sparkSession
    sums = sums or {}
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    value = F.col(f"`{x}`").cast("double")
    per = df.filter(value.isNotNull() & ~F.isnan(value)).groupBy(value.alias("_x")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
    edges = bins.select(F.col(f"`{lo}`").cast("double").alias("_lo"), F.col(f"`{hi}`").cast("double").alias("_hi"))
    # At equal places a value comes before an edge: bins are open below.
    events = per.withColumn("_edge", F.lit(0)).unionByName(
        edges.select(F.col("_lo").alias("_x"), F.lit(1).alias("_edge"), F.struct("_lo", "_hi").alias("_bin")),
        allowMissingColumns=True)
    held = materialize(events.repartitionByRange(n, "_x", "_edge").withColumn("_part", F.spark_partition_id()), "bin-ranges")
    last, before = None, []
    found = {r["_part"]: r["bin"] for r in held.filter("_edge = 1").groupBy("_part").agg(
        F.max(F.col("_bin")).alias("bin")).collect()}  # a row a range
    for part in range(n):
        before.append(last)
        last = found.get(part, last)
    carried = F.array(*[F.lit(None).cast("struct<_lo:double,_hi:double>") if b is None else
                        F.struct(F.lit(b["_lo"]).alias("_lo"), F.lit(b["_hi"]).alias("_hi")) for b in before])
    run = Window.partitionBy("_part").orderBy("_x", "_edge").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = held.withColumn("_in", F.coalesce(F.last("_bin", ignorenulls=True).over(run), carried[F.col("_part")]))
    inside = placed.filter((F.col("_edge") == 0) & (F.col("_x") <= F.col("_in._hi"))).groupBy(
        F.col("_in._lo").alias("_at")).agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in sums])
    return edges.join(inside, F.col("_lo") == F.col("_at"), "left").select(
        F.col("_lo").alias(lo), F.col("_hi").alias(hi), F.coalesce("n", F.lit(0)).alias("n"), *sums)
