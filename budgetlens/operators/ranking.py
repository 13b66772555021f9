"""Ordering, top-k and ordinal operators.

Top-k uses ``orderBy(...).limit(k)``, which Spark plans as
``TakeOrderedAndProject``: every task keeps its k best rows and only
k x tasks rows meet at the end, so no full sort is done. A window without a
partition key only runs over such bounded results; ordinals over whole tables
are numbered range by range (``dense_ordinals``).
Every ordering carries an explicit tie-break so results are deterministic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from budgetlens.session import materialize


def order_cols(spec: list[tuple[str, str]]) -> list[Column]:
    """``[('impl', 'desc'), ('name', 'asc')]`` -> sort columns, nulls last
    (pandas ``sort_values`` puts missing values last either way)."""
    out = []
    for name, direction in spec:
        c = F.col(f"`{name}`")
        out.append(c.desc_nulls_last() if direction == "desc" else c.asc_nulls_last())
    return out


def top_k(df: DataFrame, spec: list[tuple[str, str]], k: int) -> DataFrame:
    """The first ``k`` rows by ``spec``."""
    return df.orderBy(*order_cols(spec)).limit(k)


def with_rank(small: DataFrame, spec: list[tuple[str, str]], out: str = "rn") -> DataFrame:
    """1-based ordinal by ``spec`` (W1). Only for bounded inputs (a top-k, an
    aggregated series): the window has no partition key."""
    return small.withColumn(out, F.row_number().over(Window.orderBy(*order_cols(spec))).cast("long"))


def dense_ordinals(df: DataFrame, spec: list[tuple[str, str]], out: str = "rn",
                   partitions: int | None = None) -> DataFrame:
    """1-based ordinals by ``spec`` over input of any size (W1): rows are dealt
    into ranges of the order and written once, the ranges are counted (one row
    each), and a row's ordinal is the number of rows in earlier ranges plus its
    place in its own. No task sees more than its range.

    Rows that agree in ``spec`` are ordered by the hash of all their columns, so
    the ordinals are the same on every run but for rows that agree in all; such
    rows are spread over ranges too, however many they are. Columns must not be
    maps."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])) \
        .withColumn("_row", F.monotonically_increasing_id())
    order = [*order_cols(spec), F.col("_tie"), F.col("_row")]
    held = materialize(keyed.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ordinals")
    before, offsets = 0, [0] * n
    for r in held.groupBy("_part").count().orderBy("_part").collect():  # a row a range
        offsets[r["_part"]] = before
        before += r["count"]
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    offset = F.array(*[F.lit(o).cast("long") for o in offsets])[F.col("_part")]
    return held.withColumn(out, offset + place).select(*df.columns, out)


def top_k_ranked(df: DataFrame, spec: list[tuple[str, str]], k: int, out: str = "rn") -> DataFrame:
    return with_rank(top_k(df, spec, k), spec, out)


def flag_top_k(df: DataFrame, key: str, spec: list[tuple[str, str]], k: int,
               out: str = "is_top") -> DataFrame:
    """Mark exactly the first ``k`` rows by ``spec`` (T3 labels); rows, not
    keys: a key may occur several times. Rows that agree in the key and in all
    sort columns are numbered, and as many of them are marked as the top ``k``
    holds. The broadcast side has at most ``k`` rows."""
    names = list(dict.fromkeys([key, *(name for name, _ in spec)]))
    top = top_k(df, spec, k).groupBy(*[F.col(f"`{c}`").alias(f"_t{i}") for i, c in enumerate(names)]) \
        .agg(F.count(F.lit(1)).alias("_marked"))
    alike = Window.partitionBy(*[F.col(f"`{c}`") for c in names]).orderBy(F.lit(0))
    numbered = df.withColumn("_nth", F.row_number().over(alike))
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"_t{i}")) for i, c in enumerate(names)]
    return numbered.join(F.broadcast(top), same, "left") \
        .withColumn(out, F.coalesce(F.col("_nth") <= F.col("_marked"), F.lit(False))) \
        .select(*df.columns, out)


def close_polygon(ranked: DataFrame, rn: str = "rn", n: str | None = None) -> DataFrame:
    """Repeat the first point after the last one (W3); the repeated row gets
    ordinal n + 1. ``n`` names a column holding the number of points; without
    it the count comes from a window over the (bounded, top-k) input. The
    input is read once: the first row is emitted twice by an explode."""
    src = ranked if n else ranked.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    n_col = F.col(n) if n else F.col("_n")
    copies = F.when(F.col(rn) == 1, F.array(F.col(rn), n_col + 1)).otherwise(F.array(F.col(rn)))
    out = src.select("*", F.explode(copies).alias("_rn")).drop(rn).withColumnRenamed("_rn", rn)
    return out.select(*ranked.columns)


def radar_angle(rn: str = "rn", n: str = "n_points") -> Column:
    """Angle ``2 pi (rn - 1) / n`` of point ``rn`` among ``n``."""
    return F.lit(2 * math.pi) * (F.col(rn) - 1) / F.col(n)


def every_nth(rn: str = "rn", step: int = 2) -> Column:
    """True on rows 1, 1 + step, ... (P14: label every other point)."""
    return ((F.col(rn) - 1) % step) == 0
