"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetlens.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that an edge (u, v) touches; root is the
    smallest node of its component. Nodes are longs; null and self edges are
    ignored; an empty edge table gives an empty result.

    Each round points the larger neighbours of a node at its smallest one
    (large star), then all smaller-or-equal neighbours (small star). Only
    minima are aggregated, so a hub with very many neighbours is reduced
    before its shuffle, and the join that hands the minimum back is one that
    AQE can split. A round's edges are written to the shared folder; the loop
    ends when a round leaves count and checksum unchanged.
    """
    cur = edges.filter("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    cur = stored(cur, "components")
    seen = _mark(cur)
    while seen[0]:
        both = cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.filter("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(low.select("u", F.col("m").alias("v")))
                 .filter("u <> v").distinct())
        cur = stored(small, "components")
        now = _mark(cur)
        if now == seen:
            break
        seen = now
    leaves = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return leaves.unionAll(roots)


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"),
                    F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return row["n"], row["x"] or 0
