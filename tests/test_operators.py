"""Operator edge cases: zero denominators, constant columns, empty bins,
all-null groups, ties, skewed groups for the exact quantiles."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from budgetlens.functions import fmt, safe
from budgetlens.operators import aggregate, binning, ranking, series, stats, totals


def test_guarded_and_row_pct(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0), (None, 2.0)], "n double, d double")
    rows = df.select(safe.guarded_pct("n", "d").alias("g"), safe.row_pct("n", "d").alias("r")).collect()
    assert [(r.g, r.r) for r in rows] == [(0.0, None), (25.0, 25.0), (None, None)]


def test_safe_corr_constant_column(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(safe.safe_corr("a", "b").alias("c")).collect()[0].c is None
    pairs = stats.correlation_pairs(df, ["a", "b"]).collect()
    assert len(pairs) == 1 and pairs[0].corr is None


def test_sum_or_zero_all_null(spark):
    df = spark.createDataFrame([("x", None), ("x", None)], "k string, v double")
    assert df.groupBy("k").agg(safe.sum_or_zero("v").alias("s")).collect()[0].s == 0


def test_bins_right_closed_and_empty(spark):
    df = spark.createDataFrame([(0.0,), (25.0,), (25.5,), (100.0,), (101.0,)], "x double")
    rows = binning.count_per_bin(df, "x", binning.COMPLETION_BINS).collect()
    assert [r.n for r in rows] == [1, 1, 0, 1]     # 0 and 101 fall in no bin
    assert sum(r.share_pct for r in rows) == pytest.approx(100.0)
    assert tuple(binning.count_outside(df, "x", binning.COMPLETION_BINS).collect()[0]) == (1, 1, 0)


def test_small_amounts_are_not_rounded_away(spark):
    df = spark.createDataFrame([("a", 0.004, 0.001)] * 3, "k string, a double, u double")
    r = aggregate.group_utilization(df, "k", "a", "u").collect()[0]
    assert (r.allocated, r.utilized) == (0.012, 0.003)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(min_value=-5, max_value=105), min_size=1, max_size=40))
def test_bins_partition_property(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    rows = binning.count_per_bin(df, "x", binning.COMPLETION_BINS).collect()
    edges = binning.COMPLETION_BINS.edges
    expect = [sum(1 for v in values if edges[i] < v <= edges[i + 1]) for i in range(4)]
    assert [r.n for r in rows] == expect


def test_exact_quantiles_match_numpy_on_skew(spark):
    rng = np.random.default_rng(7)
    hot = rng.normal(100, 15, 3000).round(2)           # one group holds most rows
    cold = rng.normal(10, 3, 7).round(2)
    rows = [("hot", float(v)) for v in hot] + [("cold", float(v)) for v in cold] + [("one", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: r for r in stats.exact_quantiles(df, "g", "v").collect()}
    for name, vals in (("hot", hot), ("cold", cold), ("one", np.array([5.0]))):
        q = np.percentile(vals, [25, 50, 75])
        assert got[name].n == len(vals)
        assert [got[name].q_0, got[name].q_1, got[name].q_2] == pytest.approx(list(q), abs=1e-9)


def test_box_summary_whiskers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("a", v) for v in vals], "g string, v double")
    r = stats.box_summary(df, "g", "v").collect()[0]
    q1, q3 = np.percentile(vals, [25, 75])
    inside = [v for v in vals if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    assert (r.whisker_low, r.whisker_high, r.n_outliers) == (min(inside), max(inside), 1)
    out = stats.box_outliers(df, "g", "v", stats.box_summary(df, "g", "v")).collect()
    assert [o.v for o in out] == [100.0]
    approx = stats.box_summary(df, "g", "v", exact=False).collect()[0]
    assert approx.n == 5


def test_argmax_first_on_tie_and_null(spark):
    df = spark.createDataFrame([("a", 5, 0), ("b", 7, 1), ("c", 7, 2), ("d", None, 3)],
                               "k string, m int, ord long")
    assert df.agg(aggregate.argmax_key("k", "m").alias("t")).collect()[0].t == "b"


def test_top_k_ties_and_polygon(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 3.0), ("d", 2.0)], "k string, v double")
    top = ranking.top_k_ranked(df, [("v", "desc"), ("k", "asc")], 2).orderBy("rn").collect()
    assert [r.k for r in top] == ["b", "c"]
    closed = ranking.close_polygon(ranking.top_k_ranked(df, [("v", "desc"), ("k", "asc")], 3)) \
        .orderBy("rn").collect()
    assert [r.k for r in closed] == ["b", "c", "d", "b"]
    flagged = {r.k: r.is_top for r in ranking.flag_top_k(df, "k", [("v", "desc"), ("k", "asc")], 1).collect()}
    assert flagged == {"a": False, "b": True, "c": False, "d": False}


def test_totals_policy_and_rollup(spark):
    df = spark.createDataFrame([("A", 1, 0), ("B", 2, 1), ("Total", 3, 2), (None, 4, 3)],
                               "k string, v int, ord long")
    assert totals.apply_totals(df, "k").count() == 3            # NULL key kept
    assert totals.apply_totals(df, "k", "as_is").count() == 4
    with pytest.raises(ValueError):
        totals.apply_totals(df, "k", "nope")
    assert df.agg(totals.summary_or_sum("k", "v").alias("x")).collect()[0].x == 3
    no_total = df.filter("k <> 'Total'")
    assert no_total.agg(totals.summary_or_sum("k", "v").alias("x")).collect()[0].x == 3
    rolled = {r.k: r.s for r in totals.with_rollup_total(no_total, "k", [F.sum("v").alias("s")]).collect()}
    assert rolled == {"A": 1, "B": 2, "Total": 3}


def test_series_helpers(spark):
    df = spark.createDataFrame([("m1", 1, 0), ("m2", 2, 1), ("Total", 3, 2)], "k string, v int, ord long")
    assert [r.k for r in series.drop_last(df, "ord").orderBy("ord").collect()] == ["m1", "m2"]
    assert series.drop_last_if_summary(df, "k", "ord").count() == 2
    assert series.drop_last_if_summary(df.filter("k <> 'Total'"), "k", "ord").count() == 2
    assert series.drop_last_if_summary(df, "k", "ord", small=True).count() == 2
    assert series.drop_last_if_summary(df.filter("k <> 'Total'"), "k", "ord", small=True).count() == 2
    assert [r.k for r in series.drop_last(df, "ord", small=True).orderBy("ord").collect()] == ["m1", "m2"]
    got = df.agg(series.lookup_first("k", "v", "m2").alias("a"),
                 series.lookup_first("k", "v", "zz").alias("b")).collect()[0]
    assert (got.a, got.b) == ("2", "N/A")


def test_formats(spark):
    row = spark.createDataFrame([(0.25, 1234.5, -2.7, None)], "a double, b double, c double, n double").select(
        fmt.pct_text("a").alias("p"), fmt.currency("b").alias("m"), fmt.int_text("c").alias("i"),
        fmt.pct_text("n").alias("pn"), fmt.round1("a").alias("r"),
        fmt.normalise_weights(F.array(F.lit(1), F.lit(3))).alias("w"),
        fmt.ascii_cell(F.lit("x₹y")).alias("cell"), fmt.ascii_cell("n").alias("none"),
    ).collect()[0]
    assert (row.p, row.m, row.i, row.pn, row.r) == ("0.2%", "Rs. 1234.50 Cr", "-2", None, 0.2)
    assert row.w == [0.25, 0.75] and row.cell == "xy" and row.none == "None"


def test_agg_map(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "k string, Budget double")
    out = df.groupBy("k").agg(*aggregate.agg_map({"Budget": "sum"})).collect()[0]
    assert out.Budget == 4.0
    with pytest.raises(ValueError):
        aggregate.agg_map({"Budget": "median"})


def test_normalise_to_max_grouped(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 2.0), ("b", 0.0)], "g string, v double")
    got = sorted((r.g, r.v, r.pct) for r in aggregate.normalise_to_max(df, {"v": "pct"}, ["g"]).collect())
    assert got == [("a", 1.0, 25.0), ("a", 4.0, 100.0), ("b", 0.0, 0.0), ("b", 2.0, 100.0)]
    whole = sorted(r.pct for r in aggregate.normalise_to_max(df, {"v": "pct"}).collect())
    assert whole == [0.0, 25.0, 50.0, 100.0]


def test_in_period(spark):
    df = spark.createDataFrame([("Mar-2023",), ("Apr-2023",), ("Total",)], "m string")
    keep = [r.m for r in df.filter(series.in_period("m", "2023-04-01", None)).collect()]
    assert keep == ["Apr-2023", "Total"]
    strict = [r.m for r in df.filter(series.in_period("m", None, "2023-03-31", keep_unparsed=False)).collect()]
    assert strict == ["Mar-2023"]


def test_hot_group_and_hot_value_span_partitions(spark):
    """A group with a third of all rows, and a value that fills a third of
    them, are spread evenly over the sort partitions; quantiles stay exact."""
    key, coalesce = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    old, old_c = spark.conf.get(key), spark.conf.get(coalesce)
    spark.conf.set(key, "8")
    # At this size AQE would merge all sort partitions into one; at scale
    # they are large and stay separate.
    spark.conf.set(coalesce, "false")
    try:
        n = 30000
        v = F.when(F.col("id") % 9 < 3, F.lit(50000)).otherwise((F.col("id") * 7919) % 100003)
        df = spark.range(n).select(
            F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 97).cast("string")).alias("g"),
            v.cast("double").alias("v"))
        counts = stats.sorted_value_counts(df, "g", "v")
        assert counts.filter("g = 'hot'").select("pid").distinct().count() >= 2
        sizes = [r["count"] for r in counts.groupBy("pid").count().collect()]
        assert max(sizes) <= 2 * sum(sizes) / len(sizes)
        hot = np.array([50000.0 if i % 9 < 3 else float((i * 7919) % 100003) for i in range(0, n, 3)])
        q = {r.g: r for r in stats.exact_quantiles(df, "g", "v").collect()}["hot"]
        assert q.n == len(hot)
        assert [q.q_0, q.q_1, q.q_2] == pytest.approx(list(np.percentile(hot, [25, 50, 75])), abs=1e-9)
    finally:
        spark.conf.set(key, old)
        spark.conf.set(coalesce, old_c)


def test_outliers_keep_every_occurrence(spark):
    """Repeated outlying values come back as often as they occur, beyond one chunk."""
    n = stats.EXPAND_CHUNK + 5
    df = (spark.range(10 * n).select(F.lit(1).alias("g"), (F.col("id") % 7).cast("double").alias("v"))
          .union(spark.range(n).select(F.lit(1), F.lit(1000.0))))
    counts = stats.sorted_value_counts(df, "g", "v")
    s = stats.box_summary(df, "g", "v", counts=counts)
    assert s.collect()[0].n_outliers == n
    out = stats.box_outliers(df, "g", "v", s, counts)
    assert [(r.v, r["count"]) for r in out.groupBy("v").count().collect()] == [(1000.0, n)]


def test_flag_top_k_marks_rows_not_keys(spark):
    rows = [("x", 9), ("x", 1), ("x", 8), ("y", 8), ("y", 8), (None, None)]
    df = spark.createDataFrame(rows, "k string, v int")
    for k in range(7):
        got = ranking.flag_top_k(df, "k", [("v", "desc"), ("k", "asc")], k).collect()
        assert len(got) == len(rows) and sum(r.is_top for r in got) == min(k, len(rows))
    got = ranking.flag_top_k(df, "k", [("v", "desc"), ("k", "asc")], 2).collect()
    assert sorted((r.k, r.v) for r in got if r.is_top) == [("x", 8), ("x", 9)]


def test_dense_ordinals_over_ranges(spark):
    """The same as a sort in one place; many equal rows and nulls; no window over all rows."""
    import random

    from budgetlens.operators.ranking import dense_ordinals

    rng = random.Random(5)
    rows = [(rng.choice([1, 2, 2, 2, None, 7]), rng.randint(0, 9), "x") for _ in range(2000)] + [(2, 5, "same")] * 1500
    df = spark.createDataFrame(rows, "a int, b int, c string").repartition(6)
    got = dense_ordinals(df, [("a", "desc"), ("b", "asc")], "rn", partitions=7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    out = sorted(got.collect(), key=lambda r: r.rn)
    assert [r.rn for r in out] == list(range(1, len(rows) + 1))
    order = sorted(((a, b) for a, b, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r.a, r.b) for r in out] == order
    assert sorted((str(r.a), r.b, r.c) for r in out) == sorted((str(a), b, c) for a, b, c in rows)
    assert dense_ordinals(df.limit(0), [("a", "asc")]).collect() == []


def test_table_text_in_chunks_is_the_whole_text(spark):
    from budgetlens.plans.report import table_text, table_text_chunks

    df = spark.createDataFrame([(i, f"n{i * i}", None if i % 5 == 0 else "é" * (i % 7)) for i in range(103)],
                               "k int, name string, note string").repartition(5)
    whole = table_text(df, ["k", "name", "note"], ["k"]).collect()[0].table_text
    for lines in (10, 103, 1000):
        parts = sorted(table_text_chunks(df, ["k", "name", "note"], [("k", "asc")], lines).collect(), key=lambda r: r.chunk)
        assert "\n".join(p.text for p in parts) == whole and all(p.n_lines <= lines for p in parts)
    assert table_text_chunks(df.limit(0), ["k"], [("k", "asc")]).collect() == []


def test_bins_from_a_table(spark):
    """Against a search by hand: gaps, empty bins, edges, a hot value, NULL and NaN."""
    import random
    from bisect import bisect_left

    from pyspark.sql import functions as F

    from budgetlens.operators.binning import sums_by_bin_table

    rng = random.Random(2)
    edges = sorted(rng.sample(range(-500, 3000), 800))
    bins = [(float(a), float(b)) for a, b in zip(edges, edges[1:], strict=False) if rng.random() < 0.8]
    values = [float(rng.randint(-600, 3100)) / rng.choice([1, 2]) for _ in range(4000)] + [float(edges[40])] * 2000
    rows = [(v, 2) for v in values] + [(None, 1), (float("nan"), 1), (float("inf"), 1), (float("-inf"), 1)]
    df = spark.createDataFrame(rows, "x double, w int").repartition(5)
    table = spark.createDataFrame(bins, "lo double, hi double").repartition(3)
    out = sums_by_bin_table(df, "x", table, {"w": F.col("w")})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = dict.fromkeys(bins, 0)
    lows = [a for a, _ in bins]
    for v in values:
        k = bisect_left(lows, v) - 1
        if k >= 0 and v <= bins[k][1]:
            want[bins[k]] += 1
    got = out.collect()
    assert {(r.lo, r.hi): r.n for r in got} == want and len(got) == len(bins)
    assert all((r.w or 0) == 2 * r.n for r in got) and any(r.n == 0 for r in got) and max(r.n for r in got) > 2000
    assert sums_by_bin_table(df, "x", table.limit(0)).collect() == []
    assert {r.n for r in sums_by_bin_table(df.limit(0), "x", table).collect()} == {0}


def test_quantiles_of_any_range_from_stored_sketches(spark):
    import random

    from budgetlens.operators.stats import quantile_sketches, sketched_quantiles

    rng = random.Random(6)
    rows = [(d, rng.choice("ab"), rng.gauss(d, 20) if rng.random() < 0.9 else 5.0) for d in range(20) for _ in range(1500)]
    rows += [(3, "a", None), (4, "a", float("nan")), (5, "c", None)]
    df = spark.createDataFrame(rows, "day int, g string, v double").repartition(6)
    stored = quantile_sketches(df, ["day", "g"], "v").cache()
    assert stored.count() == 41
    for lo, hi in ((0, 19), (4, 9), (7, 7)):
        got = sketched_quantiles(stored.filter(f"day between {lo} and {hi}"), ["g"], (0.05, 0.25, 0.5, 0.75, 0.95)).collect()
        assert {r.g for r in got} == {"a", "b"}
        for r in got:
            v = sorted(x for d, g, x in rows if lo <= d <= hi and g == r.g and x is not None and x == x)
            assert (r.n, r.least, r.greatest) == (len(v), v[0], v[-1])
            for p, q in zip((0.05, 0.25, 0.5, 0.75, 0.95), r.quantiles, strict=True):
                below, upto = sum(x < q for x in v) / len(v), sum(x <= q for x in v) / len(v)
                assert below - 0.01 <= p <= upto + 0.01 and q in v
