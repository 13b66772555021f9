"""The report's user-level queries (Q1-Q18) over standard entity columns.

Input frames use these column names (``ord`` = file position):

* items:     section, item, pct_achieved, allocated, utilized, ord
* sectors:   sector, budget_allocation, budget_utilization, projects_count,
             beneficiaries, implementation_percentage, ord
* months:    month, budget_allocation, budget_utilization,
             grievances_received, grievances_resolved, projects_completed,
             new_projects_started, ord
* activity:  a period key, training_sessions, online_service_hits, ord
* districts: district, budget_allocation, budget_utilization,
             projects_count, implementation_percentage, population_covered,
             grievances_resolved, ord

``sources.departmental`` maps the CSV files onto these names, ``plans.star``
derives them from the star schema. Each query returns a DataFrame; the
caller decides the action.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from budgetlens.functions.fmt import currency, int_text, num_text, pct_text, round1
from budgetlens.functions.safe import as_double, exact_total, guarded_pct, row_pct
from budgetlens.operators.aggregate import (argmax_key, attach_scalars, group_utilization,
                                            normalise_to_max, share_of_total)
from budgetlens.operators.binning import COMPLETION_BINS, Bins, count_per_bin
from budgetlens.operators.ranking import (close_polygon, every_nth, flag_top_k, radar_angle,
                                          top_k_ranked, with_rank)
from budgetlens.operators.series import drop_last, drop_last_if_summary, lookup_first
from budgetlens.operators.stats import box_summary, correlation_pairs, with_trend
from budgetlens.operators.totals import TOTAL, apply_totals, check_mode, summary_or_sum

RATIO_MODES = ("recompute", "sum")

# The district measures of the correlation heatmap, in order.
CORRELATION_MEASURES = ["budget_allocation", "budget_utilization", "projects_count",
                        "implementation_percentage", "population_covered", "grievances_resolved"]

# Fixed value: the resolution time the report states (not computed).
AVG_RESOLUTION_TIME = "5 days"


def q1_budget_by_section(items: DataFrame, scales: tuple[int, int] | None = None) -> DataFrame:
    """Q1: per section allocated, utilized and utilization %, key order.
    ``scales``: the money columns are integer units (see group_utilization)."""
    return group_utilization(items, "section", "allocated", "utilized", scales=scales).orderBy("section")


def q2_completion_status(df: DataFrame, pct_col: str = "pct_achieved",
                         bins: Bins = COMPLETION_BINS) -> DataFrame:
    """Q2: items per completion band ``(lo, hi]``, empty bands kept, with
    their share of the counted items."""
    return count_per_bin(df, pct_col, bins)


def q3_item_progress(items: DataFrame, section: str) -> DataFrame:
    """Q3: the items of one section with their achievement %."""
    s = items.filter(F.col("section") == F.lit(section))
    return s.select("item", as_double("pct_achieved").alias("pct_achieved"),
                    F.concat(num_text("pct_achieved"), F.lit("%")).alias("label"), "ord")


def q4_sector_radar(sectors: DataFrame, totals: str = "exclude", k: int = 8) -> DataFrame:
    """Q4: top-k sectors by implementation as a closed polygon: point,
    sector, value, angle (the closing point repeats the first)."""
    s = apply_totals(sectors, "sector", totals)
    spec = [("implementation_percentage", "desc"), ("ord", "asc")]
    # At most k rows from here on: the count is a window over the top-k.
    top = top_k_ranked(s, spec, k, out="point") \
        .withColumn("n_points", F.count(F.lit(1)).over(Window.partitionBy()))
    pts = top.select("point", "sector", as_double("implementation_percentage").alias("value"),
                     radar_angle("point", "n_points").alias("angle"), "n_points")
    return close_polygon(pts, "point", "n_points").select("point", "sector", "value", "angle")


def q5_monthly_budget_projects(months: DataFrame, totals: str = "exclude") -> DataFrame:
    """Q5: monthly allocation / utilization / utilization % with projects
    completed, started and the net change; every other month is labelled."""
    m = apply_totals(months, "month", totals)
    pct = row_pct("budget_utilization", "budget_allocation")
    out = m.select(
        "month", "budget_allocation", "budget_utilization",
        pct.alias("utilization_pct"), round1(pct).alias("utilization_pct_1dp"),
        "projects_completed", "new_projects_started",
        (F.col("projects_completed") - F.col("new_projects_started")).alias("net_change"), "ord")
    # The series is one row per month (aggregated), so an ordinal over it is small.
    ranked = with_rank(out, [("ord", "asc")], "rn")
    return ranked.withColumn("show_label", every_nth("rn", 2)).drop("rn", "ord")


def q6_district_heatmap(districts: DataFrame, ratio_mode: str = "recompute") -> DataFrame:
    """Q6: per district (duplicates merged) allocation and utilization
    normalised to the largest district (=100) and the utilization ratio.

    ``ratio_mode='recompute'`` divides the merged sums; ``'sum'`` adds the
    rows' rounded ratios as the reference's pivot does."""
    if ratio_mode not in RATIO_MODES:
        raise ValueError(f"ratio_mode must be one of {RATIO_MODES}")
    row_ratio = round1(row_pct("budget_utilization", "budget_allocation"))
    merged = districts.groupBy("district").agg(
        exact_total("budget_allocation").alias("budget_allocation"),
        exact_total("budget_utilization").alias("budget_utilization"),
        F.sum(row_ratio).alias("_ratio_sum"))
    ratio = row_pct("budget_utilization", "budget_allocation") if ratio_mode == "recompute" \
        else F.col("_ratio_sum")
    merged = merged.withColumn("utilization_ratio", ratio).drop("_ratio_sum")
    norm = normalise_to_max(merged, {"budget_allocation": "allocation_pct",
                                     "budget_utilization": "utilization_pct"})
    return norm.select("district", "budget_allocation", "budget_utilization", "allocation_pct",
                       "utilization_pct", "utilization_ratio") \
               .orderBy(F.col("budget_allocation").desc(), "district")


def q7_training_vs_online(activity: DataFrame, key: str, totals: str = "exclude") -> DataFrame:
    """Q7: per period training sessions and service hits. A summary row is
    dropped by its name, so no real period is lost; ``as_is`` drops the last
    row by position, whatever it is."""
    if check_mode(totals) == "as_is":
        # One row per period: the window over the series is bounded by its length.
        activity = drop_last(activity, "ord", small=True)
    else:
        activity = activity.filter(~F.col(key).cast("string").eqNullSafe(F.lit(TOTAL)))
    return activity.select(key, "training_sessions", "online_service_hits")


def q8_box_by_bin(df: DataFrame, x: str, value: str, bins: Bins, exact: bool = True) -> DataFrame:
    """Q8: box summary of ``value`` per bin of ``x``; every bin appears, with
    n = 0 and NULL statistics when empty (keyed by label, no positional
    pairing)."""
    binned = df.select(bins.ordinal(x).alias("bin_ord"), F.col(value).alias("_v")) \
               .filter(F.col("bin_ord").isNotNull())
    stats = box_summary(binned, "bin_ord", "_v", exact=exact) \
        .withColumnRenamed("g", "bin_ord")
    table = bins.table(df.sparkSession).select("bin_ord", "bin")
    out = table.join(stats, "bin_ord", "left")
    return out.select(
        "bin_ord", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        "q1", "median", "q3", "whisker_low", "whisker_high",
        F.coalesce("n_outliers", F.lit(0)).cast("long").alias("n_outliers"),
    ).orderBy("bin_ord")


def q9_district_correlation(districts: DataFrame, measures: list[str] = None) -> DataFrame:
    """Q9: Pearson correlation of the lower triangle of the measure matrix."""
    return correlation_pairs(districts, measures or CORRELATION_MEASURES)


def q10_implementation_scatter(districts: DataFrame, label_k: int = 5) -> DataFrame:
    """Q10: scatter points (implementation vs population) with bubble size,
    colour value, fitted trend and the top-k-by-allocation label flag."""
    d = with_trend(districts, "implementation_percentage", "population_covered")
    d = flag_top_k(d, "district", [("budget_allocation", "desc"), ("ord", "asc")], label_k,
                   out="labelled")
    return d.select("district",
                    as_double("implementation_percentage").alias("x"),
                    as_double("population_covered").alias("y"),
                    (F.col("projects_count") * 20).cast("long").alias("bubble_size"),
                    as_double("budget_allocation").alias("colour_value"),
                    "trend", "residual", "labelled")


def q11_grievance_resolution(months: DataFrame, totals: str = "exclude") -> DataFrame:
    """Q11: monthly grievances received / resolved and resolution rate; the
    chart's reference line is 100."""
    m = apply_totals(months, "month", totals)
    return m.select("month", "grievances_received", "grievances_resolved",
                    row_pct("grievances_resolved", "grievances_received").alias("resolution_rate"),
                    F.lit(100.0).alias("reference_line"))


def q12_sector_treemap(sectors: DataFrame, totals: str = "exclude") -> DataFrame:
    """Q12: sectors by allocation (descending) with treemap label, area
    share and colour value (implementation / 100)."""
    s = apply_totals(sectors, "sector", totals)
    s = share_of_total(s, "budget_allocation", "share_pct")
    label = F.concat_ws("\n", F.col("sector"),
                        currency("budget_allocation", unit="Cr"),
                        F.concat(F.lit("("), int_text("implementation_percentage"), F.lit("%)")))
    return s.select("sector", as_double("budget_allocation").alias("budget_allocation"),
                    as_double("implementation_percentage").alias("implementation_percentage"),
                    label.alias("label"), "share_pct",
                    (as_double("implementation_percentage") / 100.0).alias("colour_value"), "ord") \
            .orderBy(F.col("budget_allocation").desc(), "ord").drop("ord")


def _budget_aggs(tie: str):
    return [
        exact_total("budget_allocation").alias("total_allocated"),
        exact_total("budget_utilization").alias("total_utilized"),
        argmax_key("sector", "implementation_percentage", tie).alias("top_sector"),
    ]


def q13_kpi_budget(sectors: DataFrame, totals: str = "exclude", tie: str = "ord") -> DataFrame:
    """Q13: one row: total allocated / utilized, overall utilization %, top
    sector by implementation (first on ties), with the report's texts."""
    s = apply_totals(sectors, "sector", totals)
    k = s.agg(*_budget_aggs(tie))
    pct = guarded_pct("total_utilized", "total_allocated")
    return k.select("total_allocated", "total_utilized", pct.alias("overall_utilization_pct"),
                    "top_sector",
                    currency("total_allocated").alias("allocated_text"),
                    currency("total_utilized").alias("utilized_text"),
                    pct_text(pct).alias("utilization_text"))


def q14_kpi_projects(sectors: DataFrame, months: DataFrame, totals: str = "exclude") -> DataFrame:
    """Q14: one row: total projects, completed, newly started, mean
    implementation (two one-row aggregates side by side)."""
    s = apply_totals(sectors, "sector", totals)
    m = apply_totals(months, "month", totals)
    a = s.agg(F.coalesce(F.sum("projects_count"), F.lit(0)).cast("long").alias("total_projects"),
              F.avg(as_double("implementation_percentage")).alias("avg_implementation"))
    b = m.agg(F.coalesce(F.sum("projects_completed"), F.lit(0)).cast("long").alias("completed_projects"),
              F.coalesce(F.sum("new_projects_started"), F.lit(0)).cast("long").alias("new_projects"))
    out = attach_scalars(a, b)
    return out.select("total_projects", "completed_projects", "new_projects", "avg_implementation",
                      int_text("total_projects").alias("total_projects_text"),
                      pct_text("avg_implementation").alias("avg_implementation_text"))


def q15_kpi_egov(sectors: DataFrame, activity: DataFrame, items: DataFrame,
                 service_sector: str, item_section: str, item_name: str,
                 period_key: str = "month", totals: str = "exclude") -> DataFrame:
    """Q15: one row: online services (projects of one sector, ``N/A`` if the
    sector is absent), mean service hits per period (the last row dropped
    when a summary row exists), one item's achievement (``N/A`` if absent)
    and the sessions total (under the totals policy)."""
    services = sectors.agg(lookup_first("sector", "projects_count", service_sector).alias("online_services"))
    hits = drop_last_if_summary(activity, period_key, "ord", small=True) \
        .agg(F.avg(as_double("online_service_hits")).alias("mean_hits"))
    sessions = apply_totals(activity, period_key, totals) \
        .agg(F.coalesce(F.sum("training_sessions"), F.lit(0)).cast("long").alias("training_sessions"))
    section_items = items.filter(F.col("section") == F.lit(item_section))
    item = section_items.agg(lookup_first("item", "pct_achieved", item_name).alias("item_pct"))
    out = attach_scalars(attach_scalars(attach_scalars(services, hits), sessions), item)
    return out.select("online_services", "mean_hits",
                      num_text("mean_hits").alias("mean_hits_text"),
                      "item_pct", "training_sessions")


def q16_top_districts(districts: DataFrame, k: int = 5) -> DataFrame:
    """Q16: the k districts with the highest implementation (ties: larger
    allocation, then name), with the table's formatted cells."""
    spec = [("implementation_percentage", "desc"), ("budget_allocation", "desc"), ("district", "asc")]
    top = top_k_ranked(districts, spec, k, out="rank")
    return top.select(
        "rank", "district", "budget_allocation", "budget_utilization",
        as_double("implementation_percentage").alias("implementation_percentage"),
        "population_covered",
        currency("budget_allocation", unit="").alias("allocated_text"),
        currency("budget_utilization", unit="").alias("utilized_text"),
        pct_text("implementation_percentage").alias("implementation_text"),
        int_text("population_covered").alias("population_text"))


def q17_kpi_grievance(months: DataFrame) -> DataFrame:
    """Q17: one row: grievances received / resolved (the stored Total row
    when there is one, else the sum), resolution rate, stated time."""
    k = months.agg(summary_or_sum("month", "grievances_received").alias("received"),
                   summary_or_sum("month", "grievances_resolved").alias("resolved"))
    rate = guarded_pct("resolved", "received")
    return k.select(F.col("received").cast("long").alias("total_received"),
                    F.col("resolved").cast("long").alias("total_resolved"),
                    rate.alias("resolution_rate"),
                    pct_text(rate).alias("resolution_rate_text"),
                    F.lit(AVG_RESOLUTION_TIME).alias("avg_resolution_time"))


def q18_quick_stats(sectors: DataFrame, totals: str = "exclude", tie: str = "ord") -> DataFrame:
    """Q18: the three labelled metrics of the dashboard: (ord, metric,
    value, subtext)."""
    s = apply_totals(sectors, "sector", totals)
    k = s.agg(*_budget_aggs(tie),
              F.coalesce(F.sum("projects_count"), F.lit(0)).cast("long").alias("total_projects"),
              F.avg(as_double("implementation_percentage")).alias("avg_impl"),
              F.max(as_double("implementation_percentage")).alias("max_impl"))
    pct = guarded_pct("total_utilized", "total_allocated")
    rows = F.array(
        F.struct(F.lit(1).alias("ord"), F.lit("Budget Utilization").alias("metric"),
                 pct_text(pct).alias("value"),
                 F.concat(currency("total_utilized"), F.lit(" / "), currency("total_allocated"))
                 .alias("subtext")),
        F.struct(F.lit(2).alias("ord"), F.lit("Project Implementation").alias("metric"),
                 pct_text("avg_impl").alias("value"),
                 F.concat(F.lit("Total Projects: "), int_text("total_projects")).alias("subtext")),
        F.struct(F.lit(3).alias("ord"), F.lit("Top Performing Sector").alias("metric"),
                 F.col("top_sector").alias("value"),
                 F.concat(F.lit("Implementation: "), pct_text("max_impl")).alias("subtext")),
    )
    return k.select(F.explode(rows).alias("r")).select("r.ord", "r.metric", "r.value", "r.subtext")
