"""The report's queries on the star schema: ``(spark, sf_dir) -> DataFrame``.

Each function derives the report entity from the tables (see
``plans.proxies``) and runs the generic report query on it. Values that
come out of floating-point aggregates whose result depends on summation
order (means, correlations, regression, interpolated quantiles) are rounded
to 6 decimals in the final projection; money is summed exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from budgetlens.functions import fmt
from budgetlens.functions.safe import as_double, units_to_double
from budgetlens.functions.text import money_text_value
from budgetlens.operators.aggregate import agg_map, distinct_values
from budgetlens.operators.binning import COMPLETION_BINS, Bins, count_outside, sums_by_bin_table
from budgetlens.operators.documents import json_leaves
from budgetlens.operators.ranking import dense_ordinals, every_nth
from budgetlens.operators.series import drop_last
from budgetlens.operators.stats import box_outliers, box_summary, quantile_sketches, sketched_quantiles, sorted_value_counts
from budgetlens.plans import proxies
from budgetlens.plans import report_queries as rq
from budgetlens.plans.report import table_text_chunks
from budgetlens.session import materialize
from budgetlens.sources.tables import Tables

# Fixed values of the star-schema report: which part type plays the
# e-governance section, which brand the e-governance sector, which part
# name the e-office item, and the account-balance bands of the box plot.
EGOV_SECTION = "SMALL"
EGOV_SECTOR = "Brand#13"
EOFFICE_ITEM = "red widget"
BALANCE_BINS = Bins((-1000, 3000, 6000, 9000, 12000),
                    ("Low (<=3000)", "Medium (3000-6000]", "High (6000-9000]", "Very High (>9000)"))

DIGITS = 6


def r6(c):
    return F.round(as_double(c), DIGITS)


def _t(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)


def items(t: Tables) -> DataFrame:
    """Section items: parts, with the section being the part type."""
    return items_from(proxies.part_fact(t))


def items_from(p: DataFrame) -> DataFrame:
    """Section items from a part-level fact (see ``proxies.part_fact``)."""
    return p.select(F.col("p_type").alias("section"), F.col("p_name").alias("item"),
                    F.try_divide(F.col("finished_lines").cast("double"),
                                 F.col("lines").cast("double")).alias("_f"),
                    F.col("alloc").alias("allocated"), F.col("util").alias("utilized"),
                    F.col("p_partkey").alias("ord")) \
            .withColumn("pct_achieved", F.col("_f") * 100.0).drop("_f")


def sectors(t: Tables) -> DataFrame:
    return sectors_from(proxies.part_fact(t))


def sectors_from(p: DataFrame) -> DataFrame:
    """Sectors (part brands) from a part-level fact; sectors have no file
    order, so the name decides ties."""
    return proxies.group_fact(p, "p_brand", "sector").withColumn("ord", F.col("sector"))


def districts(t: Tables) -> DataFrame:
    return proxies.district_fact(t).withColumn("ord", F.col("district"))


ITEM_SCALES = (proxies.ALLOC_SCALE, proxies.UTIL_SCALE)


def budget_by_section(spark, sf_dir):
    return rq.q1_budget_by_section(items(_t(spark, sf_dir)), ITEM_SCALES)


def _line_completion(spark, sf_dir):
    li = _t(spark, sf_dir).lineitem
    return li.select((F.col("l_quantity") * 2 - 4).alias("pct_achieved"))


def completion_status(spark, sf_dir):
    return rq.q2_completion_status(_line_completion(spark, sf_dir))


def completion_outside(spark, sf_dir):
    """The lines that no completion band counts."""
    return count_outside(_line_completion(spark, sf_dir), "pct_achieved", COMPLETION_BINS)


def egov_progress(spark, sf_dir):
    section = proxies.part_fact(_t(spark, sf_dir), F.col("p_type") == EGOV_SECTION)
    q = rq.q3_item_progress(items_from(section), EGOV_SECTION)
    return q.withColumnRenamed("ord", "item_key")


def sector_radar(spark, sf_dir):
    return rq.q4_sector_radar(sectors(_t(spark, sf_dir)))


def monthly_budget_projects(spark, sf_dir):
    return rq.q5_monthly_budget_projects(proxies.month_series(_t(spark, sf_dir)))


def district_heatmap(spark, sf_dir):
    q = rq.q6_district_heatmap(districts(_t(spark, sf_dir)))
    return q.select("district", "budget_allocation", "budget_utilization",
                    r6("allocation_pct").alias("allocation_pct"),
                    r6("utilization_pct").alias("utilization_pct"),
                    r6("utilization_ratio").alias("utilization_ratio"))


def training_vs_online(spark, sf_dir):
    return rq.q7_training_vs_online(proxies.activity_series(_t(spark, sf_dir)), "day")


def balance_boxplot(spark, sf_dir):
    q = rq.q8_box_by_bin(proxies.customer_values(_t(spark, sf_dir)), "c_acctbal", "order_value",
                         BALANCE_BINS)
    return q.select("bin_ord", "bin", "n", *[r6(c).alias(c) for c in
                                             ("q1", "median", "q3", "whisker_low", "whisker_high")],
                    "n_outliers")


def balance_outliers(spark, sf_dir):
    """The box plot's outlier points per balance band."""
    values = proxies.customer_values(_t(spark, sf_dir))
    binned = values.select(BALANCE_BINS.ordinal("c_acctbal").alias("bin_ord"), "order_value")
    counts = sorted_value_counts(binned, "bin_ord", "order_value")
    summary = box_summary(binned, "bin_ord", "order_value", counts=counts)
    out = box_outliers(binned, "bin_ord", "order_value", summary, counts)
    return out.select(F.col("g").alias("bin_ord"), F.col("v").alias("order_value"))


def district_correlation(spark, sf_dir):
    q = rq.q9_district_correlation(districts(_t(spark, sf_dir)))
    return q.select("var_x", "var_y", r6("corr").alias("corr"))


def implementation_scatter(spark, sf_dir):
    # The fit, the points and the labels each read the district fact with
    # different columns; written once, it is aggregated once.
    d = materialize(districts(_t(spark, sf_dir)), "fact-districts")
    q = rq.q10_implementation_scatter(d)
    return q.select("district", "x", "y", "bubble_size", "colour_value",
                    F.round("trend", 4).alias("trend"), F.round("residual", 4).alias("residual"),
                    "labelled")


def grievance_resolution(spark, sf_dir):
    return rq.q11_grievance_resolution(proxies.month_series(_t(spark, sf_dir)))


def sector_treemap(spark, sf_dir):
    q = rq.q12_sector_treemap(materialize(sectors(_t(spark, sf_dir)), "fact-sectors"))
    return q.withColumn("share_pct", r6("share_pct"))


def kpi_budget(spark, sf_dir):
    return rq.q13_kpi_budget(sectors(_t(spark, sf_dir)))


def kpi_projects(spark, sf_dir):
    t = _t(spark, sf_dir)
    q = rq.q14_kpi_projects(sectors(t), proxies.month_series(t))
    return q.withColumn("avg_implementation", r6("avg_implementation"))


def kpi_egov(spark, sf_dir):
    t = _t(spark, sf_dir)
    sector = F.col("p_brand") == EGOV_SECTOR
    item = (F.col("p_type") == EGOV_SECTION) & (F.col("p_name") == EOFFICE_ITEM)
    parts = materialize(proxies.part_fact(t, sector | item), "fact-egov-parts")
    q = rq.q15_kpi_egov(sectors_from(parts.filter(sector)), proxies.activity_series(t),
                        items_from(parts.filter(item)), EGOV_SECTOR, EGOV_SECTION, EOFFICE_ITEM,
                        period_key="day")
    return q.withColumn("mean_hits", r6("mean_hits"))


def top_districts(spark, sf_dir):
    return rq.q16_top_districts(districts(_t(spark, sf_dir)))


def kpi_grievance(spark, sf_dir):
    return rq.q17_kpi_grievance(proxies.month_series(_t(spark, sf_dir), with_total=True))


def kpi_grievance_no_total(spark, sf_dir):
    return rq.q17_kpi_grievance(proxies.month_series(_t(spark, sf_dir), with_total=False))


def quick_stats(spark, sf_dir):
    return rq.q18_quick_stats(sectors(_t(spark, sf_dir)))


def district_heatmap_tidy(spark, sf_dir):
    """A12 in tidy form: one row per district and measure."""
    measures = ["allocation_pct", "utilization_pct", "utilization_ratio"]
    return district_heatmap(spark, sf_dir).select("district", *measures) \
        .unpivot("district", measures, "measure", "value")


def event_types(spark, sf_dir):
    """The distinct event types."""
    return distinct_values(_t(spark, sf_dir).events, "event_type")


def section_aggregates(spark, sf_dir):
    """The aggregate map: measures and functions named as data."""
    spec = {"alloc": "sum", "lines": "max", "finished_lines": "min", "p_partkey": "count"}
    g = proxies.part_fact(_t(spark, sf_dir)).groupBy("p_type").agg(*agg_map(spec))
    return g.select(F.col("p_type").alias("section"),
                    units_to_double("alloc", proxies.ALLOC_SCALE).alias("allocated"),
                    F.col("lines").alias("most_lines"), F.col("finished_lines").alias("least_finished"),
                    F.col("p_partkey").alias("n_items"))


def period_labels(spark, sf_dir):
    """Events per period text, with the month before and the ids of
    the first and last event."""
    e = _t(spark, sf_dir).events.select(fmt.period_text("ts").alias("period"),
                                        fmt.previous_month("ts").cast("string").alias("previous_month"),
                                        fmt.report_id("ts").alias("id"))
    return e.groupBy("period", "previous_month").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"),
                                                     F.max("id").alias("last_id"))


def month_weights(spark, sf_dir):
    """each month's completed, started and received counts as weights."""
    m = proxies.month_series(_t(spark, sf_dir), with_total=False)
    counts = ("projects_completed", "new_projects_started", "grievances_received")
    w = m.select("month", fmt.normalise_weights(F.array(*counts)).alias("w"))
    return w.select("month", *[r6(F.col("w")[i]).alias(f"w_{c}") for i, c in enumerate(counts)])


def document_facts(spark, sf_dir):
    """X8 on nested documents: each sector as a JSON document of one of three
    shapes (objects, arrays in arrays, six levels with empty parts), walked
    without a schema, with the number in each text that is an amount."""
    s = sectors(_t(spark, sf_dir))
    grouped = lambda c: F.concat(F.lit("Rs. "), F.format_number(F.floor(c).cast("long"), 0), F.lit(" Cr"))
    count, progress = F.col("projects_count").cast("string"), fmt.pct_text("implementation_percentage")
    objects = F.concat(
        F.lit('{"Budget":{"Allocated":"'), fmt.currency("budget_allocation"), F.lit('","Utilized":"'),
        grouped("budget_utilization"), F.lit('"},"Status":{"Projects":{"Progress":"'), progress, F.lit('","Count":'),
        count, F.lit("}}}"))
    arrays = F.concat(
        F.lit('{"Budget":[{"Year":"FY 2023-24","Lines":[["Allocated","'), grouped("budget_allocation"),
        F.lit('"],["Utilized","'), fmt.currency("budget_utilization"), F.lit('"]]}],"Note":"'), count, F.lit(" of 99 roads\"}"))
    deep = F.concat(
        F.lit('{"Levels":{"a":{"b":{"c":{"d":{"e":"'), progress, F.lit('"}}}}},"Empty":{},"None":null,"List":[],"On":true,'
                                                                        '"odd key":'), count, F.lit("}"))
    shape = F.col("projects_count") % 3
    docs = s.select("sector", F.when(shape == 0, objects).when(shape == 1, arrays).otherwise(deep).alias("json"))
    return json_leaves(docs, "json", ["sector"]).withColumn("number", money_text_value("value"))


def line_ordinals(spark, sf_dir):
    """W1 with P5 and P14 on top, over whole tables: every order line's ordinal by
    price (largest first, then its keys), the last line dropped, every second kept."""
    lines = _t(spark, sf_dir).lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    spec = [("l_extendedprice", "desc"), *((c, "asc") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                                "l_quantity"))]
    return drop_last(dense_ordinals(lines, spec, "ordinal"), "ordinal").filter(every_nth("ordinal")).select(
        "l_orderkey", "l_linenumber", "ordinal")


def item_table_chunks(spark, sf_dir):
    """S10 on a whole table: the aligned text of all items in chunks of 500 lines."""
    p = _t(spark, sf_dir).part.select("p_partkey", "p_name", "p_brand", "p_size",
                                      F.col("p_retailprice").cast("decimal(18,2)").alias("p_retailprice"))
    t = table_text_chunks(p, ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"], [("p_partkey", "asc")], 500)
    return t.select("chunk", "n_lines", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def price_bins(spark, sf_dir):
    """J3 with bins as data: one bin of width one for every whole price of an item,
    with the order lines whose price falls into it; empty bins stay."""
    t = _t(spark, sf_dir)
    bins = t.part.select(F.floor("p_retailprice").cast("double").alias("lo")).distinct().withColumn("hi", F.col("lo") + 1)
    out = sums_by_bin_table(t.lineitem, "l_extendedprice", bins, {"quantity": F.col("l_quantity").cast("decimal(18,2)")})
    return out.withColumn("quantity", as_double(F.col("quantity")))


def value_sketches(spark, sf_dir):
    """A14 over stored sketches: the quartiles of each event type's values, merged
    from a sketch a day and type, with a check against the values themselves:
    ``within`` tells that the rank is off by no more than one in a hundred."""
    e = _t(spark, sf_dir).events.select(F.to_date("ts").alias("day"), "event_type", "value")
    stored = materialize(quantile_sketches(e, ["day", "event_type"], "value"), "value-sketches")
    quartiles = sketched_quantiles(stored, ["event_type"])
    points = materialize(quartiles.select(F.col("event_type").alias("t"), "n", F.explode(F.arrays_zip(
        F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)]).alias("p"), F.col("quantiles").alias("q"))).alias("x"))
        .select("t", "n", "x.p", "x.q"), "value-quartiles")
    ranks = e.join(points, F.col("event_type").eqNullSafe(F.col("t"))).groupBy("event_type", "n", "p").agg(
        F.count(F.when(F.col("value") < F.col("q"), 1)).alias("below"),
        F.count(F.when(F.col("value") <= F.col("q"), 1)).alias("upto"))
    off = F.lit(0.01)
    return ranks.select("event_type", "n", "p", ((F.col("below") / F.col("n") - off <= F.col("p")) &
                                                 (F.col("p") <= F.col("upto") / F.col("n") + off)).alias("within"))


QUERIES = {
    "value_sketches": value_sketches,
    "price_bins": price_bins,
    "line_ordinals": line_ordinals,
    "item_table_chunks": item_table_chunks,
    "district_heatmap_tidy": district_heatmap_tidy,
    "event_types": event_types,
    "section_aggregates": section_aggregates,
    "period_labels": period_labels,
    "month_weights": month_weights,
    "document_facts": document_facts,
    "budget_by_section": budget_by_section,
    "completion_status": completion_status,
    "completion_outside": completion_outside,
    "egov_progress": egov_progress,
    "sector_radar": sector_radar,
    "monthly_budget_projects": monthly_budget_projects,
    "district_heatmap": district_heatmap,
    "training_vs_online": training_vs_online,
    "balance_boxplot": balance_boxplot,
    "balance_outliers": balance_outliers,
    "district_correlation": district_correlation,
    "implementation_scatter": implementation_scatter,
    "grievance_resolution": grievance_resolution,
    "sector_treemap": sector_treemap,
    "kpi_budget": kpi_budget,
    "kpi_projects": kpi_projects,
    "kpi_egov": kpi_egov,
    "top_districts": top_districts,
    "kpi_grievance": kpi_grievance,
    "kpi_grievance_no_total": kpi_grievance_no_total,
    "quick_stats": quick_stats,
}
