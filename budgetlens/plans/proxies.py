"""The report's entities built from the star schema.

The departmental report reads five small tables (section items, sectors,
months, districts, daily activity). On the star schema the same entities
are derived so that the report's work grows with the data:

=================  ==========================================================
entity             derivation
=================  ==========================================================
district           nation; allocation = sum(extendedprice), utilization =
                   sum(extendedprice * (1 - discount)), projects = orders,
                   implementation = 100 * finished orders / orders,
                   population = customers, grievances = returned lines
section / sector   part type / part brand over the lines of their parts;
                   implementation = 100 * finished lines / lines
item               part (with the same line measures)
month              order month; allocation = sum(totalprice), utilization =
                   the finished orders' part, completed / started = finished /
                   open orders, grievances received / resolved = orders / not
                   open orders
day                event day; training sessions = signups, service hits =
                   views
=================  ==========================================================

Plan shape: lines are aggregated to one row per order (or per part) before
any join, orders to one row per customer, so no join ever sees line-level
rows and a hot key is collapsed by the map-side partial aggregate before
its shuffle. Dimension joins are left to Catalyst (broadcast when the
estimated size is under the threshold, sort-merge otherwise; AQE re-plans
on actual sizes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from budgetlens.functions.safe import cents, row_pct, units_sum, units_to_double
from budgetlens.operators.totals import TOTAL, with_rollup_total
from budgetlens.sources.tables import Tables

# Money is carried as exact integer units: ``alloc`` in cents (scale 2),
# ``util`` = extendedprice * (1 - discount) in 1e-4 units (scale 4).
ALLOC_SCALE = 2
UTIL_SCALE = 4


def zero():
    return F.lit(0).cast("decimal(18,0)")


def line_utilization_units():
    """extendedprice * (1 - discount) in 1e-4 units: cents x (100 - discount
    in hundredths), an exact integer product."""
    return cents("l_extendedprice") * (F.lit(100) - cents("l_discount"))


def lines_by_order(t: Tables) -> DataFrame:
    li = t.lineitem
    return li.groupBy("l_orderkey").agg(
        units_sum(cents("l_extendedprice")).alias("alloc"),
        units_sum(line_utilization_units()).alias("util"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned_lines"),
    )


def lines_by_part(t: Tables, parts: DataFrame | None = None) -> DataFrame:
    """Line measures per part; with ``parts`` only lines of those parts are
    aggregated (a semi join below the aggregate)."""
    li = t.lineitem
    if parts is not None:
        li = li.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return li.groupBy("l_partkey").agg(
        units_sum(cents("l_extendedprice")).alias("alloc"),
        units_sum(line_utilization_units()).alias("util"),
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("l_linestatus") == "F").alias("finished_lines"),
        units_sum(cents("l_quantity")).alias("quantity"),
    )


def district_fact(t: Tables) -> DataFrame:
    """One row per district (nation).

    Columns: district, budget_allocation, budget_utilization (DOUBLE from
    exact sums), projects_count, implementation_percentage,
    population_covered, grievances_resolved.
    """
    per_order = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus").join(
        lines_by_order(t), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    per_cust = per_order.groupBy("o_custkey").agg(
        F.sum("alloc").alias("alloc"),
        F.sum("util").alias("util"),
        F.sum("returned_lines").alias("returned_lines"),
        F.count(F.lit(1)).alias("orders"),
        F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
    )
    per_nation = (t.customer.select("c_custkey", "c_nationkey")
                  .join(per_cust, F.col("c_custkey") == F.col("o_custkey"), "left")
                  .groupBy("c_nationkey").agg(
                      F.coalesce(F.sum("alloc"), zero()).alias("alloc"),
                      F.coalesce(F.sum("util"), zero()).alias("util"),
                      F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"),
                      F.coalesce(F.sum("finished"), F.lit(0)).alias("finished"),
                      F.count(F.lit(1)).alias("customers"),
                      F.coalesce(F.sum("returned_lines"), F.lit(0)).alias("returned_lines")))
    nation = t.nation.select("n_nationkey", "n_name")
    out = per_nation.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return out.select(
        F.col("n_name").alias("district"),
        units_to_double("alloc", ALLOC_SCALE).alias("budget_allocation"),
        units_to_double("util", UTIL_SCALE).alias("budget_utilization"),
        F.col("orders").cast("long").alias("projects_count"),
        row_pct("finished", "orders").alias("implementation_percentage"),
        F.col("customers").cast("long").alias("population_covered"),
        F.col("returned_lines").cast("long").alias("grievances_resolved"),
    )


def part_fact(t: Tables, where: Column | None = None) -> DataFrame:
    """One row per part with its line measures (money as exact integer units);
    ``where`` keeps some parts and reaches the lines as a semi join."""
    part = t.part.select("p_partkey", "p_name", "p_type", "p_brand")
    lines = lines_by_part(t)
    if where is not None:
        part = part.filter(where)
        lines = lines_by_part(t, part.select("p_partkey"))
    return part.join(lines, F.col("p_partkey") == F.col("l_partkey"), "left")


def group_fact(parts: DataFrame, key: str, out_key: str) -> DataFrame:
    """Sector-like rows: sums of the parts of each ``key`` value."""
    g = parts.groupBy(key).agg(
        F.coalesce(F.sum("alloc"), zero()).alias("alloc"),
        F.coalesce(F.sum("util"), zero()).alias("util"),
        F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"),
        F.coalesce(F.sum("finished_lines"), F.lit(0)).alias("finished_lines"),
        F.coalesce(F.sum("quantity"), zero()).alias("quantity"),
    )
    return g.select(
        F.col(key).alias(out_key),
        units_to_double("alloc", ALLOC_SCALE).alias("budget_allocation"),
        units_to_double("util", UTIL_SCALE).alias("budget_utilization"),
        F.col("lines").cast("long").alias("projects_count"),
        (F.col("quantity") / 100).cast("long").alias("beneficiaries"),
        row_pct("finished_lines", "lines").alias("implementation_percentage"),
    )


def sector_fact(t: Tables) -> DataFrame:
    """One row per sector (part brand)."""
    return group_fact(part_fact(t), "p_brand", "sector")


def month_series(t: Tables, with_total: bool = True) -> DataFrame:
    """One row per order month (``yyyy-MM``), plus a stored ``Total`` row
    made with ROLLUP when ``with_total``, like the departmental file."""
    o = t.orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("month"),
                        "o_totalprice", "o_orderstatus")
    aggs = [
        units_sum(cents("o_totalprice")).alias("alloc"),
        F.coalesce(units_sum(F.when(F.col("o_orderstatus") == "F", cents("o_totalprice"))),
                   zero()).alias("util"),
        F.count(F.lit(1)).alias("grievances_received"),
        F.count_if(F.col("o_orderstatus") != "O").alias("grievances_resolved"),
        F.count_if(F.col("o_orderstatus") == "F").alias("projects_completed"),
        F.count_if(F.col("o_orderstatus") == "O").alias("new_projects_started"),
    ]
    g = with_rollup_total(o, "month", aggs) if with_total else o.groupBy("month").agg(*aggs)
    return g.select(
        "month",
        units_to_double("alloc", ALLOC_SCALE).alias("budget_allocation"),
        units_to_double("util", ALLOC_SCALE).alias("budget_utilization"),
        *[F.col(c).cast("long").alias(c) for c in
          ("grievances_received", "grievances_resolved", "projects_completed", "new_projects_started")],
        # File order: months ascending, the Total row last.
        F.when(F.col("month") == TOTAL, F.lit(99999999))
         .otherwise(F.regexp_replace("month", "-", "").cast("int")).alias("ord"),
    )


def activity_series(t: Tables) -> DataFrame:
    """One row per event day: training_sessions (signups), online_service_hits
    (views); ``ord`` is the day as yyyyMMdd."""
    e = t.events.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    g = e.groupBy("day").agg(
        F.count_if(F.col("event_type") == "signup").alias("training_sessions"),
        F.count_if(F.col("event_type") == "view").alias("online_service_hits"),
    )
    return g.withColumn("ord", F.regexp_replace("day", "-", "").cast("int"))


def customer_values(t: Tables) -> DataFrame:
    """One row per customer: account balance and the money of its orders."""
    per_cust = t.orders.groupBy("o_custkey").agg(units_sum(cents("o_totalprice")).alias("spend"))
    c = t.customer.select("c_custkey", "c_acctbal")
    j = c.join(per_cust, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", "c_acctbal",
                    units_to_double(F.coalesce("spend", zero()), ALLOC_SCALE).alias("order_value"))
