"""The full report on the departmental source files, with the form's
parameters wired in (department, period, data-source switches, totals and
ratio policies)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from budgetlens.functions.text import add_report_sections
from budgetlens.operators.binning import IMPLEMENTATION_BINS
from budgetlens.operators.series import in_period
from budgetlens.plans import report
from budgetlens.plans import report_queries as rq
from budgetlens.sources import departmental as D
from budgetlens.sources.files import Sources, load_sources

# The entities the departmental KPIs look up.
EGOV_SECTOR = "E-Governance"
EGOV_SECTION = "E-Enablement"
EOFFICE_ITEM = "E-Office Implementation"


def _months(src: Sources, period: tuple[str | None, str | None]) -> DataFrame:
    """Months of the period; a stored Total row summarises the whole file,
    so it is kept only when no period is set."""
    whole = period == (None, None) or period is None
    return D.months(src) if whole else D.months(src).filter(in_period("month", *period, keep_unparsed=False))


def chart_data(src: Sources, totals: str = "exclude", ratio_mode: str = "recompute",
               period: tuple[str | None, str | None] = (None, None)) -> dict[str, DataFrame]:
    """The data of the report's twelve charts (S13), keyed by query name."""
    months = _months(src, period)
    return {
        "budget_by_section": rq.q1_budget_by_section(D.items(src)),
        "completion_status": rq.q2_completion_status(D.items(src)),
        "egov_progress": rq.q3_item_progress(D.items(src), EGOV_SECTION),
        "sector_radar": rq.q4_sector_radar(D.sectors(src), totals),
        "monthly_budget_projects": rq.q5_monthly_budget_projects(months, totals),
        "district_heatmap": rq.q6_district_heatmap(D.districts(src), ratio_mode),
        "training_vs_online": rq.q7_training_vs_online(
            months, "month", totals if period in (None, (None, None)) else "exclude"),
        "district_boxplot": rq.q8_box_by_bin(D.districts(src), "implementation_percentage",
                                             "budget_allocation", IMPLEMENTATION_BINS),
        "district_correlation": rq.q9_district_correlation(D.districts(src)),
        "implementation_scatter": rq.q10_implementation_scatter(D.districts(src)),
        "grievance_resolution": rq.q11_grievance_resolution(months, totals),
        "sector_treemap": rq.q12_sector_treemap(D.sectors(src), totals),
    }


def departmental_report(spark: SparkSession, folder: str,
                        department: str = "Panchayati Raj Department",
                        period: tuple[str | None, str | None] = (None, None),
                        include: tuple[str, ...] = ("budget", "projects", "egov", "district",
                                                    "correlation", "grievance"),
                        totals: str = "exclude", ratio_mode: str = "recompute",
                        report_text: DataFrame | None = None) -> dict[str, DataFrame]:
    """Everything the report shows, as DataFrames: ``blocks`` (ordered
    report), ``sections`` (executive summary / detailed text of the report
    text), ``prompt``, ``summary_context``, ``quick_stats`` and the chart
    data. ``report_text`` (column ``report_text``) is the model's text if
    one exists; otherwise the deterministic narrative is used: from the KPIs, or
    from the item table where the optional tables are missing (basic mode)."""
    src = load_sources(spark, folder)
    months = _months(src, period)
    sectors = D.sectors(src)
    parts = {
        "kpi_budget": rq.q13_kpi_budget(sectors, totals),
        "kpi_projects": rq.q14_kpi_projects(sectors, months, totals),
        "kpi_egov": rq.q15_kpi_egov(sectors, months, D.items(src), EGOV_SECTOR, EGOV_SECTION,
                                    EOFFICE_ITEM, totals=totals),
        "top_districts": rq.q16_top_districts(D.districts(src)),
        "kpi_grievance": rq.q17_kpi_grievance(months),
    }
    kpis = report.kpi_record(parts["kpi_budget"], parts["kpi_projects"], parts["kpi_grievance"])
    if not src.has_additional_data:
        kpis = None
    narrative = report.item_narrative(D.items(src)) if kpis is None else report.fallback_narrative(kpis)
    text = report_text if report_text is not None else narrative
    # The whole item table: every row, every column of the file, in file order.
    columns = [c for c in src.items.columns if c != "ord"]
    table = report.table_text(src.items, columns, ["ord"])
    json_text = report.json_context(src.json)
    prompt = report.report_prompt(src.text, "text", table, json_text, department, ["path"])
    sections = add_report_sections(text, "report_text", "compat")
    context = report.summary_context(sections, kpis, table, json_text)
    return {
        "blocks": report.report_blocks(spark, parts, text, src.has_additional_data, include),
        "sections": sections,
        "prompt": prompt,
        "messages": report.messages(prompt, "prompt", report.REPORT_ROLE, report.REPORT_LEAD, ["path"]),
        "summary_context": context,
        "summary_messages": report.messages(context, "summary_context", report.SUMMARY_ROLE, None, []),
        "rejected_cells": src.rejected_cells,
        "quick_stats": rq.q18_quick_stats(sectors, totals),
        **chart_data(src, totals, ratio_mode, period),
    }
