"""Report assembly queries on the star schema (Q19, Q20, Q22)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetlens.functions.fmt import fixed
from budgetlens.functions.text import add_report_sections, split_markdown_sections
from budgetlens.functions.text import missing_sections as lacking_sections
from budgetlens.plans import proxies, report, star, text_queries
from budgetlens.plans import report_queries as rq
from budgetlens.session import materialize, spread_for_cpu
from budgetlens.sources.tables import Tables

# Default of the department named in the prompt.
DEPARTMENT = "Panchayati Raj Department of Arunachal Pradesh"

KPI_JSON_FIELDS = ["allocated_text", "utilized_text", "utilization_text", "top_sector",
                   "total_projects_text", "avg_implementation_text", "resolution_rate_text",
                   "avg_resolution_time"]


def kpis(t: Tables, parts: DataFrame | None = None) -> DataFrame:
    """The KPI record. Its sector and month facts each feed several KPIs;
    they are written once so the fact tables are aggregated once."""
    parts = parts if parts is not None else proxies.part_fact(t)
    sectors = materialize(star.sectors_from(parts), "fact-sectors")
    months = materialize(proxies.month_series(t), "fact-months")
    return kpi_row(sectors, months)


def kpi_row(sectors: DataFrame, months: DataFrame) -> DataFrame:
    """The KPI record as a written table of one row, so that every text that
    quotes it reads the same row."""
    return materialize(report.kpi_record(rq.q13_kpi_budget(sectors), rq.q14_kpi_projects(sectors, months),
                                         rq.q17_kpi_grievance(months)), "kpi-record")


def summary_context(spark, sf_dir) -> DataFrame:
    """Q19: the summary writer's context for the report's narrative (one row):
    detailed text, KPI bullets, JSON and the section table, all whole."""
    t = Tables(spark, sf_dir)
    parts = materialize(proxies.part_fact(t), "fact-parts")
    k = kpis(t, parts)
    detailed = add_report_sections(report.fallback_narrative(k), "report_text", "markdown")
    return report.summary_context(detailed, k, section_table_text(t, parts), kpi_json(k))


def section_table_text(t: Tables, parts: DataFrame | None = None) -> DataFrame:
    src = star.items_from(parts) if parts is not None else star.items(t)
    q1 = rq.q1_budget_by_section(src, star.ITEM_SCALES)
    cells = q1.select("section",
                      F.format_string("%.2f", fixed("allocated", 2)).alias("allocated"),
                      F.format_string("%.2f", fixed("utilized", 2)).alias("utilized"),
                      F.format_string("%.1f", fixed("utilization_pct", 1)).alias("utilization_pct"))
    return report.table_text(cells, ["section", "allocated", "utilized", "utilization_pct"], ["section"])


def kpi_json(k: DataFrame) -> DataFrame:
    return k.select(F.to_json(F.struct(*[F.col(c) for c in KPI_JSON_FIELDS])).alias("json_text"))


def report_prompt(spark, sf_dir, department: str = DEPARTMENT) -> DataFrame:
    """Q22: one prompt per document (length and MD5 of the whole prompt)."""
    p = _prompts(spark, sf_dir, department)
    return p.select("doc_id", F.length("prompt").cast("long").alias("prompt_len"),
                    F.md5("prompt").alias("prompt_md5"))


def _prompts(spark, sf_dir, department: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    parts = materialize(proxies.part_fact(t), "fact-parts")
    docs = spread_for_cpu(t.documents.select("doc_id", "text"))
    return report.report_prompt(docs, "text", section_table_text(t, parts), kpi_json(kpis(t, parts)),
                                department, ["doc_id"])


def report_messages(spark, sf_dir, department: str = DEPARTMENT) -> DataFrame:
    """X2 with its role: the messages of each document's request (length and MD5
    of the whole content)."""
    m = report.messages(_prompts(spark, sf_dir, department), "prompt", report.REPORT_ROLE, report.REPORT_LEAD,
                        ["doc_id"])
    return m.select("doc_id", F.col("ord").cast("long").alias("ord"), "role",
                    F.length("content").cast("long").alias("content_len"),
                    F.md5("content").alias("content_md5"))


def summary_messages(spark, sf_dir) -> DataFrame:
    """X3 with its role: the messages of the summary writer's request, whole."""
    m = report.messages(summary_context(spark, sf_dir), "summary_context", report.SUMMARY_ROLE, None, [])
    return m.select(F.col("ord").cast("long").alias("ord"), "role", "content")


class ReportFacts:
    """The report's entities, each computed once per report run.

    Every fact is an aggregate (one row per sector, district, month, day,
    part); it is checkpointed to the shared checkpoint folder so the many
    blocks of one report read it instead of re-aggregating the fact tables,
    and a lost executor does not force the aggregation again. The facts
    are aggregates (bounded by the number of parts, districts, months...),
    so they are small next to the fact tables they summarise.
    """

    def __init__(self, spark, sf_dir: str):
        t = Tables(spark, sf_dir)
        parts = materialize(proxies.part_fact(t), "fact-parts")
        self.items = star.items_from(parts)
        self.sectors = materialize(star.sectors_from(parts), "fact-sectors")
        self.districts = materialize(star.districts(t), "fact-districts")
        self.months = materialize(proxies.month_series(t), "fact-months")
        self.activity = materialize(proxies.activity_series(t), "fact-activity")

    def parts(self, kpi: DataFrame) -> dict[str, DataFrame]:
        """The report's table results; three of them read the KPI record."""
        return {
            "kpi_budget": kpi,
            "kpi_projects": kpi,
            "kpi_grievance": kpi,
            "kpi_egov": rq.q15_kpi_egov(self.sectors, self.activity, self.items, star.EGOV_SECTOR,
                                        star.EGOV_SECTION, star.EOFFICE_ITEM, period_key="day"),
            "top_districts": rq.q16_top_districts(self.districts),
        }


def report_blocks(spark, sf_dir) -> DataFrame:
    """Q20: the ordered report blocks, assembled from facts built once."""
    facts = ReportFacts(spark, sf_dir)
    kpi = kpi_row(facts.sectors, facts.months)
    return report.report_blocks(spark, facts.parts(kpi), report.fallback_narrative(kpi))


def narrative_text(spark, sf_dir) -> DataFrame:
    """The deterministic report text filled from the KPI record."""
    return report.fallback_narrative(kpis(Tables(spark, sf_dir)))


def top_districts_table(spark, sf_dir) -> DataFrame:
    """The top districts as a Markdown table block."""
    return report.markdown_table(star.top_districts(spark, sf_dir), *report.TABLES["top_districts"])


def missing_sections(spark, sf_dir) -> DataFrame:
    """The required report sections that each document lacks, when read as
    a report with a summary heading."""
    md = text_queries.headed_documents(spark, sf_dir)
    found = split_markdown_sections(md, "md", ["doc_id"]).filter("title is not null")
    docs = md.select("doc_id", F.lit(None).cast("string").alias("title"))
    lacking = lacking_sections(docs.unionByName(found.select("doc_id", "title")), report.REQUIRED_SECTIONS,
                               ["doc_id"])
    return lacking.select("doc_id", F.col("req_ord").cast("long").alias("req_ord"), "title")


QUERIES = {
    "narrative_text": narrative_text,
    "top_districts_table": top_districts_table,
    "missing_sections": missing_sections,
    "summary_context": summary_context,
    "report_prompt": report_prompt,
    "report_messages": report_messages,
    "summary_messages": summary_messages,
    "report_blocks": report_blocks,
}
