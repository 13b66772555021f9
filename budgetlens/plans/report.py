"""Report assembly: table text, prompt and KPI context, the deterministic
narrative, and the ordered report blocks (S10, X2-X6, Q19, Q20, Q22).

Text renderings of a table (``table_text``, ``markdown_table``) gather the
rows of each group into one string, so they are applied to aggregated
results (one row per section, a top-k), never to fact tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from budgetlens.functions.fmt import ascii_cell, currency, int_text, pct_text
from budgetlens.functions.text import add_report_sections, py_strip
from budgetlens.operators.aggregate import attach_scalars
from budgetlens.operators.ranking import dense_ordinals

# The report's instructions, required sections and fixed texts.
REQUIRED_SECTIONS = [
    "Executive Summary",
    "Budget Performance Analysis",
    "Infrastructure Project Status",
    "E-Governance Implementation Progress",
    "Key Government Programs",
    "Public Grievance Redressal",
    "Health and Education Initiatives",
    "Challenges and Mitigation Strategies",
    "District-wise Performance Analysis",
    "Recommendations for the Next Quarter",
    "Future Outlook and Strategic Plan",
]
FORMAT_INSTRUCTIONS = [
    'Start with an "Executive Summary" section that provides a concise overview (150-200 words)',
    "Use clear section headers preceded by '##' for each section",
    "Include relevant data points and metrics in your analysis",
    "Format key statistics in bulleted lists where appropriate",
    "Include specific numerical values from the data",
]
PROMPT_HEAD = ("Using the following data, generate a comprehensive, insightful monthly "
               "departmental report for the {department}.")
PROMPT_TAIL = ("The report should include data-driven insights, highlight achievements, identify "
               "challenges, and provide actionable recommendations based on current metrics.")
BASIC_ANALYSIS = (
    "This analysis presents key metrics and performance indicators for the department. "
    "The following sections provide visual and data-driven insights into budget performance, "
    "project status, e-governance implementation, and district-wise achievements. "
    "Please refer to the visualization sections for comprehensive data analysis.")
CORRELATION_NOTE = (
    "The correlation analysis reveals the relationship between key performance indicators. "
    "Strong positive correlations indicate metrics that tend to increase together, while negative "
    "correlations indicate inverse relationships. The scatter plot demonstrates how implementation "
    "progress relates to population coverage, with bubble size representing project count and color "
    "intensity showing budget allocation.")

# What the writer is told it is, and the line before a report's data.
REPORT_ROLE = (
    "You are an expert AI report generator specialized in government department reporting with data "
    "analysis expertise. Your task is to create clear, concise, and well-structured reports with properly"
    " formatted section headers. Always include an executive summary and organize content with markdown "
    "formatting. Focus on data-driven insights, key metrics, achievements, challenges, and actionable "
    "recommendations.")
SUMMARY_ROLE = (
    "You are an expert government report writer specializing in executive summaries. Your task is to "
    "create professional, concise summaries (150-200 words) that highlight key performance metrics, "
    "achievements, challenges, and strategic directions. Focus on clarity, quantitative data points, and "
    "actionable information. Do not use meta-language like 'this report' or refer to the document itself.")
REPORT_LEAD = "Generate a detailed monthly departmental report based on the following data:"


def prompt_preamble(department: str) -> str:
    lines = [PROMPT_HEAD.format(department=department), "", "FORMAT INSTRUCTIONS:"]
    lines += [f"{i}. {t}" for i, t in enumerate(FORMAT_INSTRUCTIONS, 1)]
    return "\n".join(lines)


def prompt_sections_text() -> str:
    return "\n".join(["REQUIRED REPORT SECTIONS:"] + [f"## {s}" for s in REQUIRED_SECTIONS])


# --------------------------------------------------------------- S10, X6

def table_text(df: DataFrame, columns: list[str], order: list[str],
               group: list[str] | None = None, out: str = "table_text") -> DataFrame:
    """Render rows as aligned text, one string per group (S10): a header
    line, then one line per row in ``order``; every column right-aligned to
    its widest cell, columns separated by two spaces. Cells must be strings
    (format numbers first)."""
    group = group or []
    okeys = [f"_o{i}" for i in range(len(order))]
    cells = df.select(*group, *[F.col(o).alias(k) for o, k in zip(order, okeys)],
                      *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    widths = cells.groupBy(*group).agg(*[
        F.greatest(F.lit(len(c)), F.coalesce(F.max(F.length(c)), F.lit(0))).alias(f"_w_{i}")
        for i, c in enumerate(columns)])
    joined = cells.join(widths, group, "inner") if group else attach_scalars(cells, widths)

    def line(parts: list[Column]) -> Column:
        return F.concat_ws("  ", *[F.lpad(p, F.col(f"_w_{i}"), " ") for i, p in enumerate(parts)])

    rows = joined.select(*group, *okeys,
                         line([F.col(c) for c in columns]).alias("_line"),
                         line([F.lit(c) for c in columns]).alias("_header"))
    agg = rows.groupBy(*group).agg(
        F.first("_header").alias("_header"),
        F.sort_array(F.collect_list(F.struct(*okeys, F.col("_line")))).alias("_rows"))
    return agg.select(*group, F.concat_ws("\n", F.col("_header"),
                                          F.array_join(F.transform("_rows", lambda r: r["_line"]), "\n"))
                      .alias(out))


def table_text_chunks(df: DataFrame, columns: list[str], order: list[tuple[str, str]],
                      lines: int = 10_000) -> DataFrame:
    """The aligned text of a table of any size (S10): one row for every ``lines``
    lines, (chunk, n_lines, text), numbered from 0; the texts joined by line feeds
    are the document. Widths come from one aggregate, line numbers from
    ``dense_ordinals``; no task or string holds more than ``lines`` lines (and one
    range of the order). An empty table gives no chunk."""
    okeys = [f"_o{i}" for i in range(len(order))]
    cells = df.select(*[F.col(f"`{o}`").alias(k) for (o, _), k in zip(order, okeys)],
                      *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"_c{i}") for i, c in enumerate(columns)])
    widths = cells.agg(*[F.greatest(F.lit(len(c)), F.coalesce(F.max(F.length(f"_c{i}")), F.lit(0))).alias(f"_w{i}")
                         for i, c in enumerate(columns)])
    numbered = dense_ordinals(cells, [(k, direction) for k, (_, direction) in zip(okeys, order)], "_rn")

    def line(parts: list[Column]) -> Column:
        return F.concat_ws("  ", *[F.lpad(p, F.col(f"_w{i}"), " ") for i, p in enumerate(parts)])

    rows = attach_scalars(numbered, widths).select(
        F.floor((F.col("_rn") - 1) / lines).cast("long").alias("chunk"), "_rn",
        line([F.col(f"_c{i}") for i in range(len(columns))]).alias("_line"),
        line([F.lit(c) for c in columns]).alias("_header"))
    per = rows.groupBy("chunk").agg(
        F.count(F.lit(1)).alias("n_lines"), F.first("_header").alias("_header"),
        F.array_sort(F.collect_list(F.struct("_rn", "_line"))).alias("_rows"))  # ``lines`` at most
    body = F.array_join(F.transform("_rows", lambda r: r["_line"]), "\n")
    return per.select("chunk", "n_lines", F.when(F.col("chunk") == 0, F.concat_ws("\n", "_header", body))
                      .otherwise(body).alias("text"))


def markdown_table(df: DataFrame, headers: list[str], columns: list[str], order: list[str],
                   out: str = "body") -> DataFrame:
    """A table block (X6) as Markdown: header, separator, one line per row.
    Cells go through the report's cell sanitiser (text, ASCII only)."""
    head = "| " + " | ".join(headers) + " |"
    sep = "|" + "|".join(["---"] * len(headers)) + "|"
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[ascii_cell(F.col(c)) for c in columns]), F.lit(" |"))
    okeys = [f"_o{i}" for i in range(len(order))]
    rows = df.select(*[F.col(o).alias(k) for o, k in zip(order, okeys)], line.alias("_line"))
    agg = rows.agg(F.sort_array(F.collect_list(F.struct(*okeys, F.col("_line")))).alias("_rows"))
    return agg.select(F.concat_ws("\n", F.lit(head), F.lit(sep),
                                  F.array_join(F.transform("_rows", lambda r: r["_line"]), "\n")).alias(out))


# ------------------------------------------------------------ X3, X4, Q19

def kpi_record(budget: DataFrame, projects: DataFrame, grievance: DataFrame) -> DataFrame:
    """The one-row KPI record behind the narrative and the context."""
    return attach_scalars(attach_scalars(budget, projects), grievance)


# The summary writer's request and its close.
SUMMARY_REQUEST = (
    "Generate a concise executive summary for a government department's performance report.\n"
    "The summary should highlight key achievements, challenges, budget utilization, project status, and "
    "future focus areas.\n"
    "Keep it professional, data-driven, and suitable for an official report. Length should be around "
    "150-200 words.")
SUMMARY_CLOSE = (
    "IMPORTANT: Don't mention \"this report\" or refer to the above context directly. Write as if you are "
    "summarizing the department's performance for the period.")


def kpi_bullets(kpis: DataFrame) -> DataFrame:
    """The KPI bullet text of the summary context: one column ``bullets``."""
    text = F.concat_ws(
        "\n",
        F.lit("Key Metrics:"),
        F.concat(F.lit("- Budget: Total allocation "), currency("total_allocated"),
                 F.lit(", Utilization "), currency("total_utilized"),
                 F.lit(" ("), pct_text("overall_utilization_pct"), F.lit(")")),
        F.concat(F.lit("- Projects: Total "), int_text("total_projects"),
                 F.lit(", Completed "), int_text("completed_projects"),
                 F.lit(", Average implementation "), pct_text("avg_implementation")),
        F.concat(F.lit("- Top performing sector: "), F.col("top_sector")),
        F.concat(F.lit("- Grievances: Received "), int_text("total_received"),
                 F.lit(", Resolved "), int_text("total_resolved"),
                 F.lit(" ("), pct_text("resolution_rate"), F.lit(" resolution rate)")),
    )
    return kpis.select(text.alias("bullets"))


def summary_context(detailed: DataFrame, kpis: DataFrame | None, table: DataFrame, json_text: DataFrame,
                    detailed_col: str = "detailed_report", keys: list[str] | None = None) -> DataFrame:
    """Q19: the context given to the summary writer (X3), one per row of
    ``detailed``: the request, the report's detailed text, the KPI bullets,
    the whole JSON document and the whole table. ``kpis``, ``table`` and
    ``json_text`` are one-row frames; a missing one leaves its place empty, and
    without ``kpis`` (None, basic mode) no metrics are announced."""
    d = detailed.withColumn("bullets", F.lit("")) if kpis is None else attach_scalars(detailed, kpi_bullets(kpis))
    d = attach_scalars(attach_scalars(d, table), json_text)

    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    body = F.concat_ws(
        "\n",
        F.lit(SUMMARY_REQUEST), F.lit(""), F.lit("Report Content:"), text(detailed_col), F.lit(""),
        text("bullets"), F.lit(""), F.lit("Additional Data:"), text("json_text"), F.lit(""),
        F.lit("Tabular Data Sample:"), text("table_text"), F.lit(""), F.lit(SUMMARY_CLOSE))
    return d.select(*(keys or []), body.alias("summary_context"))


def fallback_narrative(kpis: DataFrame) -> DataFrame:
    """The deterministic report text used when no model text exists,
    filled from the KPI record (the reference's fallback states fixed
    figures; here they are computed)."""
    summary = F.concat(
        F.lit("The department has reported its performance across key metrics during the reporting "
              "period. Budget utilization stands at "), pct_text("overall_utilization_pct"),
        F.lit(" of an allocation of "), currency("total_allocated"),
        F.lit(", and "), pct_text("resolution_rate"),
        F.lit(" of public grievances have been resolved. The top performing sector is "),
        F.col("top_sector"), F.lit("."))
    budget = F.concat(F.lit("Budget utilization is "), currency("total_utilized"), F.lit(" against "),
                      currency("total_allocated"), F.lit(" allocated."))
    projects = F.concat(F.lit("There are "), int_text("total_projects"), F.lit(" projects, "),
                        int_text("completed_projects"), F.lit(" completed and "),
                        int_text("new_projects"), F.lit(" newly started; average implementation is "),
                        pct_text("avg_implementation"), F.lit("."))
    grievances = F.concat(F.lit("Of "), int_text("total_received"), F.lit(" grievances received, "),
                          int_text("total_resolved"), F.lit(" were resolved."))
    text = F.concat_ws("\n", F.lit("## Executive Summary"), F.lit(""), summary, F.lit(""),
                       F.lit("## Budget Performance Analysis"), F.lit(""), budget, F.lit(""),
                       F.lit("## Project Status"), F.lit(""), projects, F.lit(""),
                       F.lit("## Public Grievance Redressal"), F.lit(""), grievances)
    return kpis.select(text.alias("report_text"))


def item_narrative(items: DataFrame) -> DataFrame:
    """The report text of basic mode, when the optional tables are missing: what the
    item table (section, item, pct_achieved, allocated, utilized) tells. One row.

    A sentence whose figure is NULL (no cell holds a number) is left out, and so is
    a section without a sentence; an empty table gives an empty text.
    """
    row = items.agg(
        F.count("*").alias("n"), F.count_distinct("section").alias("sections"),
        F.sum("allocated").alias("allocated"), F.sum("utilized").alias("utilized"),
        F.avg("pct_achieved").alias("achieved"),
        F.count_if(F.col("pct_achieved") >= 100).alias("complete"))
    row = row.withColumn("utilization", F.try_divide(F.col("utilized"), F.col("allocated")) * 100)

    def section(title: str, *sentences: Column) -> Column:
        text = F.concat_ws(" ", *sentences)
        return F.when(text != "", F.concat(F.lit(f"## {title}\n\n"), text))

    some = F.when(F.col("n") > 0, F.lit("The department reports on "))
    summary = section(
        "Executive Summary",
        F.concat(some, int_text("n"), F.lit(" items in "), int_text("sections"), F.lit(" sections.")),
        F.concat(F.lit("Budget utilization stands at "), pct_text("utilization"), F.lit(" of an allocation of "),
                 currency("allocated"), F.lit(".")),
        F.concat(F.lit("On average "), pct_text("achieved"), F.lit(" of the targets has been achieved.")))
    budget = section(
        "Budget Performance Analysis",
        F.concat(F.lit("Budget utilization is "), currency("utilized"), F.lit(" against "), currency("allocated"),
                 F.lit(" allocated.")))
    projects = section(
        "Project Status",
        F.concat(F.when(F.col("achieved").isNotNull(), int_text("complete")), F.lit(" of "), int_text("n"),
                 F.lit(" items have reached their target.")))
    return row.select(F.concat_ws("\n\n", summary, budget, projects).alias("report_text"))


def json_context(doc: DataFrame) -> DataFrame:
    """The whole JSON document as prompt text (S11), pretty-printed."""
    pretty = F.to_json(F.struct(*[F.col(f"`{c}`") for c in doc.columns]), {"pretty": "true"})
    return doc.select(pretty.alias("json_text"))


# ------------------------------------------------------------- X2, Q22

def report_prompt(docs: DataFrame, text_col: str, table: DataFrame, json_text: DataFrame,
                  department: str, keys: list[str]) -> DataFrame:
    """Q22: one prompt per document: instructions, the tabular data as
    aligned text, the document's prose, the JSON data and the required
    sections (X2). ``table`` and ``json_text`` are one-row frames."""
    joined = attach_scalars(attach_scalars(docs, table), json_text)
    prompt = F.concat_ws(
        "\n",
        F.lit(prompt_preamble(department)), F.lit(""), F.lit("DATA SOURCES:"), F.lit(""),
        F.lit("Structured Data:"), F.col("table_text"), F.lit(""),
        F.lit("Unstructured Data:"), py_strip(F.col(text_col)), F.lit(""),
        F.lit("JSON Data:"), F.col("json_text"), F.lit(""),
        F.lit(prompt_sections_text()), F.lit(""), F.lit(PROMPT_TAIL))
    return joined.select(*keys, prompt.alias("prompt"))


def messages(texts: DataFrame, text_col: str, role: str, lead: str | None, keys: list[str]) -> DataFrame:
    """The two messages of one request to the writer, as rows (keys, ord, role,
    content): who it is (``system``), then the text of ``text_col`` (``user``),
    after ``lead`` and a blank line if there is one. A NULL text is an empty one;
    each row of ``texts`` gives its two, an empty frame none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    user = text if lead is None else F.concat(F.lit(lead + "\n\n"), text)
    both = F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("system").alias("role"), F.lit(role).alias("content")),
        F.struct(F.lit(1).alias("ord"), F.lit("user").alias("role"), user.alias("content")))
    return texts.select(*keys, F.inline(both))


# ----------------------------------------------------------- X5, Q20

# Headers of the report's tables and the columns under them.
TABLES = {
    "kpi_budget": (["Total Budget Allocated", "Total Budget Utilized", "Overall Utilization",
                    "Top Performing Sector"],
                   ["allocated_text", "utilized_text", "utilization_text", "top_sector"], ["top_sector"]),
    "kpi_projects": (["Total Projects", "Completed Projects", "New Projects Initiated", "Avg Implementation"],
                     ["total_projects_text", "completed_projects", "new_projects",
                      "avg_implementation_text"], ["total_projects"]),
    "kpi_egov": (["Online Services Available", "Monthly Portal Hits (Avg)", "E-Office Implementation",
                  "Training Sessions Conducted"],
                 ["online_services", "mean_hits_text", "item_pct", "training_sessions"],
                 ["training_sessions"]),
    "top_districts": (["District", "Budget Allocated (Cr)", "Budget Utilized (Cr)", "Implementation %",
                       "Population Covered"],
                      ["district", "allocated_text", "utilized_text", "implementation_text",
                       "population_text"], ["rank"]),
    "kpi_grievance": (["Total Grievances Received", "Total Grievances Resolved", "Overall Resolution Rate",
                       "Avg Resolution Time"],
                      ["total_received", "total_resolved", "resolution_rate_text", "avg_resolution_time"],
                      ["total_received"]),
}
# The report's sections in order, as (switch, section, blocks); a
# block is (number, kind, title, body), marked "+" if it needs the optional
# tables. A chart's body names its data, a table's title names its result.
LAYOUT = [
    ("budget", "Budget Performance Analysis", [
        (40, "title", "Budget Performance Analysis", None),
        (41, "chart", "Budget Allocation vs Utilization by Section", "budget_by_section"),
        (42, "table+", "kpi_budget", None),
        (43, "chart+", "Monthly Budget Allocation and Utilization Trends", "monthly_budget_projects"),
        (44, "chart+", "Budget Allocation by Sector", "sector_treemap")]),
    ("projects", "Project Status", [
        (50, "title", "Project Status", None),
        (51, "chart", "Overall Project Completion Status", "completion_status"),
        (52, "table+", "kpi_projects", None),
        (53, "chart+", "Implementation Progress by Sector", "sector_radar")]),
    ("egov", "E-Governance Implementation", [
        (60, "title", "E-Governance Implementation", None),
        (61, "chart", "E-Governance Implementation Progress", "egov_progress"),
        (62, "chart+", "Training Sessions and Portal Usage", "training_vs_online"),
        (63, "table+", "kpi_egov", None)]),
    ("district", "District-wise Performance", [
        (70, "title+", "District-wise Performance", None),
        (71, "chart+", "District Budget Heatmap", "district_heatmap"),
        (72, "chart+", "Budget Distribution by Groups", "balance_boxplot"),
        (73, "title+", "Top 5 Performing Districts", None),
        (74, "table+", "top_districts", None)]),
    ("correlation", "Performance Correlation Analysis", [
        (80, "title+", "Performance Correlation Analysis", None),
        (81, "chart+", "Correlation Between Key Metrics", "district_correlation"),
        (82, "chart+", "Implementation vs Population", "implementation_scatter"),
        (83, "text+", None, CORRELATION_NOTE)]),
    ("grievance", "Public Grievance Analysis", [
        (90, "title+", "Public Grievance Analysis", None),
        (91, "chart+", "Monthly Grievance Resolution", "grievance_resolution"),
        (92, "table+", "kpi_grievance", None)]),
]


def report_blocks(spark, parts: dict[str, DataFrame], narrative: DataFrame,
                  has_additional_data: bool = True,
                  include: tuple[str, ...] = ("budget", "projects", "egov", "district",
                                              "correlation", "grievance")) -> DataFrame:
    """Q20: the report as ordered blocks ``(ord, section, kind, title, body)``
    (X5). ``kind`` is ``title``, ``text``, ``chart`` (body = the chart-data
    query name) or ``table`` (body = Markdown). ``parts`` maps table names
    (the keys of ``TABLES``) to their query results; ``include`` selects
    sections (the UI's data-source switches). ``narrative`` has one row.

    One row holds the narrative's two texts and the Markdown of each table (one
    scalar subquery a table); its array of blocks is exploded once.
    """
    row = add_report_sections(narrative, "report_text", "markdown", "summary", "detailed") \
        .select("summary", "detailed")
    detailed = F.when(py_strip(F.col("detailed")) != "", F.col("detailed")).otherwise(F.lit(BASIC_ANALYSIS))
    blocks = [(10, "Executive Summary", "title", "Executive Summary", None),
              (11, "Executive Summary", "text", None, F.col("summary")),
              (20, "Detailed Analysis", "title", "Detailed Analysis", None),
              (21, "Detailed Analysis", "text", None, detailed)]
    if has_additional_data:
        blocks.append((30, "Key Performance Metrics", "title", "Key Performance Metrics", None))
    for switch, section, entries in LAYOUT:
        if switch not in include:
            continue
        for ord_, kind, title, body in entries:
            if kind.endswith("+") and not has_additional_data:
                continue
            kind = kind.rstrip("+")
            if kind == "table":
                row = attach_scalars(row, markdown_table(parts[title], *TABLES[title], out=f"table_{title}"))
                body = F.col(f"table_{title}")
            blocks.append((ord_, section, kind, title, body))

    def struct(ord_, section, kind, title, body):
        return F.struct(F.lit(ord_).alias("ord"), F.lit(section).alias("section"), F.lit(kind).alias("kind"),
                        F.lit(title).cast("string").alias("title"),
                        (body if isinstance(body, Column) else F.lit(body)).cast("string").alias("body"))

    return row.select(F.explode(F.array(*[struct(*b) for b in blocks])).alias("b")).select("b.*")


def render_markdown(blocks: DataFrame) -> DataFrame:
    """The report as one Markdown document (S12 text form)."""
    line = (F.when(F.col("kind") == "title", F.concat(F.lit("## "), F.col("title")))
             .when(F.col("kind") == "chart", F.concat(F.lit("*Chart: "), F.col("title"),
                                                      F.lit("* (data: "), F.col("body"), F.lit(")")))
             .otherwise(F.col("body")))
    agg = blocks.select("ord", line.alias("line")).agg(
        F.sort_array(F.collect_list(F.struct("ord", "line"))).alias("_l"))
    return agg.select(F.array_join(F.transform("_l", lambda r: r["line"]), "\n\n").alias("markdown"))
