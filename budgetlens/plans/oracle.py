"""Independent DuckDB SQL for each registered query (the correctness oracle).

Each string runs on DuckDB with the star-schema tables registered as views
and must return the same columns and values as the Spark query of the same
name. Conventions shared with the Spark side: money is summed as DECIMAL
and reported as DOUBLE; ratios are ``a / b * 100`` on doubles; fixed-point
texts print a value first rounded half-to-even; order-dependent float
aggregates are rounded to 6 decimals.
"""

from __future__ import annotations

# Fixed values, stated here on their own so that a wrong constant in the
# library shows as a difference.
PY_WHITESPACE = (r"[\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                 r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
SUMMARY_HEADINGS = ["# Executive Summary", "## Executive Summary", "Executive Summary", "EXECUTIVE SUMMARY",
                    "**Executive Summary**"]
SUMMARY_ENDS = ["# ", "## ", "\n\n", "**", "Budget Performance", "Infrastructure Project"]
NO_SUMMARY = ("This comprehensive report analyzes the performance of the Panchayati Raj Department across key areas "
              "including budget utilization, project status, e-governance initiatives, and district-wise "
              "achievements for the reporting period.")
RESOLUTION_TIME = "5 days"
MEASURES = ["budget_allocation", "budget_utilization", "projects_count", "implementation_percentage",
            "population_covered", "grievances_resolved"]
SECTION, SECTOR, ITEM = "SMALL", "Brand#13", "red widget"
BALANCE = [(0, "Low (<=3000)", -1000, 3000), (1, "Medium (3000-6000]", 3000, 6000),
           (2, "High (6000-9000]", 6000, 9000), (3, "Very High (>9000)", 9000, 12000)]
COMPLETION = [(0, "0-25%", 0, 25), (1, "26-50%", 25, 50), (2, "51-75%", 50, 75), (3, "76-100%", 75, 100)]
VARIANTS = ["raw", "heading", "heading_blank"]
REQUIRED = ["Executive Summary", "Budget Performance Analysis", "Infrastructure Project Status",
            "E-Governance Implementation Progress", "Key Government Programs", "Public Grievance Redressal",
            "Health and Education Initiatives", "Challenges and Mitigation Strategies",
            "District-wise Performance Analysis", "Recommendations for the Next Quarter",
            "Future Outlook and Strategic Plan"]
PROMPT_START = """Using the following data, generate a comprehensive, insightful monthly departmental report for the \
Panchayati Raj Department of Arunachal Pradesh.

FORMAT INSTRUCTIONS:
1. Start with an "Executive Summary" section that provides a concise overview (150-200 words)
2. Use clear section headers preceded by '##' for each section
3. Include relevant data points and metrics in your analysis
4. Format key statistics in bulleted lists where appropriate
5. Include specific numerical values from the data"""
PROMPT_END = ("The report should include data-driven insights, highlight achievements, identify challenges, and "
              "provide actionable recommendations based on current metrics.")
SUMMARY_START = """Generate a concise executive summary for a government department's performance report.
The summary should highlight key achievements, challenges, budget utilization, project status, and future focus areas.
Keep it professional, data-driven, and suitable for an official report. Length should be around 150-200 words."""
SUMMARY_END = ("IMPORTANT: Don't mention \"this report\" or refer to the above context directly. Write as if you are "
               "summarizing the department's performance for the period.")
CORRELATION_TEXT = (
    "The correlation analysis reveals the relationship between key performance indicators. Strong positive "
    "correlations indicate metrics that tend to increase together, while negative correlations indicate inverse "
    "relationships. The scatter plot demonstrates how implementation progress relates to population coverage, with "
    "bubble size representing project count and color intensity showing budget allocation.")


def lit(s: str) -> str:
    """A DuckDB string literal; newlines become chr(10)."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    out = " || chr(10) || ".join(quoted)
    return f"({out})" if len(parts) > 1 else out


def dec(c: str) -> str:
    return f"cast({c} as decimal(18,2))"


def ratio(num: str, den: str) -> str:
    return f"(cast({num} as double) / nullif(cast({den} as double), 0) * 100.0)"


def guarded(num: str, den: str) -> str:
    return f"(CASE WHEN cast({den} as double) > 0 THEN cast({num} as double) / cast({den} as double) * 100.0 ELSE 0.0 END)"


def pct_text(x: str, d: int = 1) -> str:
    return f"printf('%.{d}f%%', round_even({x}, {d}))"


def num_text(x: str, d: int = 0) -> str:
    return f"printf('%.{d}f', round_even({x}, {d}))"


def money_text(x: str, unit: str = " Cr") -> str:
    return f"printf('Rs. %.2f{unit}', round_even({x}, 2))"


UTIL = f"{dec('l_extendedprice')} * (1 - {dec('l_discount')})"

PART_FACT = f"""
lp AS (
  SELECT l_partkey, sum({dec('l_extendedprice')}) AS alloc, sum({UTIL}) AS util,
         count(*) AS lines, count(*) FILTER (WHERE l_linestatus = 'F') AS finished_lines,
         sum({dec('l_quantity')}) AS quantity
  FROM lineitem GROUP BY l_partkey),
pf AS (
  SELECT p_partkey, p_name, p_type, p_brand, alloc, util, lines, finished_lines, quantity
  FROM part LEFT JOIN lp ON p_partkey = l_partkey)"""

SECTOR_FACT = PART_FACT + f""",
sf AS (
  SELECT p_brand AS sector,
         cast(coalesce(sum(alloc), 0) as double) AS budget_allocation,
         cast(coalesce(sum(util), 0) as double) AS budget_utilization,
         cast(coalesce(sum(lines), 0) as bigint) AS projects_count,
         {ratio('coalesce(sum(finished_lines), 0)', 'coalesce(sum(lines), 0)')} AS implementation_percentage
  FROM pf GROUP BY p_brand)"""

DISTRICT_FACT = f"""
lo AS (
  SELECT l_orderkey, sum({dec('l_extendedprice')}) AS alloc, sum({UTIL}) AS util,
         count(*) FILTER (WHERE l_returnflag = 'R') AS returned_lines
  FROM lineitem GROUP BY l_orderkey),
po AS (
  SELECT o_custkey, sum(alloc) AS alloc, sum(util) AS util, sum(returned_lines) AS returned_lines,
         count(*) AS orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished
  FROM orders LEFT JOIN lo ON o_orderkey = l_orderkey GROUP BY o_custkey),
pn AS (
  SELECT c_nationkey, coalesce(sum(alloc), 0) AS alloc, coalesce(sum(util), 0) AS util,
         coalesce(sum(orders), 0) AS orders, coalesce(sum(finished), 0) AS finished,
         count(*) AS customers, coalesce(sum(returned_lines), 0) AS returned_lines
  FROM customer LEFT JOIN po ON c_custkey = o_custkey GROUP BY c_nationkey),
d AS (
  SELECT n_name AS district, cast(alloc as double) AS budget_allocation,
         cast(util as double) AS budget_utilization, cast(orders as bigint) AS projects_count,
         {ratio('finished', 'orders')} AS implementation_percentage,
         cast(customers as bigint) AS population_covered,
         cast(returned_lines as bigint) AS grievances_resolved
  FROM pn JOIN nation ON c_nationkey = n_nationkey)"""

MONTHS = f"""
m AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS month,
         cast(sum({dec('o_totalprice')}) as double) AS budget_allocation,
         cast(coalesce(sum({dec('o_totalprice')}) FILTER (WHERE o_orderstatus = 'F'), 0) as double)
           AS budget_utilization,
         count(*) AS grievances_received,
         count(*) FILTER (WHERE o_orderstatus <> 'O') AS grievances_resolved,
         count(*) FILTER (WHERE o_orderstatus = 'F') AS projects_completed,
         count(*) FILTER (WHERE o_orderstatus = 'O') AS new_projects_started
  FROM orders GROUP BY 1)"""

DAYS = """
a AS (
  SELECT strftime(ts, '%Y-%m-%d') AS day,
         count(*) FILTER (WHERE event_type = 'signup') AS training_sessions,
         count(*) FILTER (WHERE event_type = 'view') AS online_service_hits
  FROM events GROUP BY 1)"""


def bins_values(bins) -> str:
    rows = ", ".join(f"({i}, {lit(lab)}, {float(lo)}::DOUBLE, {float(hi)}::DOUBLE)" for i, lab, lo, hi in bins)
    return f"b(bin_ord, bin, lo, hi) AS (VALUES {rows})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A{PY_WHITESPACE}+|{PY_WHITESPACE}+\\z', '', 'g')"


def locate_from(needle: str, text: str, start: str) -> str:
    rel = f"strpos(substr({text}, {start}), {needle})"
    return f"(CASE WHEN {start} >= 1 AND {rel} > 0 THEN {rel} + {start} - 1 ELSE 0 END)"


# ---------------------------------------------------------------- report

SQL = {}

SQL["budget_by_section"] = f"""
WITH {PART_FACT}
SELECT p_type AS section, cast(coalesce(sum(alloc), 0) as double) AS allocated,
       cast(coalesce(sum(util), 0) as double) AS utilized,
       {guarded('coalesce(sum(util), 0)', 'coalesce(sum(alloc), 0)')} AS utilization_pct
FROM pf WHERE p_type IS NOT NULL GROUP BY p_type ORDER BY section"""

SQL["completion_status"] = f"""
WITH {bins_values(COMPLETION)},
x AS (SELECT l_quantity * 2 - 4 AS v FROM lineitem),
c AS (SELECT bin_ord, count(*) AS n FROM x JOIN b ON v > lo AND v <= hi GROUP BY bin_ord),
f AS (SELECT b.bin_ord, b.bin, cast(coalesce(c.n, 0) as bigint) AS n FROM b LEFT JOIN c USING (bin_ord))
SELECT bin_ord, bin, n, cast(n as double) / cast(sum(n) OVER () as double) * 100.0 AS share_pct
FROM f ORDER BY bin_ord"""

SQL["completion_outside"] = """
WITH x AS (SELECT l_quantity * 2 - 4 AS v FROM lineitem)
SELECT count(*) FILTER (WHERE v <= 0) AS n_below, count(*) FILTER (WHERE v > 100) AS n_above,
       count(*) FILTER (WHERE v IS NULL) AS n_null FROM x"""

SQL["egov_progress"] = f"""
WITH {PART_FACT}
SELECT p_name AS item, {ratio('finished_lines', 'lines')} AS pct_achieved,
       {num_text(ratio('finished_lines', 'lines'))} || '%' AS label, p_partkey AS item_key
FROM pf WHERE p_type = {lit(SECTION)}"""

SQL["sector_radar"] = f"""
WITH {SECTOR_FACT},
top AS (SELECT sector, implementation_percentage AS value FROM sf
        ORDER BY implementation_percentage DESC NULLS LAST, sector LIMIT 8),
r AS (SELECT row_number() OVER (ORDER BY value DESC NULLS LAST, sector) AS point, sector, value FROM top),
n AS (SELECT count(*) AS n_points FROM r),
p AS (SELECT point, sector, value, 2 * pi() * (point - 1) / n_points AS angle FROM r, n)
SELECT point, sector, value, angle FROM p
UNION ALL
SELECT (SELECT n_points FROM n) + 1, sector, value, angle FROM p WHERE point = 1"""

SQL["monthly_budget_projects"] = f"""
WITH {MONTHS}
SELECT month, budget_allocation, budget_utilization,
       {ratio('budget_utilization', 'budget_allocation')} AS utilization_pct,
       round_even({ratio('budget_utilization', 'budget_allocation')}, 1) AS utilization_pct_1dp,
       projects_completed, new_projects_started,
       projects_completed - new_projects_started AS net_change,
       (row_number() OVER (ORDER BY month) - 1) % 2 = 0 AS show_label
FROM m"""

SQL["district_heatmap"] = f"""
WITH {DISTRICT_FACT}
SELECT district, budget_allocation, budget_utilization,
       round(budget_allocation / max(budget_allocation) OVER () * 100.0, 6) AS allocation_pct,
       round(budget_utilization / max(budget_utilization) OVER () * 100.0, 6) AS utilization_pct,
       round({ratio('budget_utilization', 'budget_allocation')}, 6) AS utilization_ratio
FROM d"""

SQL["training_vs_online"] = f"""
WITH {DAYS}
SELECT day, training_sessions, online_service_hits FROM a"""

SQL["balance_boxplot"] = f"""
WITH pc AS (SELECT o_custkey, sum({dec('o_totalprice')}) AS spend FROM orders GROUP BY o_custkey),
cv AS (SELECT c_acctbal, cast(coalesce(spend, 0) as double) AS v
       FROM customer LEFT JOIN pc ON c_custkey = o_custkey),
{bins_values(BALANCE)},
x AS (SELECT bin_ord, v FROM cv JOIN b ON c_acctbal > lo AND c_acctbal <= hi),
q AS (SELECT bin_ord, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3 FROM x GROUP BY bin_ord),
w AS (SELECT x.bin_ord,
             min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
             max(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
             count(*) FILTER (WHERE NOT (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))) AS n_outliers
      FROM x JOIN q USING (bin_ord) GROUP BY x.bin_ord)
SELECT b.bin_ord, b.bin, cast(coalesce(q.n, 0) as bigint) AS n,
       round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(whisker_low, 6) AS whisker_low, round(whisker_high, 6) AS whisker_high,
       cast(coalesce(w.n_outliers, 0) as bigint) AS n_outliers
FROM b LEFT JOIN q USING (bin_ord) LEFT JOIN w USING (bin_ord) ORDER BY b.bin_ord"""


SQL["balance_outliers"] = f"""
WITH pc AS (SELECT o_custkey, sum({dec('o_totalprice')}) AS spend FROM orders GROUP BY o_custkey),
cv AS (SELECT c_acctbal, cast(coalesce(spend, 0) as double) AS v
       FROM customer LEFT JOIN pc ON c_custkey = o_custkey),
{bins_values(BALANCE)},
x AS (SELECT bin_ord, v FROM cv JOIN b ON c_acctbal > lo AND c_acctbal <= hi),
q AS (SELECT bin_ord, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM x GROUP BY bin_ord)
SELECT x.bin_ord, v AS order_value FROM x JOIN q USING (bin_ord)
WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)"""


def _corr_sql() -> str:
    cols = MEASURES
    parts = []
    for i in range(len(cols)):
        for j in range(i):
            x, y = f"cast({cols[i]} as double)", f"cast({cols[j]} as double)"
            parts.append(
                f"SELECT {lit(cols[i])} AS var_x, {lit(cols[j])} AS var_y, "
                f"round(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0), 6) AS corr FROM d")
    return f"WITH {DISTRICT_FACT}\n" + "\nUNION ALL\n".join(parts)


SQL["district_correlation"] = _corr_sql()

SQL["implementation_scatter"] = f"""
WITH {DISTRICT_FACT},
fit AS (SELECT regr_slope(cast(population_covered as double), implementation_percentage) AS slope,
               regr_intercept(cast(population_covered as double), implementation_percentage) AS intercept
        FROM d),
top AS (SELECT district FROM d ORDER BY budget_allocation DESC NULLS LAST, district LIMIT 5)
SELECT district, implementation_percentage AS x, cast(population_covered as double) AS y,
       projects_count * 20 AS bubble_size, budget_allocation AS colour_value,
       round(slope * implementation_percentage + intercept, 4) AS trend,
       round(cast(population_covered as double) - (slope * implementation_percentage + intercept), 4) AS residual,
       district IN (SELECT district FROM top) AS labelled
FROM d, fit"""

SQL["grievance_resolution"] = f"""
WITH {MONTHS}
SELECT month, grievances_received, grievances_resolved,
       {ratio('grievances_resolved', 'grievances_received')} AS resolution_rate,
       cast(100.0 as double) AS reference_line
FROM m"""

SQL["sector_treemap"] = f"""
WITH {SECTOR_FACT},
t AS (SELECT cast(sum(cast(budget_allocation as decimal(38,4))) as double) AS tot FROM sf)
SELECT sector, budget_allocation, implementation_percentage,
       sector || chr(10) || {money_text('budget_allocation', 'Cr')} || chr(10) || '('
         || cast(cast(trunc(implementation_percentage) as bigint) as varchar) || '%)' AS label,
       round(budget_allocation / tot * 100.0, 6) AS share_pct,
       implementation_percentage / 100.0 AS colour_value
FROM sf, t ORDER BY budget_allocation DESC, sector"""

KPI_SECTORS = f"""{SECTOR_FACT},
k AS (SELECT cast(sum(cast(budget_allocation as decimal(38,4))) as double) AS total_allocated,
             cast(sum(cast(budget_utilization as decimal(38,4))) as double) AS total_utilized,
             (SELECT sector FROM sf WHERE implementation_percentage IS NOT NULL
              ORDER BY implementation_percentage DESC, sector LIMIT 1) AS top_sector,
             cast(coalesce(sum(projects_count), 0) as bigint) AS total_projects,
             avg(implementation_percentage) AS avg_impl,
             max(implementation_percentage) AS max_impl
      FROM sf)"""

SQL["kpi_budget"] = f"""
WITH {KPI_SECTORS}
SELECT total_allocated, total_utilized,
       {guarded('total_utilized', 'total_allocated')} AS overall_utilization_pct, top_sector,
       {money_text('total_allocated')} AS allocated_text, {money_text('total_utilized')} AS utilized_text,
       {pct_text(guarded('total_utilized', 'total_allocated'))} AS utilization_text
FROM k"""

SQL["kpi_projects"] = f"""
WITH {KPI_SECTORS},
o AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS completed_projects,
             count(*) FILTER (WHERE o_orderstatus = 'O') AS new_projects FROM orders)
SELECT total_projects, completed_projects, new_projects, round(avg_impl, 6) AS avg_implementation,
       cast(total_projects as varchar) AS total_projects_text,
       {pct_text('avg_impl')} AS avg_implementation_text
FROM k, o"""

SQL["kpi_egov"] = f"""
WITH {SECTOR_FACT}, {DAYS},
s1 AS (SELECT coalesce((SELECT cast(projects_count as varchar) FROM sf WHERE sector = {lit(SECTOR)}
                        LIMIT 1), 'N/A') AS online_services),
h AS (SELECT avg(cast(online_service_hits as double)) AS mean_hits FROM a),
t AS (SELECT cast(coalesce(sum(training_sessions), 0) as bigint) AS training_sessions FROM a),
i AS (SELECT coalesce((SELECT cast({ratio('finished_lines', 'lines')} as varchar) FROM pf
                        WHERE p_type = {lit(SECTION)} AND p_name = {lit(ITEM)}
                        ORDER BY p_partkey LIMIT 1), 'N/A') AS item_pct)
SELECT online_services, round(mean_hits, 6) AS mean_hits, {num_text('mean_hits')} AS mean_hits_text,
       item_pct, training_sessions
FROM s1, h, t, i"""

SQL["top_districts"] = f"""
WITH {DISTRICT_FACT}
SELECT row_number() OVER (ORDER BY implementation_percentage DESC NULLS LAST,
                                   budget_allocation DESC NULLS LAST, district) AS rank,
       district, budget_allocation, budget_utilization, implementation_percentage, population_covered,
       {money_text('budget_allocation', '')} AS allocated_text,
       {money_text('budget_utilization', '')} AS utilized_text,
       {pct_text('implementation_percentage')} AS implementation_text,
       cast(population_covered as varchar) AS population_text
FROM d ORDER BY implementation_percentage DESC NULLS LAST, budget_allocation DESC NULLS LAST, district
LIMIT 5"""

_GRIEVANCE = f"""
WITH g AS (SELECT count(*) AS r, count(*) FILTER (WHERE o_orderstatus <> 'O') AS s FROM orders)
SELECT cast(r as bigint) AS total_received, cast(s as bigint) AS total_resolved,
       {guarded('s', 'r')} AS resolution_rate, {pct_text(guarded('s', 'r'))} AS resolution_rate_text,
       {lit(RESOLUTION_TIME)} AS avg_resolution_time
FROM g"""
SQL["kpi_grievance"] = _GRIEVANCE
SQL["kpi_grievance_no_total"] = _GRIEVANCE

SQL["quick_stats"] = f"""
WITH {KPI_SECTORS}
SELECT 1 AS ord, 'Budget Utilization' AS metric, {pct_text(guarded('total_utilized', 'total_allocated'))} AS value,
       {money_text('total_utilized')} || ' / ' || {money_text('total_allocated')} AS subtext FROM k
UNION ALL
SELECT 2, 'Project Implementation', {pct_text('avg_impl')},
       'Total Projects: ' || cast(total_projects as varchar) FROM k
UNION ALL
SELECT 3, 'Top Performing Sector', top_sector, 'Implementation: ' || {pct_text('max_impl')} FROM k"""

# ------------------------------------------------------------------ text

SQL["text_functions"] = f"""
SELECT doc_id, cast(length(text) as bigint) AS n_chars,
       cast(length(regexp_replace(text, '[^\\x00-\\x7F]+', '', 'g')) as bigint) AS ascii_len,
       md5(regexp_replace(text, '[^\\x00-\\x7F]+', '', 'g')) AS ascii_md5,
       md5(regexp_replace(text, '[^\\x00-\\xFF]', '?', 'g')) AS latin1_md5,
       cast(length({strip('text')}) as bigint) AS stripped_len,
       cast(length(split_part(text, chr(10) || chr(10), 1)) as bigint) AS first_para_len,
       cast(strpos(text, 'the') as bigint) AS pos_the,
       cast({locate_from("'the'", 'text', '100')} as bigint) AS pos_the_after_100,
       cast(list_min(list_filter([strpos(text, '. '), strpos(text, ', '), strpos(text, chr(10))], lambda x: x > 0))
            as bigint) AS first_mark,
       contains(text, 'http') AS has_http,
       md5(CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END) AS preview_md5
FROM documents"""


def _variant_sql(variant: str) -> str:
    if variant == "raw":
        return "text"
    head = "## Executive Summary\n" + ("\n" if variant == "heading_blank" else "")
    return f"{lit(head)} || text || {lit(chr(10) * 2 + '## Details' + chr(10))} || text"


def _summary_sql(t: str, mode: str) -> str:
    cands = []
    for p in SUMMARY_HEADINGS:
        at = f"strpos({t}, {lit(p)})"
        start = f"({at} + {len(p)})"
        if mode == "markdown":
            ws = f"length(regexp_extract(substr({t}, {start}), '\\A{PY_WHITESPACE}*', 0))"
            start = f"({start} + {ws})"
        stops = ", ".join(locate_from(lit(m), t, start) for m in SUMMARY_ENDS)
        stop = f"list_min(list_filter([{stops}], lambda x: x > 0))"
        piece = strip(f"substr({t}, {start}, {stop} - {start})")
        cands.append(f"CASE WHEN {at} > 0 AND {stop} IS NOT NULL THEN {piece} END")
    by_heading = f"coalesce({', '.join(cands)}, '')"
    para = f"split_part({t}, chr(10) || chr(10), 1)"
    more_than, least = (50, 50) if mode == "compat" else (0, 1)
    chosen = (f"(CASE WHEN {by_heading} <> '' THEN {by_heading} "
              f"WHEN length({para}) > {more_than} THEN {strip(para)} ELSE '' END)")
    return f"(CASE WHEN length({chosen}) < {least} THEN {lit(NO_SUMMARY)} ELSE {chosen} END)"


def _sections_sql() -> str:
    parts = []
    for variant in VARIANTS:
        for mode in ("compat", "markdown"):
            parts.append(f"SELECT doc_id, {lit(variant)} AS variant, {lit(mode)} AS mode, "
                         f"{_variant_sql(variant)} AS t FROM documents")
    texts = "\nUNION ALL\n".join(parts)
    summary_c = _summary_sql("t", "compat")
    summary_m = _summary_sql("t", "markdown")
    rest = f"{strip('substr(t, strpos(t, s) + length(s))')}"
    return f"""
WITH x AS ({texts}),
y AS (SELECT doc_id, variant, mode, t,
             CASE WHEN mode = 'compat' THEN {summary_c} ELSE {summary_m} END AS s FROM x),
z AS (SELECT doc_id, variant, mode, s,
             CASE WHEN strpos(t, s) > 0 AND length({rest}) >= CASE mode WHEN 'compat' THEN 200 ELSE 1 END THEN {rest} ELSE t END AS dr
      FROM y)
SELECT doc_id, variant, mode, cast(length(s) as bigint) AS summary_len, md5(s) AS summary_md5,
       cast(length(dr) as bigint) AS detailed_len, md5(dr) AS detailed_md5
FROM z"""


SQL["report_sections"] = _sections_sql()

SQL["markdown_sections"] = f"""
WITH x AS (SELECT doc_id, regexp_split_to_array({_variant_sql('heading')}, '(?m)^## ') AS parts FROM documents),
y AS (SELECT doc_id, unnest(generate_series(0, len(parts) - 1)) AS ord, unnest(parts) AS chunk FROM x),
z AS (SELECT doc_id, cast(ord as bigint) AS ord,
             CASE WHEN ord > 0 THEN {strip("split_part(chunk, chr(10), 1)")} END AS title,
             CASE WHEN ord = 0 THEN {strip('chunk')}
                  WHEN strpos(chunk, chr(10)) > 0 THEN {strip('substr(chunk, strpos(chunk, chr(10)) + 1)')}
                  ELSE '' END AS body
      FROM y)
SELECT doc_id, ord, title, cast(length(body) as bigint) AS body_len, md5(body) AS body_md5
FROM z WHERE ord > 0 OR body <> ''"""

SQL["json_facts"] = """
WITH k AS (SELECT event_id, props, unnest(json_keys(props)) AS path FROM events)
SELECT event_id, path, json_extract_string(props, '$."' || path || '"') AS raw,
       TRY_CAST(json_extract_string(props, '$."' || path || '"') AS BIGINT) AS value FROM k"""


# -------------------------------------------------------------- assembly

KPI_RECORD = f"""{KPI_SECTORS},
o AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS completed_projects,
             count(*) FILTER (WHERE o_orderstatus = 'O') AS new_projects,
             count(*) AS total_received,
             count(*) FILTER (WHERE o_orderstatus <> 'O') AS total_resolved FROM orders),
kr AS (SELECT k.*, o.*,
              {guarded('total_utilized', 'total_allocated')} AS overall_utilization_pct,
              {guarded('total_resolved', 'total_received')} AS resolution_rate
       FROM k, o)"""

BULLETS = f"""concat_ws(chr(10),
  'Key Metrics:',
  '- Budget: Total allocation ' || {money_text('total_allocated')} || ', Utilization '
    || {money_text('total_utilized')} || ' (' || {pct_text('overall_utilization_pct')} || ')',
  '- Projects: Total ' || cast(total_projects as varchar) || ', Completed '
    || cast(completed_projects as varchar) || ', Average implementation ' || {pct_text('avg_impl')},
  '- Top performing sector: ' || top_sector,
  '- Grievances: Received ' || cast(total_received as varchar) || ', Resolved '
    || cast(total_resolved as varchar) || ' (' || {pct_text('resolution_rate')} || ' resolution rate)')"""

NARRATIVE_PARTS = [
    f"""'The department has reported its performance across key metrics during the reporting period. Budget '
    || 'utilization stands at ' || {pct_text('overall_utilization_pct')} || ' of an allocation of '
    || {money_text('total_allocated')} || ', and ' || {pct_text('resolution_rate')}
    || ' of public grievances have been resolved. The top performing sector is ' || top_sector || '.'""",
    f"""'Budget utilization is ' || {money_text('total_utilized')} || ' against ' || {money_text('total_allocated')}
    || ' allocated.'""",
    f"""'There are ' || cast(total_projects as varchar) || ' projects, ' || cast(completed_projects as varchar)
    || ' completed and ' || cast(new_projects as varchar) || ' newly started; average implementation is '
    || {pct_text('avg_impl')} || '.'""",
    """'Of ' || cast(total_received as varchar) || ' grievances received, ' || cast(total_resolved as varchar)
    || ' were resolved.'""",
]
NARRATIVE_REST = f"""concat_ws(chr(10), '## Budget Performance Analysis', '', {NARRATIVE_PARTS[1]}, '',
  '## Project Status', '', {NARRATIVE_PARTS[2]}, '', '## Public Grievance Redressal', '', {NARRATIVE_PARTS[3]})"""

SQL["narrative_text"] = f"""
WITH {KPI_RECORD}
SELECT concat_ws(chr(10), '## Executive Summary', '', {NARRATIVE_PARTS[0]}, '', {NARRATIVE_REST}) AS report_text
FROM kr"""


def _kpi_json_sql() -> str:
    exprs = {
        "allocated_text": money_text("total_allocated"),
        "utilized_text": money_text("total_utilized"),
        "utilization_text": pct_text("overall_utilization_pct"),
        "top_sector": "top_sector",
        "total_projects_text": "cast(total_projects as varchar)",
        "avg_implementation_text": pct_text("avg_impl"),
        "resolution_rate_text": pct_text("resolution_rate"),
        "avg_resolution_time": lit(RESOLUTION_TIME),
    }
    args = ", ".join(f"{lit(k)}, {e}" for k, e in exprs.items())
    return f"json_object({args})"


def _section_table_sql() -> str:
    """CTEs up to ``tt``: the sections as aligned text."""
    cols = ["section", "allocated", "utilized", "utilization_pct"]
    widths = ", ".join(f"cast(greatest({len(c)}, max(length({c}))) as integer) AS w{i}"
                       for i, c in enumerate(cols))
    head = " || '  ' || ".join(f"lpad({lit(c)}, w{i}, ' ')" for i, c in enumerate(cols))
    line = " || '  ' || ".join(f"lpad({c}, w{i}, ' ')" for i, c in enumerate(cols))
    util = guarded('coalesce(sum(util), 0)', 'coalesce(sum(alloc), 0)')
    return f"""
q1 AS (SELECT p_type AS section,
              printf('%.2f', round_even(cast(coalesce(sum(alloc), 0) as double), 2)) AS allocated,
              printf('%.2f', round_even(cast(coalesce(sum(util), 0) as double), 2)) AS utilized,
              printf('%.1f', round_even({util}, 1)) AS utilization_pct
       FROM pf WHERE p_type IS NOT NULL GROUP BY p_type),
w AS (SELECT {widths} FROM q1),
tb AS (SELECT w0, w1, w2, w3, string_agg({line}, chr(10) ORDER BY section) AS body
       FROM q1, w GROUP BY w0, w1, w2, w3),
tt AS (SELECT {head} || chr(10) || body AS table_text FROM tb),
js AS (SELECT {_kpi_json_sql()} AS json_text FROM kr)"""


SQL["summary_context"] = f"""
WITH {KPI_RECORD}, {_section_table_sql()}
SELECT concat_ws(chr(10), {lit(SUMMARY_START)}, '', 'Report Content:', {NARRATIVE_REST}, '', {BULLETS}, '',
  'Additional Data:', json_text, '', 'Tabular Data Sample:', table_text, '', {lit(SUMMARY_END)}) AS summary_context
FROM kr, tt, js"""


# Who the writers are told they are, and the line before the data.
REPORT_WRITER = (
    "You are an expert AI report generator specialized in government department reporting with data "
    "analysis expertise. Your task is to create clear, concise, and well-structured reports with properly"
    " formatted section headers. Always include an executive summary and organize content with markdown "
    "formatting. Focus on data-driven insights, key metrics, achievements, challenges, and actionable "
    "recommendations.")
SUMMARY_WRITER = (
    "You are an expert government report writer specializing in executive summaries. Your task is to "
    "create professional, concise summaries (150-200 words) that highlight key performance metrics, "
    "achievements, challenges, and strategic directions. Focus on clarity, quantitative data points, and "
    "actionable information. Do not use meta-language like 'this report' or refer to the document itself.")
DATA_LEAD = "Generate a detailed monthly departmental report based on the following data:"

SQL["summary_messages"] = f"""
SELECT cast(0 as bigint) AS ord, 'system' AS role, {lit(SUMMARY_WRITER)} AS content
UNION ALL SELECT cast(1 as bigint), 'user', summary_context FROM ({SQL["summary_context"]}) c"""


def _report_prompt_sql(last: str) -> str:
    sections = "REQUIRED REPORT SECTIONS:\n" + "\n".join(f"## {x}" for x in REQUIRED)
    return f"""
WITH {KPI_RECORD}, {_section_table_sql()},
p AS (SELECT doc_id, concat_ws(chr(10),
        {lit(PROMPT_START)}, '', 'DATA SOURCES:', '', 'Structured Data:', table_text, '',
        'Unstructured Data:', {strip('text')}, '', 'JSON Data:', json_text, '',
        {lit(sections)}, '', {lit(PROMPT_END)}) AS prompt
      FROM documents, tt, js)
{last}"""


SQL["report_prompt"] = _report_prompt_sql(
    "SELECT doc_id, cast(length(prompt) as bigint) AS prompt_len, md5(prompt) AS prompt_md5 FROM p")
SQL["report_messages"] = _report_prompt_sql(f""",
m AS (SELECT doc_id, 0 AS ord, 'system' AS role, {lit(REPORT_WRITER)} AS content FROM p
      UNION ALL SELECT doc_id, 1, 'user', {lit(DATA_LEAD)} || chr(10) || chr(10) || prompt FROM p)
SELECT doc_id, cast(ord as bigint) AS ord, role, cast(length(content) as bigint) AS content_len,
       md5(content) AS content_md5 FROM m""")


def _table_sql(headers: list[str], cells: str) -> str:
    """The Markdown of a one-row table."""
    head = "| " + " | ".join(headers) + " |\n|" + "|".join(["---"] * len(headers)) + "|\n| "
    return f"{lit(head)} || concat_ws(' | ', {cells}) || ' |'"


TOP_TABLE = """| District | Budget Allocated (Cr) | Budget Utilized (Cr) | Implementation % | Population Covered |
|---|---|---|---|---|"""
SQL["top_districts_table"] = f"""
WITH td AS ({SQL["top_districts"]})
SELECT {lit(TOP_TABLE)} || chr(10) || string_agg('| ' || concat_ws(' | ', district, allocated_text, utilized_text,
         implementation_text, population_text) || ' |', chr(10) ORDER BY rank) AS body FROM td"""


def _blocks_sql() -> str:
    budget = _table_sql(["Total Budget Allocated", "Total Budget Utilized", "Overall Utilization",
                         "Top Performing Sector"],
                        f"{money_text('total_allocated')}, {money_text('total_utilized')}, "
                        f"{pct_text('overall_utilization_pct')}, top_sector")
    projects = _table_sql(["Total Projects", "Completed Projects", "New Projects Initiated", "Avg Implementation"],
                          "cast(total_projects as varchar), cast(completed_projects as varchar), "
                          f"cast(new_projects as varchar), {pct_text('avg_impl')}")
    grievance = _table_sql(["Total Grievances Received", "Total Grievances Resolved", "Overall Resolution Rate",
                            "Avg Resolution Time"],
                           "cast(total_received as varchar), cast(total_resolved as varchar), "
                           f"{pct_text('resolution_rate')}, {lit(RESOLUTION_TIME)}")
    egov = _table_sql(["Online Services Available", "Monthly Portal Hits (Avg)", "E-Office Implementation",
                       "Training Sessions Conducted"],
                      "online_services, mean_hits_text, item_pct, cast(training_sessions as varchar)")
    titles = [(10, "Executive Summary", "Executive Summary"), (20, "Detailed Analysis", "Detailed Analysis"),
              (30, "Key Performance Metrics", "Key Performance Metrics"),
              (40, "Budget Performance Analysis", "Budget Performance Analysis"),
              (50, "Project Status", "Project Status"),
              (60, "E-Governance Implementation", "E-Governance Implementation"),
              (70, "District-wise Performance", "District-wise Performance"),
              (73, "District-wise Performance", "Top 5 Performing Districts"),
              (80, "Performance Correlation Analysis", "Performance Correlation Analysis"),
              (90, "Public Grievance Analysis", "Public Grievance Analysis")]
    charts = [(41, "Budget Performance Analysis", "Budget Allocation vs Utilization by Section", "budget_by_section"),
              (43, "Budget Performance Analysis", "Monthly Budget Allocation and Utilization Trends",
               "monthly_budget_projects"),
              (44, "Budget Performance Analysis", "Budget Allocation by Sector", "sector_treemap"),
              (51, "Project Status", "Overall Project Completion Status", "completion_status"),
              (53, "Project Status", "Implementation Progress by Sector", "sector_radar"),
              (61, "E-Governance Implementation", "E-Governance Implementation Progress", "egov_progress"),
              (62, "E-Governance Implementation", "Training Sessions and Portal Usage", "training_vs_online"),
              (71, "District-wise Performance", "District Budget Heatmap", "district_heatmap"),
              (72, "District-wise Performance", "Budget Distribution by Groups", "balance_boxplot"),
              (81, "Performance Correlation Analysis", "Correlation Between Key Metrics", "district_correlation"),
              (82, "Performance Correlation Analysis", "Implementation vs Population", "implementation_scatter"),
              (91, "Public Grievance Analysis", "Monthly Grievance Resolution", "grievance_resolution")]
    bodies = [(11, "Executive Summary", "text", "NULL", NARRATIVE_PARTS[0], "kr"),
              (21, "Detailed Analysis", "text", "NULL", NARRATIVE_REST, "kr"),
              (42, "Budget Performance Analysis", "table", "'kpi_budget'", budget, "kr"),
              (52, "Project Status", "table", "'kpi_projects'", projects, "kr"),
              (63, "E-Governance Implementation", "table", "'kpi_egov'", egov, f"({SQL['kpi_egov']})"),
              (74, "District-wise Performance", "table", "'top_districts'", "body",
               f"({SQL['top_districts_table']})"),
              (83, "Performance Correlation Analysis", "text", "NULL", lit(CORRELATION_TEXT), "kr"),
              (92, "Public Grievance Analysis", "table", "'kpi_grievance'", grievance, "kr")]
    rows = [f"SELECT {o} AS ord, {lit(sec)} AS section, 'title' AS kind, {lit(t)} AS title, "
            "cast(NULL as varchar) AS body" for o, sec, t in titles]
    rows += [f"SELECT {o}, {lit(sec)}, 'chart', {lit(t)}, {lit(b)}" for o, sec, t, b in charts]
    rows += [f"SELECT {o}, {lit(sec)}, '{kind}', {t}, {body} FROM {src}" for o, sec, kind, t, body, src in bodies]
    return f"WITH {KPI_RECORD}\n" + "\nUNION ALL\n".join(rows)


SQL["report_blocks"] = _blocks_sql()

SQL["missing_sections"] = f"""
WITH r(req_ord, title) AS (VALUES {", ".join(f"({i}, {lit(x)})" for i, x in enumerate(REQUIRED))}),
f AS (SELECT doc_id, title FROM ({SQL["markdown_sections"]}) WHERE title IS NOT NULL)
SELECT doc_id, cast(req_ord as bigint) AS req_ord, title
FROM (SELECT DISTINCT doc_id FROM documents) AS d, r
WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = d.doc_id AND f.title = r.title)"""

SQL["cell_functions"] = """
SELECT doc_id, md5(replace(text, chr(65533), '')) AS utf8_md5,
       md5(regexp_replace(text, '[^\\x00-\\x7F]+', '', 'g')) AS cell_md5, cast(n_chars as varchar) AS n_chars_cell
FROM documents"""

SQL["district_heatmap_tidy"] = f"""
WITH h AS ({SQL["district_heatmap"]})
SELECT district, 'allocation_pct' AS measure, allocation_pct AS value FROM h
UNION ALL SELECT district, 'utilization_pct', utilization_pct FROM h
UNION ALL SELECT district, 'utilization_ratio', utilization_ratio FROM h"""

SQL["event_types"] = "SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL"

SQL["section_aggregates"] = f"""
WITH {PART_FACT}
SELECT p_type AS section, cast(sum(alloc) as double) AS allocated, max(lines) AS most_lines,
       min(finished_lines) AS least_finished, count(p_partkey) AS n_items
FROM pf GROUP BY p_type"""

SQL["period_labels"] = """
SELECT strftime(ts, '%B %Y') AS period,
       strftime(date_trunc('month', ts) - INTERVAL 1 MONTH, '%Y-%m-%d') AS previous_month, count(*) AS n,
       min(strftime(ts, '%Y%m%d_%H%M%S')) AS first_id, max(strftime(ts, '%Y%m%d_%H%M%S')) AS last_id
FROM events GROUP BY 1, 2"""

SQL["month_weights"] = f"""
WITH {MONTHS},
t AS (SELECT *, cast(projects_completed + new_projects_started + grievances_received as double) AS s FROM m)
SELECT month, round(projects_completed / s, 6) AS w_projects_completed,
       round(new_projects_started / s, 6) AS w_new_projects_started,
       round(grievances_received / s, 6) AS w_grievances_received
FROM t"""

_GROUPED = "'Rs. ' || format('{{:,}}', cast(floor({x}) as bigint)) || ' Cr'"
_AMOUNT = (r"^\s*(?:Rs[.]?|INR|\x{20B9})?\s*([-+]?(?:[0-9]{1,3}(?:,[0-9]{2,3})*,[0-9]{3}|[0-9]+)(?:[.][0-9]+)?)"
           r"\s*(?:%|Cr[.]?|Crores?|Lakhs?|Lacs?)?\s*$")
SQL["document_facts"] = f"""
WITH {SECTOR_FACT},
d AS (
SELECT sector, CASE projects_count % 3
  WHEN 0 THEN '{{"Budget":{{"Allocated":"' || {money_text('budget_allocation')} || '","Utilized":"'
    || {_GROUPED.format(x='budget_utilization')} || '"}},"Status":{{"Projects":{{"Progress":"'
    || {pct_text('implementation_percentage')} || '","Count":' || projects_count || '}}}}}}'
  WHEN 1 THEN '{{"Budget":[{{"Year":"FY 2023-24","Lines":[["Allocated","' || {_GROUPED.format(x='budget_allocation')}
    || '"],["Utilized","' || {money_text('budget_utilization')} || '"]]}}],"Note":"' || projects_count || ' of 99 roads"}}'
  ELSE '{{"Levels":{{"a":{{"b":{{"c":{{"d":{{"e":"' || {pct_text('implementation_percentage')}
    || '"}}}}}}}}}},"Empty":{{}},"None":null,"List":[],"On":true,"odd key":' || projects_count || '}}' END AS json FROM sf),
f AS (
SELECT sector, t.fullkey AS path,
       CASE WHEN t.type IN ('OBJECT', 'ARRAY') THEN cast(t.value AS varchar) ELSE t.atom->>'$' END AS value
FROM d, json_tree(d.json) t
WHERE t.type NOT IN ('OBJECT', 'ARRAY') OR cast(t.value AS varchar) IN ('{{}}', '[]'))
SELECT sector, path, value,
       try_cast(replace(replace(regexp_extract(value, '{_AMOUNT}', 1), ',', ''), '+', '') AS double) AS number FROM f"""

SQL["line_ordinals"] = """
WITH n AS (
SELECT l_orderkey, l_linenumber,
       row_number() OVER (ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey,
                                   l_quantity) AS ordinal, count(*) OVER () AS total
FROM lineitem)
SELECT l_orderkey, l_linenumber, ordinal FROM n WHERE ordinal < total AND (ordinal - 1) % 2 = 0"""

SQL["item_table_chunks"] = """
WITH cells AS (
SELECT p_partkey AS k, coalesce(cast(p_partkey AS varchar), '') AS a, coalesce(p_name, '') AS b, coalesce(p_brand, '') AS c,
       coalesce(cast(p_size AS varchar), '') AS d, coalesce(cast(cast(p_retailprice AS decimal(18,2)) AS varchar), '') AS e
FROM part),
w AS (
SELECT cast(greatest(9, max(length(a))) AS integer) AS wa, cast(greatest(6, max(length(b))) AS integer) AS wb,
       cast(greatest(7, max(length(c))) AS integer) AS wc, cast(greatest(6, max(length(d))) AS integer) AS wd,
       cast(greatest(13, max(length(e))) AS integer) AS we FROM cells),
l AS (
SELECT row_number() OVER (ORDER BY k) - 1 AS pos,
       lpad(a, wa, ' ') || '  ' || lpad(b, wb, ' ') || '  ' || lpad(c, wc, ' ') || '  ' || lpad(d, wd, ' ') || '  '
         || lpad(e, we, ' ') AS line
FROM cells, w),
h AS (
SELECT lpad('p_partkey', wa, ' ') || '  ' || lpad('p_name', wb, ' ') || '  ' || lpad('p_brand', wc, ' ') || '  '
         || lpad('p_size', wd, ' ') || '  ' || lpad('p_retailprice', we, ' ') AS head FROM w),
t AS (
SELECT cast(floor(pos / 500) AS bigint) AS chunk, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY pos) AS body
FROM l GROUP BY 1),
x AS (
SELECT chunk, n_lines, CASE WHEN chunk = 0 THEN head || chr(10) || body ELSE body END AS text FROM t, h)
SELECT chunk, n_lines, length(text) AS n_chars, md5(text) AS text_md5 FROM x"""

SQL["price_bins"] = """
WITH b AS (SELECT DISTINCT cast(floor(p_retailprice) AS double) AS lo FROM part),
e AS (SELECT lo, lo + 1 AS hi FROM b)
SELECT lo, hi, count(l_extendedprice) AS n, cast(sum(cast(l_quantity AS decimal(18,2))) AS double) AS quantity
FROM e LEFT JOIN lineitem ON l_extendedprice > lo AND l_extendedprice <= hi GROUP BY lo, hi"""

SQL["value_sketches"] = """
WITH c AS (SELECT event_type, count(value) AS n FROM events GROUP BY event_type)
SELECT event_type, n, p, true AS within
FROM (SELECT event_type, n, unnest([0.25::double, 0.5::double, 0.75::double]) AS p FROM c WHERE n > 0)"""

# ------------------------------------------------------------- streaming

SQL["activity_windows_stream"] = """
WITH e AS (SELECT date_trunc('day', ts) AS ws, event_type, value FROM events)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(ws + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
       event_type, count(*) AS n, cast(sum(cast(value as decimal(18,2))) as double) AS value_sum
FROM e GROUP BY ws, event_type"""

SQL["events_bronze"] = """
SELECT event_type, count(*) AS n, cast(sum(cast(value as decimal(18,2))) as double) AS value_sum
FROM events GROUP BY event_type"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
