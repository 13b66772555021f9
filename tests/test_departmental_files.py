"""The departmental path on files of our own, with results worked out by hand."""

import pytest

from budgetlens.operators.binning import Bins
from budgetlens.plans import report
from budgetlens.plans import report_queries as rq
from budgetlens.plans.departmental import departmental_report
from budgetlens.sources import departmental as D
from budgetlens.sources.files import load_sources
from tests import departmental_files as files


@pytest.fixture(scope="module")
def src(spark, tmp_path_factory):
    return load_sources(spark, files.write(tmp_path_factory.mktemp("own")))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_traps_of_the_files(src):
    sectors = {r.Sector: r for r in src.sectors.collect()}
    assert sectors["Health"].Beneficiaries is None and sectors["Total"].Implementation_Percentage == 83
    items = src.items.orderBy("ord").collect()
    assert items[0].Target == "10 km, paved" and items[3].Target is None and len(items) == 4
    assert src.text.collect()[0].text == "Bridges were built.\nWells were dug."
    assert src.has_additional_data and src.rejected_cells.count() == 0


@pytest.mark.parametrize("totals,alloc,projects,completed,avg", [("exclude", 400.0, 15, 6, "83.3%"),
                                                                 ("as_is", 800.0, 30, 12, "83.2%")])
def test_kpis_in_both_totals_modes(src, totals, alloc, projects, completed, avg):
    b = one(rq.q13_kpi_budget(D.sectors(src), totals))
    assert (b["total_allocated"], b["utilization_text"], b["top_sector"]) == (alloc, "62.5%", "Health")
    p = one(rq.q14_kpi_projects(D.sectors(src), D.months(src), totals))
    assert (p["total_projects"], p["completed_projects"], p["avg_implementation_text"]) == (projects, completed, avg)


def test_egov_and_grievance_records(src):
    def egov(sector, item, totals):
        return one(rq.q15_kpi_egov(D.sectors(src), D.months(src), D.items(src), sector, "E-Enablement", item,
                                   totals=totals))

    e = egov("E-Governance", "E-Office Implementation", "exclude")
    assert (e["online_services"], e["mean_hits_text"], e["item_pct"], e["training_sessions"]) == ("4", "200", "80", 12)
    e = egov("None", "None", "as_is")
    assert (e["online_services"], e["item_pct"], e["training_sessions"]) == ("N/A", "N/A", 24)
    g = one(rq.q17_kpi_grievance(D.months(src)))
    assert (g["total_received"], g["total_resolved"], g["resolution_rate_text"]) == (30, 29, "96.7%")


def test_series_and_groups(src):
    months = D.months(src)
    assert [r.month for r in rq.q7_training_vs_online(months, "month").collect()] == ["Apr-2023", "May-2023", "Jun-2023"]
    rates = {r.month: r.resolution_rate for r in rq.q11_grievance_resolution(months).collect()}
    assert rates == {"Apr-2023": 90.0, "May-2023": 100.0, "Jun-2023": None}
    assert {r.month for r in rq.q11_grievance_resolution(months, "as_is").collect()} == {*rates, "Total"}
    m = {r.month: (r.utilization_pct, r.net_change) for r in rq.q5_monthly_budget_projects(months).collect()}
    assert m == {"Apr-2023": (50.0, -1), "May-2023": (75.0, 1), "Jun-2023": (0.0, 0)}
    sections = {r.section: (r.allocated, r.utilized) for r in rq.q1_budget_by_section(D.items(src)).collect()}
    assert sections == {"Roads": (120.5, 70.25), "E-Enablement": (10.0, 5.0), "Water": (40.0, 0.0)}
    bins = [(r.bin, r.n) for r in rq.q2_completion_status(D.items(src)).collect()]
    assert bins == [("0-25%", 1), ("26-50%", 0), ("51-75%", 1), ("76-100%", 2)]


@pytest.mark.parametrize("mode,ratio", [("recompute", 70.0), ("sum", 140.0)])
def test_district_given_twice(src, mode, ratio):
    rows = {r.district: r for r in rq.q6_district_heatmap(D.districts(src), mode).collect()}
    assert len(rows) == 3 and rows["North"].utilization_ratio == ratio
    assert rows["South"].allocation_pct == 30.0 and rows["East"].utilization_pct == 0.0


def test_districts_ranked_and_boxed(src):
    top = rq.q16_top_districts(D.districts(src)).orderBy("rank").collect()
    assert [(r.district, r.allocated_text) for r in top] == [
        ("East", "Rs. 20.00"), ("North", "Rs. 50.00"), ("South", "Rs. 30.00"), ("North", "Rs. 50.00")]
    pts = rq.q10_implementation_scatter(D.districts(src), label_k=2).collect()
    assert len(pts) == 4 and sorted(r.colour_value for r in pts if r.labelled) == [50.0, 50.0]
    box = rq.q8_box_by_bin(D.districts(src), "implementation_percentage", "budget_allocation",
                           Bins((0, 65, 100, 200), ("low", "high", "none"))).collect()
    assert [(r.bin, r.n, r.median) for r in box] == [("low", 2, 40.0), ("high", 2, 35.0), ("none", 0, None)]


def test_whole_report(spark, tmp_path):
    out = departmental_report(spark, files.write(tmp_path), period=("2023-05-01", "2023-06-30"))
    assert [r.month for r in out["training_vs_online"].collect()] == ["May-2023", "Jun-2023"]
    assert [r.month for r in out["monthly_budget_projects"].collect()] == ["May-2023", "Jun-2023"]
    blocks = {b.ord: b for b in out["blocks"].collect()}
    assert len(blocks) == 30 and blocks[92].body.endswith("| 20 | 20 | 100.0% | 5 days |")
    assert blocks[42].body.splitlines()[2] == "| Rs. 400.00 Cr | Rs. 250.00 Cr | 62.5% | Health |"
    for text in (out["prompt"].collect()[0].prompt, out["summary_context"].collect()[0].summary_context):
        lines = text.splitlines()
        header = next(x for x in lines if "Percentage Achieved" in x)
        table = lines[lines.index(header) + 1:][:4]
        assert header.split()[:2] == ["Section", "Item"]
        assert [x.split()[-3:] for x in table] == [["60", "100.5", "50.25"], ["100", "20.0", "20.0"],
                                                   ["80", "10.0", "5.0"], ["25", "40.0", "0.0"]]
        assert all(f"note number {i}\"" in text for i in range(60))     # the whole JSON document
    prompt = out["prompt"].collect()[0].prompt
    assert "Wells were dug." in prompt
    told = {r.ord: r for r in out["messages"].collect()}
    assert [told[k].role for k in (0, 1)] == ["system", "user"] and len(told) == 2
    assert told[0].content.startswith("You are an expert AI report generator")
    assert told[1].content == ("Generate a detailed monthly departmental report based on the following data:"
                               "\n\n" + prompt)
    asked = {r.ord: r.content for r in out["summary_messages"].collect()}
    assert asked[1] == out["summary_context"].collect()[0].summary_context
    assert "executive summaries" in asked[0]
    assert "Received 20, Resolved 20 (100.0%" in out["summary_context"].collect()[0].summary_context


def test_sections_can_be_left_out(spark, tmp_path):
    out = departmental_report(spark, files.write(tmp_path), include=("budget", "grievance"))
    assert {b.section for b in out["blocks"].collect()} == {
        "Executive Summary", "Detailed Analysis", "Key Performance Metrics", "Budget Performance Analysis",
        "Public Grievance Analysis"}


@pytest.mark.parametrize("change", [{"DistrictData.csv": None},
                                    {"DistrictData.csv": files.DISTRICTS.replace("District,", "Place,")}])
def test_optional_file_missing_or_with_another_header(spark, tmp_path, change):
    folder = files.write(tmp_path, change)
    assert not load_sources(spark, folder).has_additional_data
    blocks = departmental_report(spark, folder)["blocks"].collect()
    assert sorted(b.ord for b in blocks) == [10, 11, 20, 21, 40, 41, 50, 51, 60, 61]


def test_bad_cells_are_listed(spark, tmp_path):
    folder = files.write(tmp_path, {"SampleTabularData.csv": files.ITEMS.replace("50.25", "about 50"),
                                    "TimeSeriesData.csv": files.MONTHS.replace("10,9,1", "10,9.5,1")})
    bad = departmental_report(spark, folder)["rejected_cells"].collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.column, r.value) for r in bad) == [
        ("SampleTabularData.csv", "Budget Utilized", "about 50"),
        ("TimeSeriesData.csv", "Grievances_Resolved", "9.5")]


def test_real_short_texts_stay(spark, src):
    """A short summary and a short detailed text are shown, not replaced."""
    kpis = report.kpi_record(rq.q13_kpi_budget(D.sectors(src)), rq.q14_kpi_projects(D.sectors(src), D.months(src)),
                             rq.q17_kpi_grievance(D.months(src)))
    parts = {"kpi_budget": kpis, "kpi_projects": kpis, "kpi_grievance": kpis,
             "top_districts": rq.q16_top_districts(D.districts(src))}
    text = spark.createDataFrame([("## Executive Summary\n\nAll 12 roads are open.\n\n## Next\nMore.",)],
                                 "report_text string")
    got = {b.ord: b.body for b in report.report_blocks(spark, parts, text, include=("budget",)).collect()}
    assert got[11] == "All 12 roads are open." and got[21] == "## Next\nMore."
    empty = spark.createDataFrame([("",)], "report_text string")
    got = {b.ord: b.body for b in report.report_blocks(spark, parts, empty, include=("budget",)).collect()}
    assert got[21] == report.BASIC_ANALYSIS


def test_basic_mode_tells_what_the_items_tell(spark, tmp_path):
    """Without the time series: sentences from the item table, no heading alone, no empty metrics."""
    got = departmental_report(spark, files.write(tmp_path, {"TimeSeriesData.csv": None}))
    bodies = [r.body for r in got["blocks"].orderBy("ord").collect() if r.kind == "text"]
    assert "4 items in 3 sections. Budget utilization stands at 44.1% of an allocation of Rs. 170.50 Cr" in bodies[0]
    assert "Budget utilization is Rs. 75.25 Cr against Rs. 170.50 Cr allocated." in bodies[1]
    assert "1 of 4 items have reached their target." in bodies[1]
    assert "Key Metrics" not in one(got["summary_context"])["summary_context"]


def test_item_narrative_without_figures(spark):
    schema = "section string, item string, pct_achieved double, allocated double, utilized double"
    empty = spark.createDataFrame([], schema)
    assert one(report.item_narrative(empty)) == {"report_text": ""}
    bare = spark.createDataFrame([("a", "b", None, None, None)], schema)
    assert one(report.item_narrative(bare))["report_text"] == \
        "## Executive Summary\n\nThe department reports on 1 items in 1 sections."
