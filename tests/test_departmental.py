"""Golden values on the departmental sample files (FIXTURES.md section 3)."""

import pytest

from budgetlens.operators.binning import IMPLEMENTATION_BINS
from budgetlens.plans import report_queries as rq
from budgetlens.sources import departmental as D


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_load_traps(sources):
    sectors = {r.Sector: r for r in sources.sectors.collect()}
    assert sectors["Tourism"].Beneficiaries is None            # NA -> NULL
    assert sectors["Total"].Implementation_Percentage == 59    # trailing blank still an int
    months = {r.Month: r for r in sources.months.collect()}
    assert months["Total"].OnlineServiceHits == 71900
    districts = sources.districts.collect()
    assert len(districts) == 26 and districts[-1].Grievances_Resolved == 10
    assert sources.items.count() == 20
    assert sources.has_additional_data
    assert len(sources.text.collect()[0].text) == 3347
    assert len(sources.json.columns) == 11


@pytest.mark.parametrize("totals,alloc,util,projects,completed,started,avg", [
    ("as_is", 1822.86, 972.68, 290, 80, 72, 61.0),
    ("exclude", 911.43, 486.34, 145, 40, 36, 61.2),
])
def test_kpis(sources, totals, alloc, util, projects, completed, started, avg):
    b = one(rq.q13_kpi_budget(D.sectors(sources), totals))
    assert b["total_allocated"] == pytest.approx(alloc)
    assert b["total_utilized"] == pytest.approx(util)
    assert b["utilization_text"] == "53.4%"
    assert b["top_sector"] == "Public Services"
    p = one(rq.q14_kpi_projects(D.sectors(sources), D.months(sources), totals))
    assert (p["total_projects"], p["completed_projects"], p["new_projects"]) == (projects, completed, started)
    assert p["avg_implementation"] == pytest.approx(avg, abs=0.05)


def test_kpi_egov_and_grievance(sources):
    e = one(rq.q15_kpi_egov(D.sectors(sources), D.months(sources), D.items(sources),
                            "E-Governance", "E-Enablement", "E-Office Implementation", totals="as_is"))
    assert e["online_services"] == "18"
    assert e["mean_hits_text"] == "5992"
    assert e["item_pct"] == "80"
    assert e["training_sessions"] == 222
    e2 = one(rq.q15_kpi_egov(D.sectors(sources), D.months(sources), D.items(sources),
                             "Nope", "E-Enablement", "Nope"))
    assert e2["online_services"] == "N/A" and e2["item_pct"] == "N/A"
    assert e2["training_sessions"] == 111
    g = one(rq.q17_kpi_grievance(D.months(sources)))
    assert (g["total_received"], g["total_resolved"], g["resolution_rate_text"]) == (280, 277, "98.9%")
    g2 = one(rq.q17_kpi_grievance(D.months(sources).filter("month <> 'Total'")))
    assert (g2["total_received"], g2["total_resolved"]) == (280, 277)


def test_budget_by_section(sources):
    got = {r.section: r for r in rq.q1_budget_by_section(D.items(sources)).collect()}
    assert len(got) == 9
    assert got["Budget Announcements"].allocated == pytest.approx(488.98)
    assert got["Budget Announcements"].utilized == pytest.approx(276.25)
    assert got["Budget Announcements"].utilization_pct == pytest.approx(56.495153, abs=1e-6)
    assert got["Public Grievances"].utilization_pct == pytest.approx(95.714286, abs=1e-6)


def test_completion_status(sources):
    rows = rq.q2_completion_status(D.items(sources)).collect()
    assert [(r.bin, r.n) for r in rows] == [("0-25%", 0), ("26-50%", 6), ("51-75%", 9), ("76-100%", 5)]
    assert sum(r.share_pct for r in rows) == pytest.approx(100.0)


def test_sector_radar(sources):
    as_is = rq.q4_sector_radar(D.sectors(sources), "as_is").orderBy("point").collect()
    assert [r.value for r in as_is[:8]] == [80, 75, 67, 65, 65, 60, 60, 59]
    assert as_is[8].sector == as_is[0].sector and as_is[8].angle == as_is[0].angle
    excl = rq.q4_sector_radar(D.sectors(sources)).orderBy("point").collect()
    assert excl[7].value == 50 and excl[7].sector == "Infrastructure"   # first of the tie in file order


def test_monthly_and_grievance_rates(sources):
    m = {r.month: r for r in rq.q5_monthly_budget_projects(D.months(sources)).collect()}
    assert len(m) == 12
    assert m["Oct-2023"].utilization_pct == pytest.approx(76.687117, abs=1e-6)
    assert [m[k].net_change for k in ("Apr-2023", "May-2023", "Jun-2023")] == [-2, 1, -2]
    assert m["Apr-2023"].show_label and not m["May-2023"].show_label
    g = {r.month: r for r in rq.q11_grievance_resolution(D.months(sources)).collect()}
    assert g["Oct-2023"].resolution_rate == pytest.approx(96.875)
    assert g["Sep-2023"].resolution_rate == pytest.approx(96.428571, abs=1e-6)


@pytest.mark.parametrize("mode,ratio", [("sum", 140.0), ("recompute", 70.0)])
def test_district_heatmap(sources, mode, ratio):
    rows = {r.district: r for r in rq.q6_district_heatmap(D.districts(sources), mode).collect()}
    assert len(rows) == 25
    ldv = rows["Lower Dibang Valley"]
    assert ldv.budget_allocation == pytest.approx(80.75) and ldv.allocation_pct == pytest.approx(100.0)
    assert ldv.utilization_pct == pytest.approx(90.015924, abs=1e-6)
    assert round(ldv.utilization_ratio, 1) == ratio     # FIXTURES lists it at 1 decimal
    assert rows["Papum Pare"].utilization_pct == pytest.approx(100.0)


def test_training_vs_online(sources):
    rows = rq.q7_training_vs_online(D.months(sources), "month").collect()
    assert len(rows) == 12 and all(r.month != "Total" for r in rows)


def test_box_summary(sources):
    rows = rq.q8_box_by_bin(D.districts(sources), "implementation_percentage", "budget_allocation",
                            IMPLEMENTATION_BINS).collect()
    got = {r.bin: r for r in rows}
    low, med, high, vh = (got[b] for b in IMPLEMENTATION_BINS.labels)
    assert (low.n, low.q1, low.median, low.q3, low.whisker_low, low.whisker_high, low.n_outliers) == \
        (9, 22.75, 25.75, 28.75, 18.5, 30.25, 1)
    assert (med.n, med.q1, med.median, med.q3, med.whisker_low, med.whisker_high, med.n_outliers) == \
        (13, 32.5, 38.45, 42.6, 20.4, 52.4, 1)
    assert high.n == 4 and high.q1 == pytest.approx(47.6375) and high.median == pytest.approx(56.775)
    assert vh.n == 0 and vh.median is None


def test_correlation_and_trend(sources):
    rows = {(r.var_x, r.var_y): r.corr for r in rq.q9_district_correlation(D.districts(sources)).collect()}
    assert len(rows) == 15
    assert rows[("budget_utilization", "budget_allocation")] == pytest.approx(0.972293, abs=1e-6)
    assert rows[("grievances_resolved", "population_covered")] == pytest.approx(0.980818, abs=1e-6)
    assert rows[("implementation_percentage", "budget_allocation")] == pytest.approx(0.666592, abs=1e-6)
    pts = rq.q10_implementation_scatter(D.districts(sources)).collect()
    assert len(pts) == 26 and sum(r.labelled for r in pts) == 5
    from budgetlens.operators.stats import linear_fit
    fit = linear_fit(D.districts(sources), "implementation_percentage", "population_covered").collect()[0]
    assert fit.slope == pytest.approx(1211.037394, abs=1e-6)
    assert fit.intercept == pytest.approx(-37758.142340, abs=1e-5)


def test_top_districts(sources):
    rows = rq.q16_top_districts(D.districts(sources)).orderBy("rank").collect()
    assert [r.district for r in rows] == ["Papum Pare", "East Siang", "West Siang", "Namsai", "Changlang"]
    assert rows[0].allocated_text == "Rs. 78.50"


def test_treemap_and_quick_stats(sources):
    t = rq.q12_sector_treemap(D.sectors(sources), "as_is").collect()
    assert t[0].sector in ("Total",) and t[1].sector == "Infrastructure"
    assert t[1].label == "Infrastructure\nRs. 372.18Cr\n(50%)"
    assert sum(r.share_pct for r in t) == pytest.approx(100.0)
    q = rq.q18_quick_stats(D.sectors(sources), "as_is").orderBy("ord").collect()
    assert [r.value for r in q] == ["53.4%", "61.0%", "Public Services"]
    assert q[0].subtext == "Rs. 972.68 Cr / Rs. 1822.86 Cr"
    assert q[2].subtext == "Implementation: 80.0%"


def test_departmental_report(spark):
    import os
    from tests.conftest import REFERENCE_DATA
    if not os.path.isdir(REFERENCE_DATA):
        pytest.skip("departmental sample files not available")
    from budgetlens.plans.departmental import departmental_report
    out = departmental_report(spark, REFERENCE_DATA, include=("budget", "grievance"),
                              period=("2023-04-01", "2023-09-30"))
    sections = {b.section for b in out["blocks"].collect()}
    assert "Budget Performance Analysis" in sections and "Project Status" not in sections
    assert len(out["monthly_budget_projects"].collect()) == 6
    g = out["blocks"].filter("title = 'kpi_grievance'").collect()[0].body
    assert "| 128 | 126 |" in g           # received / resolved of Apr-Sep
    p = out["prompt"].collect()[0].prompt
    assert "JSON data available" not in p and "REQUIRED REPORT SECTIONS:" in p
    assert p.split("JSON Data:")[1].lstrip().startswith("{") and "KeyAchievements" in p
    assert [r.month for r in out["training_vs_online"].collect()][-1] == "Sep-2023"
    assert "Budget Announcements" in p
    s = out["sections"].collect()[0]
    assert len(s.executive_summary) >= 50
    assert len(out) == 18
