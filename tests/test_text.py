"""Text operators: the section extractor on hand-worked texts and by its
properties, plus the scalar helpers."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from budgetlens.functions import text as X
from budgetlens.sources.files import load_sources
from tests import departmental_files

MISSING = ("This comprehensive report analyzes the performance of the Panchayati Raj Department across key areas "
           "including budget utilization, project status, e-governance initiatives, and district-wise achievements "
           "for the reporting period.")


def spark_sections(spark, texts, mode):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    out = X.add_report_sections(df, "t", mode, "s", "d").orderBy("id").collect()
    return [(r.s, r.d) for r in out]


S60 = "Sixty characters of summary text, give or take a word or so."
S20 = "All 12 roads are open."
D250 = "Detailed findings. " * 13 + "End"
WHOLE = object()

#: (text, summary and detailed text in compat mode, the same in markdown mode), worked out by hand.
TRACES = [
    # A blank line after the heading ends compat's summary at once; the first paragraph is the bare heading.
    (f"## Executive Summary\n\n{S60}\n\n## Next\n{D250}", (MISSING, WHOLE), (S60, f"## Next\n{D250}")),
    (f"## Executive Summary\n{S60}\n\n## Next\n{D250}", (S60, f"## Next\n{D250}"), (S60, f"## Next\n{D250}")),
    # No heading: the first paragraph.
    (f"{S60}\n\n{D250}", (S60, D250), (S60, D250)),
    # Short real texts: replaced in compat, kept in markdown.
    (f"{S20}\n\n{D250}", (MISSING, WHOLE), (S20, D250)),
    (f"## Executive Summary\n{S20}\n\n## Next\n{D250}", (MISSING, WHOLE), (S20, f"## Next\n{D250}")),
    (f"## Executive Summary\n{S60}\n\n## Next\nshort", (S60, WHOLE), (S60, "## Next\nshort")),
    # Bold marks right after the heading stop compat and markdown alike; the paragraph is then the whole text.
    (f"**Executive Summary**\n{S60}", (f"**Executive Summary**\n{S60}", WHOLE),
     (f"**Executive Summary**\n{S60}", WHOLE)),
    # A named section ends the summary.
    (f"EXECUTIVE SUMMARY {S60} Budget Performance {D250}", (S60, f"Budget Performance {D250}"),
     (S60, f"Budget Performance {D250}")),
    # A heading without any end mark does not decide.
    (f"EXECUTIVE SUMMARY {S60}", (f"EXECUTIVE SUMMARY {S60}", WHOLE), (f"EXECUTIVE SUMMARY {S60}", WHOLE)),
    ("", (MISSING, WHOLE), (MISSING, WHOLE)),
    ("      ", (MISSING, WHOLE), (MISSING, WHOLE)),
]


@pytest.mark.parametrize("mode", ["compat", "markdown"])
def test_extractor_traces(spark, mode):
    got = spark_sections(spark, [t[0] for t in TRACES], mode)
    for (text, compat, markdown), g in zip(TRACES, got, strict=True):
        summary, detailed = compat if mode == "compat" else markdown
        assert g == (summary, text if detailed is WHOLE else detailed)


alphabet = st.sampled_from(list("ab #*\n\t.xyzÉ₹") + ["Executive Summary", "## ", "\n\n",
                                                       "EXECUTIVE SUMMARY", "Budget Performance",
                                                       "**", "# Executive Summary", "y" * 60])


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(alphabet, max_size=30).map("".join), min_size=1, max_size=15))
def test_extractor_properties(spark, texts):
    """The summary stands in the text, stripped, or is the placeholder; the
    detailed text is what follows it or the whole text; limits hold by mode."""
    for mode, least, least_rest in (("compat", 50, 200), ("markdown", 1, 1)):
        for text, (summary, detailed) in zip(texts, spark_sections(spark, texts, mode), strict=True):
            assert summary == MISSING or (summary in text and summary == summary.strip() and len(summary) >= least)
            before, found, after = text.partition(summary)
            rest = after.strip()
            assert detailed == (rest if found and len(rest) >= least_rest else text)
            if mode == "markdown" and text.split("\n\n")[0].strip():
                assert summary != MISSING


def test_scalar_helpers(spark):
    t = "  Héllo ₹ wörld　\n"
    row = spark.createDataFrame([(t,)], "t string").select(
        X.py_strip("t").alias("strip"), X.ascii_only("t").alias("ascii"),
        X.latin1_replace("t").alias("latin"), X.locate("o", "t", 6).alias("pos"),
        X.first_positive(X.locate("zz", "t"), X.locate("w", "t"), X.locate("H", "t")).alias("first"),
        X.preview_text("t", 5).alias("prev"), X.money_text_value("t").alias("num"),
    ).collect()[0]
    assert row.strip == t.strip()
    assert row.ascii == "  Hllo  wrld\n"
    assert row.latin == "  Héllo ? wörld?\n"
    assert row.pos == t.find("o", 5) + 1
    assert row.first == t.find("H") + 1
    assert row.prev == t[:5] + "..."
    assert row.num is None


def test_markdown_sections(spark):
    md = "intro\n## A\nbody a\n## B\n\nbody b\n"
    df = spark.createDataFrame([(1, md)], "k int, md string")
    rows = X.split_markdown_sections(df, "md", ["k"]).orderBy("ord").collect()
    assert [(r.ord, r.title, r.body) for r in rows] == [(0, None, "intro"), (1, "A", "body a"),
                                                        (2, "B", "body b")]
    miss = X.missing_sections(X.split_markdown_sections(df, "md", ["k"]), ["A", "C"], ["k"]).collect()
    assert [r.title for r in miss] == ["C"]


def test_json_facts_and_document(spark, tmp_path):
    ev = spark.createDataFrame([(1, '{"k": 5, "j": 1.5, "n": {"a": 1}}'), (2, "not json"), (3, None), (4, "{}")],
                               "id int, p string")
    facts = sorted(((r.id, r.path or "", r.raw, r.value) for r in X.json_facts(ev, "p", ["id"]).collect()))
    assert facts == [(1, "j", "1.5", None), (1, "k", "5", 5), (1, "n", '{"a":1}', None), (2, "", "not json", None)]
    doc = load_sources(spark, departmental_files.write(tmp_path)).json
    got = {r.path: (r.value, r.number)
           for r in X.flatten_document(doc).withColumn("number", X.money_text_value("value")).collect()}
    assert got["Office.Contact.Site"] == ("www.example.org", None)
    assert got["Office.Staff"] == ("12", 12.0)
    assert got["Grants.Roads.Funds"] == ("Rs. 163.98 Cr", 163.98)
    assert got["Grants.Roads.Done"] == ("70%", 70.0)
    assert got["Notes"][0].startswith('["note number 0"')


def test_utf8_ignore_and_dates(spark):
    from pyspark.sql import functions as F
    from budgetlens.functions import fmt
    df = spark.createDataFrame([(bytearray(b"ok\xff\xfeyes"), "2024-03-15 09:30:00")], "b binary, ts string")
    row = df.select(X.utf8_ignore(F.col("b").cast("string")).alias("u"),
                    fmt.report_id(F.to_timestamp("ts")).alias("rid"),
                    fmt.period_text(F.to_date("ts")).alias("period"),
                    fmt.previous_month(F.to_date("ts")).cast("string").alias("prev")).collect()[0]
    assert (row.u, row.rid, row.period, row.prev) == ("okyes", "20240315_093000", "March 2024", "2024-02-01")


def _leaves(v, path="$"):
    """Plain recursion over a parsed document."""
    import re

    if isinstance(v, dict) and v:
        for k, x in v.items():
            plain = re.match("^[A-Za-z_][A-Za-z0-9_]*$", k)
            yield from _leaves(x, path + (f".{k}" if plain else f'."{k}"'))
    elif isinstance(v, list) and v:
        for i, x in enumerate(v):
            yield from _leaves(x, f"{path}[{i}]")
    else:
        yield path, {True: "true", False: "false", None: None}[v] if v is None or isinstance(v, bool) else \
            "{}" if v == {} else "[]" if v == [] else str(v)


def test_json_leaves_equal_recursion(spark):
    import json
    import random

    from budgetlens.operators.documents import json_leaves

    rng = random.Random(3)

    def value(depth):
        kind = rng.random()
        if depth and kind < 0.35:
            return {rng.choice(["a", "b2", "odd key", "é", "x.y", "_c"]): value(depth - 1) for _ in range(rng.randint(0, 3))}
        if depth and kind < 0.6:
            return [value(depth - 1) for _ in range(rng.randint(0, 4))]
        return rng.choice([1, -20, 12345678901, 2.5, "text", "", 'quo"te', "12 of 30", None, True, False])
    docs = [(i, json.dumps(value(6))) for i in range(60)] + [(100, '{"big": ' + json.dumps([{"k": i} for i in range(3000)]) + "}")]
    docs += [(101, "{not json"), (102, None), (103, ""), (103, "[1]"), (104, "7"), (105, "null")]
    df = spark.createDataFrame([(i, t, "clash", "p") for i, t in docs], "id int, doc string, value string, path string")
    got = sorted(((r.id, r.path or "", r.value or "<null>") for r in json_leaves(df, "doc", ["id"]).collect()))
    want = [(i, p, v or ("<null>" if v is None else "<null>")) for i, t in docs if t and t not in ("{not json",)
            for p, v in _leaves(json.loads(t))]
    want += [(101, "", "{not json"), (103, "", "<null>")]
    assert got == sorted(want)
    assert json_leaves(df.limit(0), "doc", ["id"]).collect() == []
    two = json_leaves(df.filter("id = 104"), "doc", ["path", "id"]).collect()
    assert [tuple(r) for r in two] == [("p", 104, "$", "7")] and two[0].__fields__ == ["path", "id", "path", "value"]


def test_amounts_are_whole_texts(spark):
    texts = {"Rs. 163.98 Cr": 163.98, "Rs. 1,234.56 Cr": 1234.56, "1,23,456": 123456.0, "70%": 70.0, "-5": -5.0, "12": 12.0,
             "INR 10 Lakhs": 10.0, " 7.5 ": 7.5, "12 of 30 roads": None, "FY 2023-24": None, "2023-24": None, "1,2": None,
             "Rs.": None, "": None, "about 5": None, "5 km": None, None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.n for r in df.select("t", X.money_text_value("t").alias("n")).collect()} == texts
