"""Catalogue, previews, landing, sinks and streaming on small fixtures."""

import os
import tempfile

import pytest

from budgetlens.plans import report
from budgetlens.sources import catalog, ranges, sinks
from budgetlens.streaming import activity
from tests.conftest import SF_SMALL


def _folder(files: dict[str, str]) -> str:
    d = tempfile.mkdtemp(prefix="budgetlens-test-")
    for name, text in files.items():
        with open(os.path.join(d, name), "w", encoding="utf-8") as f:
            f.write(text)
    return d


def test_catalog_dispatch_and_previews(spark):
    d = _folder({"a.csv": "x,y\n" + "".join(f"{i},{i * 2}\n" for i in range(10)),
                 "b.json": '[{"k": 1}, {"k": 2}, {"k": 3}, {"k": 4}]',
                 "c.json": '{"k": {"j": 1}}', "bad.json": "{nope",
                 "d.txt": "z" * 600, "e.docx": "?"})
    cat = catalog.file_catalog(spark, d)
    rows = {r.name: r for r in cat.collect()}
    assert rows["a.csv"].content_type == "text/csv"
    assert rows["d.txt"].size_text == "0.59 KB"
    ok, rejected = catalog.dispatch(cat)
    assert {r.name for r in rejected.collect()} == {"e.docx"}
    assert {r.name for r in ok.collect()} == {"a.csv", "b.json", "c.json", "bad.json", "d.txt"}
    txt = catalog.preview_text_files(spark, d).collect()[0]
    assert txt.preview == "z" * 500 + "..."
    js = {r.name: r for r in catalog.preview_json_files(spark, d).collect()}
    assert js["b.json"].preview == '[{"k":1},{"k":2},{"k":3}]'
    assert js["c.json"].preview == '{"k":{"j":1}}'
    assert js["bad.json"].error == "invalid JSON"
    csv = catalog.preview_csv_files(spark, d).orderBy("line_no").collect()
    assert [r.line for r in csv] == ["x,y"] + [f"{i},{i * 2}" for i in range(5)]


def test_land_files_replaces_only_its_partition(spark):
    src = _folder({"a.csv": "1", "b.csv": "2"})
    bronze = os.path.join(tempfile.mkdtemp(prefix="budgetlens-bronze-"), "t")
    catalog.land_files(spark, src, bronze)
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write("changed")
    os.remove(os.path.join(src, "b.csv"))
    catalog.land_files(spark, src, bronze)
    got = {r.source_name: bytes(r.content) for r in spark.read.parquet(bronze).collect()}
    assert got == {"a.csv": b"changed", "b.csv": b"2"}


def test_table_text_and_sinks(spark):
    df = spark.createDataFrame([("b", "1.5"), ("a", "22.25")], "k string, v string")
    t = report.table_text(df, ["k", "v"], ["k"]).collect()[0].table_text
    assert t == "k      v\na  22.25\nb    1.5"
    root = tempfile.mkdtemp(prefix="budgetlens-report-")
    blocks = spark.createDataFrame([(1, "S", "title", "S", None), (2, "S", "text", None, "body")],
                                   "ord int, section string, kind string, title string, body string")
    rid = sinks.new_report_id(spark)
    sinks.write_report(blocks, report.render_markdown(blocks), root, rid)
    sinks.write_chart_data({"c": df}, root, rid)
    assert spark.read.json(os.path.join(root, "blocks")).count() == 2
    md = spark.read.text(os.path.join(root, "markdown", f"report_id={rid}")).collect()
    assert md[0].value == "## S"
    assert spark.read.parquet(os.path.join(root, "chart_data", "c", f"report_id={rid}")).count() == 2


def test_streaming_matches_batch(spark):
    if not os.path.isdir(SF_SMALL):
        pytest.skip("test data not available")
    out = activity.activity_windows(spark, SF_SMALL).collect()
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    assert sum(r.n for r in out) == ev.count()
    bronze = activity.events_ingest(spark, SF_SMALL).collect()
    assert sum(r.n for r in bronze) == ev.count()


def test_stream_counts_rows_of_any_age(spark):
    """Many files in many batches, the oldest day in the last file."""
    d = _folder({})
    for k, day in enumerate(["2024-03-09", "2024-03-08", "2024-03-07", "2024-01-01"]):
        spark.sql(f"select {k}L event_id, timestamp_ntz'{day} 10:00:00' ts, 1L user_id, 'view' event_type, "
                  "1.5D value, '' props").coalesce(1).write.mode("append").parquet(d)
    out = activity.activity_windows(spark, d, glob="*.parquet", files_per_batch=1).collect()
    assert sorted(r.window_start[:10] for r in out) == ["2024-01-01", "2024-03-07", "2024-03-08", "2024-03-09"]
    assert all(r.n == 1 and r.value_sum == 1.5 for r in out)


def _event_files(spark, folder, days, start=0):
    """One small file a day: two views and, with no type, one event without value."""
    import pandas as pd

    for k, day in enumerate(days, start):
        ts = pd.Timestamp("2023-01-01") + pd.Timedelta(days=day)
        pd.DataFrame({"event_id": [3 * k, 3 * k + 1, 3 * k + 2],
                      "ts": pd.Series([ts, ts + pd.Timedelta(hours=23), ts + pd.Timedelta(hours=5)]).astype("datetime64[us]"),
                      "user_id": [1, 2, 3], "event_type": ["view", "view", None], "value": [1.25, 2.5, None],
                      "props": ["", "", ""]}).to_parquet(os.path.join(folder, f"f{k:05d}.parquet"), index=False)


def test_stream_holds_no_state_and_loses_no_row(spark):
    """Sixty days in files of any order, in many batches: all rows count, no state
    is held, a second run reads new files only."""
    import random

    d, days = _folder({}), list(range(60))
    random.Random(4).shuffle(days)
    table = os.path.join(_folder({}), "windows")
    _event_files(spark, d, days)
    first = activity.run_windows(spark, d, table, glob="*.parquet", files_per_batch=10)
    assert len(first) >= 6 and {p["state_rows"] for p in first} == {0}
    got = activity.read_windows(spark, table).collect()
    assert len(got) == 120 and {r.window_start[:10] for r in got if not r.closed} == {"2023-02-28", "2023-03-01"}
    assert {(r.event_type, r.n, r.value_sum) for r in got} == {("view", 2, 3.75), (None, 1, None)}
    _event_files(spark, d, [5, 59, 61], start=60)
    second = activity.run_windows(spark, d, table, glob="*.parquet", files_per_batch=10)
    assert sum(p["input_rows"] for p in second) == 9
    again = {(r.window_start[:10], r.event_type): (r.n, r.value_sum) for r in activity.read_windows(spark, table).collect()}
    assert len(again) == 122 and again["2023-01-06", "view"] == (4, 7.5) and again["2023-01-06", None] == (2, None)
    assert again["2023-03-01", "view"] == (4, 7.5) and again["2023-01-07", "view"] == (2, 3.75)


def test_ingest_adds_to_its_table(spark):
    from pyspark.sql import types as T
    d = _folder({"f1.csv": "a\n1\n2\n"})
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    bronze, _ = activity.ingest_files(spark, d, schema, options={"header": "true"})
    with open(os.path.join(d, "f2.csv"), "w") as f:
        f.write("a\n7\n")
    activity.ingest_files(spark, d, schema, bronze=bronze, options={"header": "true"})
    assert sorted(r.a for r in spark.read.parquet(bronze).collect()) == [1, 2, 7]


def test_ingest_quarantine(spark):
    from pyspark.sql import types as T
    d = _folder({"ok.csv": "a,b\n1,2\n3,x\n"})
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
    bronze, quarantine = activity.ingest_files(spark, d, schema, options={"header": "true"})
    assert [(r.a, r.b) for r in spark.read.parquet(bronze).collect()] == [(1, 2)]
    assert spark.read.parquet(quarantine).count() == 1


def test_stream_windows_independent_of_session_time_zone(spark):
    if not os.path.isdir(SF_SMALL):
        pytest.skip("test data not available")
    key = "spark.sql.session.timeZone"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "UTC")
        utc = sorted(tuple(r) for r in activity.activity_windows(spark, SF_SMALL).collect())
        spark.conf.set(key, "America/Los_Angeles")
        la = sorted(tuple(r) for r in activity.activity_windows(spark, SF_SMALL).collect())
    finally:
        spark.conf.set(key, old)
    assert utc == la and utc[0][0].endswith("00:00:00")


def test_one_damaged_file_does_not_stop_the_others(spark):
    import gzip

    import pandas as pd

    from budgetlens.sources.isolate import read_isolated

    d = _folder({})
    paths = [os.path.join(d, f"f{i}.parquet") for i in range(10)]
    for i, p in enumerate(paths):
        pd.DataFrame({"a": range(100 * i, 100 * i + 100)}).to_parquet(p)
    whole = open(paths[4], "rb").read()
    with open(paths[4], "wb") as f:
        f.write(whole[:len(whole) // 2])
    rows, rejected = read_isolated(spark, paths, lambda p: spark.read.schema("a long").parquet(*p))
    assert sorted(r.a for r in rows.collect()) == [k for k in range(1000) if k // 100 != 4]
    (bad,) = rejected.collect()
    assert bad.path == paths[4] and "FAILED_READ_FILE" in bad.reason

    packed = [os.path.join(d, f"g{i}.csv.gz") for i in range(3)]
    for i, p in enumerate(packed):
        with gzip.open(p, "wt") as f:
            f.write("".join(f"{i},{k}\n" for k in range(100_000)))
    whole = open(packed[1], "rb").read()
    with open(packed[1], "wb") as f:
        f.write(whole[:len(whole) * 3 // 4])  # its first part could be read, but is not kept
    rows, rejected = read_isolated(spark, packed, lambda p: spark.read.schema("i int, k int").csv(p))
    assert {r.i: r["count"] for r in rows.groupBy("i").count().collect()} == {0: 100_000, 2: 100_000}
    assert [r.path for r in rejected.collect()] == [packed[1]]
    none, rejected = read_isolated(spark, [paths[4]], lambda p: spark.read.schema("a long").parquet(*p))
    assert none is None and rejected.count() == 1
    import pytest

    with pytest.raises(Exception):  # no error of a file
        read_isolated(spark, paths[:1], lambda p: spark.read.schema("a long").parquet(*p).selectExpr("raise_error('x') a"))


def test_previews_read_heads_only(spark, monkeypatch):
    long = "é" * 3000
    d = _folder({"a.csv": "x,y\r\n" + "".join(f"{i},{i * 2}\n" for i in range(90_000)), "b.csv": "h\n1", "c.csv": "",
                 "long.csv": "x," + "y" * 200_000 + "\n1,2\n", "a.txt": "z" * 500, "b.txt": long, "c.txt": ""})
    got = {}
    for r in ranges.preview_csv_heads(spark, d).orderBy("line_no").collect():
        got.setdefault(r.name, []).append((r.line, r.cut))
    assert got["a.csv"] == [("x,y", False)] + [(f"{i},{i * 2}", False) for i in range(5)]
    assert got["b.csv"] == [("h", False), ("1", False)] and "c.csv" not in got
    assert [(len(line), cut) for line, cut in got["long.csv"]] == [(64 << 10, True)]
    text = {r.name: r.preview for r in ranges.preview_text_heads(spark, d).collect()}
    assert text == {"a.txt": "z" * 500, "b.txt": "é" * 500 + "..."}
    sizes = ranges.file_heads(spark, d, "*.csv", 1000).selectExpr("name", "length(content) n", "whole").collect()
    assert {(r.name, r.n, r.whole) for r in sizes} == {
        ("a.csv", 1000, False), ("b.csv", 3, True), ("long.csv", 1000, False)}


def test_landed_chunks_come_back_byte_for_byte(spark):
    import hashlib
    import random

    rng = random.Random(5)
    files = {"big.bin": rng.randbytes(5_000_001), "even.bin": rng.randbytes(200_000), "a b.csv": b"x,y\r\n"}
    d, bronze = _folder({}), os.path.join(_folder({}), "bronze")

    def put(name, data):
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)

    for name, data in files.items():
        put(name, data)
    ranges.land_chunks(spark, d, bronze, chunk=100_000)
    rows = ranges.landed(spark, bronze)
    assert rows.agg({"n": "max"}).first()[0] == 100_000 and rows.count() == 51 + 2 + 1
    # Uploaded again, changed; then an upload that broke off.
    files["even.bin"] = rng.randbytes(150_000)
    put("even.bin", files["even.bin"])
    ranges.land_chunks(spark, d, bronze, "even.bin", chunk=100_000)
    put("even.bin", b"broken" * 30_000)
    broken = os.path.join(_folder({}), "bronze")
    ranges.land_chunks(spark, d, broken, "even.bin", chunk=100_000)
    spark.read.parquet(broken).filter("start = 0").write.mode("append").parquet(bronze)
    out = _folder({})
    told = {r.source_name: (r["bytes"], r.sha256) for r in ranges.restore(spark, bronze, out).collect()}
    assert told == {n: (len(v), hashlib.sha256(v).hexdigest()) for n, v in files.items()}
    for name, data in files.items():
        with open(os.path.join(out, name), "rb") as f:
            assert f.read() == data
