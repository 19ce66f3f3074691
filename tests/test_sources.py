import hashlib
import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import d
from tidemark.operators import spatial
from tidemark.sources import parse as P
from tidemark.sources import versions as V
from tidemark.sources.store import Store, read_results, write_results


def frame(spark, bodies):
    return spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")


def both(parsed):
    return P.accepted(parsed), P.rejected(parsed)


def test_nested_series_fill_and_rejects(spark):
    ok = {"header": {"fill_value": -999.0}, "properties": {"parameter": {"T": {"20240101": 1.5, "20240102": -999.0}, "P": {"20240101": 0.0, "20240102": 2.0}}}}
    uneven = {"header": {}, "properties": {"parameter": {"T": {"20240101": 1.0}, "P": {}}}}
    bodies = [json.dumps(ok), '{"detail":[{"msg":"no"}]}', '{"header":"refused","messages":["x"]}', json.dumps(uneven)]
    good, bad = both(P.parse_nested_series(frame(spark, bodies), "body", ["T", "P"]))
    assert sorted((r.d, r["T"], r["P"]) for r in good.collect()) == [(d("2024-01-01"), 1.5, 0.0), (d("2024-01-02"), None, 2.0)]
    assert {r.i: r.problem for r in bad.collect()} == {1: "rejected request", 2: "no series", 3: "series of unequal length"}


def test_records_keep_codes_as_text(spark):
    bodies = ['[{"fips":"05001","t":1}]', '"start after end"', '{"errors":1}', "[]", '[{"fips":"1","t":2}]', '[{"t":1}]']
    good, bad = both(P.parse_records(frame(spark, bodies), "body", "fips:string,t:int", ["fips", "t"], "t", 1))
    assert [r.fips for r in good.collect()] == ["05001"]
    assert {r.i: r.problem for r in bad.collect()} == {1: "error string", 2: "error object", 3: "zero rows", 4: "wrong statistic type", 5: "missing field"}


def test_bars_use_the_exchange_date_and_drop_null_closes(spark):
    body = {"meta": {"dataGranularity": "1d", "gmtoffset": -18000}, "timestamp": [1704085200 + 3600 * 4, 1704171600], "quote": {"close": [1.0, None]}}
    monthly = {**body, "meta": {"dataGranularity": "1mo"}}
    good, bad = both(P.parse_parallel_arrays(frame(spark, [json.dumps(body), json.dumps(monthly)]), "body", "1d", ["close"], "close"))
    assert [(r.d, r.close) for r in good.collect()] == [(d("2024-01-01"), 1.0)]
    assert [r.problem for r in bad.collect()] == ["wrong granularity"]


def test_month_slots_follow_the_calendar(spark):
    slots = ",".join(["1.0"] * 27 + ["-999.99"] + ["5.0"] * 3)
    good, bad = both(P.unpivot_month_slots(frame(spark, [f"cty,00100,N,2023,2,TMAX,{slots}", "cty,1,N,2023,2,TMAX,1"]), "body", -999.99))
    rows = sorted(good.collect(), key=lambda r: r.d)
    assert len(rows) == 28 and rows[-1].d == d("2023-02-28") and rows[-1].value is None and rows[0].area == "00100"
    assert bad.count() == 1


def test_suppressed_is_not_zero(spark):
    body = {"data": [{"state_code": "5", "county_code": "1", "year": "2024", "Value": "1,234,567"}, {"state_code": "05", "county_code": "998", "year": "2024", "Value": " (D) "}]}
    got = [(r.area, r.quantity, r.flag, r.is_area) for r in P.parse_quantities(frame(spark, [json.dumps(body)]), "body").collect()]
    assert got == [("05001", 1234567.0, None, True), ("05998", None, "D", False)]


def test_refused_statistics_are_rejects(spark):
    bodies = ['{"error":["exceeds limit"]}', "not json", '{"data":[]}', '{"data":[{"state_code":"5","county_code":"1","year":"2024","Value":"n/a"}]}']
    got = {r.i: (r.problem, r.quantity) for r in P.parse_quantities(frame(spark, bodies), "body").collect()}
    assert got == {0: ("refused: exceeds limit", None), 1: ("no data", None), 2: ("zero rows", None), 3: ("not a figure", None)}


REPORT = """Crop Progress
Released August 6, 2012, by the service

Corn Dough - Selected States
----
Iowa ...........:      -            (NA)            85           83
18 States ......:      (NA)         72            83           83
Previous week ..:      1            2            3           4
----
Corn Condition - Selected States: Week Ending August 5, 2012
----
Iowa ...........:      2           7          19          57          17
Ohio ..: 1 2
18 States ......:      6          12          28          42          12
Previous week ..:      6          12          28          44          10
----
Soybeans Mature - Selected States
Iowa ...........:      1            2            99           3
"""


def test_report_regions_comparisons_and_flags(spark):
    rows = P.parse_report(frame(spark, [REPORT]), "body", "Corn").collect()
    assert {(r.release_date, r.reference_date) for r in rows} == {(d("2012-08-06"), d("2012-08-05"))}
    assert {r.available_at.hour for r in rows} == {20}
    dough = {(r.region, r.comparison): r.value for r in rows if r.stage == "dough"}
    assert dough[("Iowa", "previous_year")] == 0.0 and dough[("selected_states", "previous_year")] is None and len(dough) == 8
    assert dough[("Iowa", "current")] == 85.0 and 99.0 not in dough.values()
    condition = {(r.region, r.comparison, r.category): (r.value, r.quality_status) for r in rows if r.measure == "condition" and r.problem is None}
    assert condition[("selected_states", "previous_week", "good")] == (44.0, None)
    assert condition[("Iowa", "current", "excellent")] == (17.0, "source_condition_sum_102") and len(condition) == 15
    assert [(r.region, r.problem) for r in rows if r.problem] == [("Ohio", "wrong number of values")]


def test_report_problems_are_named(spark):
    texts = [
        REPORT, "The Crop Progress report will be delayed until Friday.", "no date at all", REPORT.replace("Corn", "Rice"),
        REPORT.replace("28          42          12", "28          42          13"), REPORT.replace("99 ", "9 ").replace("85  ", "850 "),
    ]
    df = frame(spark, texts).withColumn("listed", F.when(F.col("i") == 0, F.lit("2012-08-07")).otherwise(F.lit("2012-08-06")).cast("date"))
    bad = {}
    for r in P.rejected(P.parse_report(df, "body", "Corn", "listed")).collect():
        bad.setdefault(r.i, set()).add(r.problem)
    few = "wrong number of values"
    assert bad == {
        0: {"date is not the listed one"}, 1: {"release notice"}, 2: {"no release date"}, 3: {"no table of the crop"},
        4: {few, "aggregate does not add up to 100"}, 5: {few, "figure outside 0..100"},
    }


def test_version_sidecars_of_both_layouts(spark):
    new = "nClimGrid-Daily v1-0-0 complete for 2026-08-01 through 2026-08-31\nmade by software v2 from GHCN-Daily 3.34-upd-2026090418\ncreated on 2026-09-06 today"
    old = "nClimGrid-Daily v1-0-0 prelim for 2012-07-01 through 2012-07-12\nGHCNd downloaded on Sat Apr 22 05:18:09 2017  \n"
    df = frame(spark, [new, old, "nothing"])
    got = {r.i: r for r in df.select("i", *[c.alias(n) for n, c in P.parse_version_text("body").items()]).collect()}
    assert (got[0].build, got[0].created_on, got[0].software, got[0].downloaded) == ("3.34-upd-2026090418", d("2026-09-06"), "v2", None)
    assert (got[1].build, got[1].created_on, got[1].downloaded, got[1].covers_end) == (None, None, "Sat Apr 22 05:18:09 2017", d("2012-07-12"))
    assert got[0].problem is None and got[2].problem == "no head line"


def test_margin_blocks_and_texts_without_any(spark):
    block = "2024-01-02\nCORN (5,000 BU.)\nCBT+\n1234.5\nC-03\n"
    texts = ["page\n" + block + "x\n" + block.replace("C-03", "CX-03") + block.replace("1234.5", "n/a"), "page"]
    got = [(r.i, r.business_date, r.roll_index, r.rate, r.problem) for r in P.parse_margin_text(frame(spark, texts), "body", "CORN (5,000 BU.)", "CBT+", "C").collect()]
    assert sorted(got) == [(0, d("2024-01-02"), 3, 1234.5, None), (1, None, None, None, "no rate rows")]


def test_message_index_faults(spark):
    line = "{}:{}:d=2024010100:T:2 m:fc:avg"
    ok = "\n".join([line.format(1, 0), line.format(2, 50)])
    bodies = [ok, "", "1:2:3", line.format("x", 0), ok.replace("2:50", "3:50"), ok.replace("2:50", "2:0"), line.format(1, 0) + "\n" + line.format(2, 9).replace("0100", "0106")]
    good, bad = both(P.parse_message_index(frame(spark, bodies), "body"))
    assert [(r.number, r.offset, r.end) for r in good.orderBy("number").collect()] == [(1, 0, 49), (2, 50, None)]
    assert {r.i: r.problem for r in bad.collect()} == {
        1: "empty index", 2: "wrong number of fields", 3: "not a number", 4: "numbers jump", 5: "offsets not increasing", 6: "mixed runs"}


@pytest.mark.parametrize("bucket", [10, 200, 100000])
def test_coalesced_ranges_do_not_depend_on_buckets(spark, bucket):
    rng = random.Random(2)
    at, rows = 0, []
    for _ in range(120):
        at += rng.randrange(1, 40)
        end = at + rng.randrange(0, 30)
        rows.append(("a", at, end))
        at = end
    want = []
    for _, s, e in rows:
        if want and s - want[-1][1] - 1 <= 12:
            want[-1] = (want[-1][0], e, want[-1][2] + 1)
        else:
            want.append((s, e, 1))
    got = P.coalesce_ranges(spark.createDataFrame(rows, "k string, s long, e long"), ["k"], "s", "e", 12, bucket)
    assert sorted((r.start, r.end, r.pieces) for r in got.collect()) == want


def test_links_are_resolved_and_hosts_compared_exactly(spark):
    targets = ["/a.txt", "b.txt", "?page=61", "//CDN.example.com/c", "https://evilexample.com/d.txt", "https://Example.com:443/e", "#top"]
    html = "".join(f'<a href="{h}">Jun 3</a>' for h in targets)
    df = spark.createDataFrame([(1, html, "https://x.example.com/p/list?page=12")], "i int, html string, url string")
    links = P.extract_links(df, "html", "url", '<a href="([^"]+)">([^<]*)</a>', ["example.com", "x.example.com"])
    assert [(r.href, r.host, r.allowed) for r in links.collect()] == [
        ("https://x.example.com/a.txt", "x.example.com", True), ("https://x.example.com/p/b.txt", "x.example.com", True),
        ("https://x.example.com/p/list?page=61", "x.example.com", True), ("https://CDN.example.com/c", "cdn.example.com", False),
        ("https://evilexample.com/d.txt", "evilexample.com", False), ("https://Example.com:443/e", "example.com", True),
        ("https://x.example.com/p/list?page=12#top", "x.example.com", True),
    ]
    assert P.link_conflicts(links, ["i"]).first().conflict is True
    assert P.last_page(links, ["i"]).first().last_page == 61


def test_typed_links_need_a_dated_label_and_the_file_type(spark):
    rows = [
        (1, "/a.TXT?x=1", "Jun 3 2024 - txt", "h", True), (1, "/b.pdf", "Jun 3 2024 - txt", "h", True), (1, "/c.txt", "About", "h", True),
        (1, "/d.txt", "Jun 4 2024 - txt", "evil", False), (1, "/e.txt", "Jun 5 2024 - txt", "h", True), (1, "/f.txt", "Jun 5 2024 - txt", "h", True),
    ]
    links = spark.createDataFrame(rows, "i int, href string, label string, host string, allowed boolean")
    got = P.typed_links(links, ["i"], r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{4})\s+-\s+txt$", "MMM d yyyy", ".txt").collect()
    assert sorted((r.release_date, r.href, r.problem) for r in got) == [
        (d("2024-06-03"), "/a.TXT?x=1", None), (d("2024-06-04"), "/d.txt", "host not allowed"), (d("2024-06-05"), "/e.txt", "more than one target"),
    ]


def test_export_mapping_is_explicit(spark):
    df = spark.createDataFrame([("A", 1.5), ("B", 2.0)], "r string, p double")
    good, bad = both(P.import_export(df, {"root": "r", "open": "p"}, "root", {"A": "ZA"}, ["open"], 100.0))
    assert [(r.root, r.open_cents) for r in good.collect()] == [("ZA", 150.0)] and bad.count() == 1
    with pytest.raises(ValueError):
        P.import_export(df, {"root": "nope"}, "root", {}, [], 1.0)


def test_single_measure_csv(spark, tmp_path):
    (tmp_path / "y.csv").write_text("Entity,Year,Maize yield\nA,2020,1.5\nB,2021,\n")
    got = P.read_single_measure(spark, str(tmp_path / "y.csv"), ["Entity", "Year"])
    assert sorted((r.Entity, r.value, r.measure) for r in got.collect()) == [("A", 1.5, "Maize yield"), ("B", None, "Maize yield")]
    with pytest.raises(ValueError):
        P.single_measure(got, ["Entity"])


def test_store_and_results(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.names() == []
    store.write("t", spark.range(3))
    store.write("t", spark.range(5))
    assert store.names() == ["t"] and store.read("t").count() == 5
    write_results(spark.createDataFrame([(1.23456,)], "v double"), str(tmp_path / "r"), {"v": 2})
    assert read_results(spark, str(tmp_path / "r"), "v double").first().v == 1.23


def test_corrupt_manifest_line_is_fatal(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('{"source":"a","key":"k","sha256":"x"}\n{broken\n')
    with pytest.raises((PySparkException, Py4JJavaError)):
        V.read_manifest(spark, str(path)).collect()


def test_fingerprint_ignores_row_order_and_sees_changes(spark):
    a = spark.createDataFrame([("k", 1, 2.0), ("k", 2, None)], "k string, i int, v double")
    b = spark.createDataFrame([("k", 2, None), ("k", 1, 2.0)], "k string, i int, v double")
    c = spark.createDataFrame([("k", 2, 0.0), ("k", 1, 2.0)], "k string, i int, v double")
    f = [V.rowset_fingerprint(x, ["k"], ["i", "v"]).first().fingerprint for x in (a, b, c)]
    assert f[0] == f[1] != f[2]


def test_fingerprint_keeps_field_borders_and_nulls_apart(spark):
    rows = [[("x|y", "z")], [("x", "y|z")], [("<null>", "z")], [(None, "z")], [("x", "y"), ("x", "y")], [("x", "y")]]
    prints = [V.rowset_fingerprint(spark.createDataFrame([("k", *r) for r in x], "k string, a string, b string"), ["k"], ["a", "b"]).first() for x in rows]
    assert len({p.fingerprint for p in prints}) == 6 and prints[4].rows == 2


def test_file_digests_and_files_too_large(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"abc")
    (tmp_path / "b").write_bytes(b"x" * 50)
    got = {r.file: (r.bytes, r.sha256, r.problem) for r in V.file_digests(spark, str(tmp_path), largest=10).collect()}
    assert got == {"a": (3, hashlib.sha256(b"abc").hexdigest(), None), "b": (50, None, "too large for one value")}


def test_point_in_polygon_holes_ties_and_strongest(spark):
    def ring(x0, y0, x1, y1):
        return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]

    rows = [
        (1, "a", [ring(0.0, 0.0, 10.0, 10.0), ring(4.0, 4.0, 6.0, 6.0)], 40.0, "Above"), (1, "b", [ring(0.0, 0.0, 3.0, 3.0)], 60.0, "Below"),
        (1, "c", [ring(20.0, 20.0, 500.0, 500.0)], 50.0, "Below"), (1, "d", [ring(20.0, 20.0, 30.0, 30.0)], 50.0, "Above"),
    ]
    schema = "issue int, contour string, rings array<array<struct<lon:double,lat:double>>>, probability double, category string"
    pts = spark.createDataFrame(
        [("in", 8.0, 8.5), ("hole", 5.0, 5.2), ("both", 1.0, 1.5), ("far", 990.0, 990.0), ("tie", 22.0, 23.0)], "point string, lon double, lat double"
    )
    asked = pts.selectExpr("1 as issue", "point")
    for order in (rows, rows[::-1]):
        polys = spark.createDataFrame(order, schema)
        for cell in (0.5, 7.0, 1000.0):
            covered = spatial.point_in_polygon(pts, polys, ["issue"], "contour", cell=cell)
            assert {r.point: (r.category, r.probability) for r in covered.collect()} == {"in": ("Above", 40.0), "both": ("Below", 60.0), "tie": ("Below", 50.0)}
            full = {r.point: (r.category, r.covered) for r in spatial.fill_normal(covered, asked, ["issue"]).collect()}
            assert full["hole"] == full["far"] == ("Normal", False) and full["in"] == ("Above", True)
