from datetime import date

import pytest
from pyspark.sql import functions as F

from vigilark.operators import validation as V
from vigilark.operators.detections import new_detections

PEOPLE = [(1.0, "x", True, 2020.0, "USA"), (2.0, None, False, 2021.0, "Canada"), (None, "z", True, 2020.0, "USA"), (4.0, None, True, 2021.0, "Canada"), (5.0, "w", None, 2020.0, "Mexico")]


def test_missing(spark):
    df = spark.createDataFrame(PEOPLE, "a double, b string, c boolean, year double, country string")
    got = {r.column_name: r for r in V.check_missing(df, key_columns=["a", "b"]).collect()}
    assert [got[c].missing_count for c in ("a", "b", "c", "year", "country")] == [1, 2, 1, 0, 0]
    assert [got[c].missing_percent for c in ("a", "b", "c", "year", "country")] == [20, 40, 20, 0, 0]
    assert [got[c].priority for c in ("a", "b", "c")] == ["High", "High", "Standard"]
    assert V.check_missing(df, group_by=["year", "country"]).count() == 9
    full = V.check_missing(df.withColumn("d", F.lit(None).cast("string")))
    assert [r.column_name for r in full.where("completely_null").collect()] == ["d"]
    assert V.check_missing(df.limit(0)).where("missing_count = 0 and missing_percent is null").count() == 5


def test_missing_ids(spark):
    df = spark.createDataFrame([(1, 1.0, "x", True), (2, None, "y", False), (3, 3.0, None, True), (4, None, "w", None), (5, 5.0, "z", True)], "id int, a double, b string, c boolean")
    ids = lambda c: [r.id for r in V.missing_ids(df, "id", c).orderBy("id").collect()]
    assert (ids("a"), ids("b"), ids("c"), ids("id")) == ([2, 4], [3], [4], [])
    with pytest.raises(ValueError):
        V.missing_ids(df, "id", "nothing")


ADMIN = [(1, "A1", "Country1", "B1", "Province1", "C1", "District1"), (2, "A1", "Country1", "B2", "Province2", "C2", "District2"), (3, "A2", "Country2", "B3", "Province3", "C3", "District3"), (4, "A2", "Country2", "B3", "Province3", "C4", "District4"), (5, "A3", "Country3", "B4", "Province4", "C5", "District5")]


def test_mismatches(spark):
    df = spark.createDataFrame(ADMIN, "EPID int, Admin0GUID string, Admin0Name string, Admin1GUID string, Admin1Name string, Admin2GUID string, Admin2Name string")
    dim = spark.createDataFrame([("Country1", "Province1", "District1", "B1", "C1"), ("Country2", "Province3", "District3", "B3", "C3")], "ADM0_NAME string, ADM1_NAME string, ADM2_NAME string, ADM1_GUID string, ADM2_GUID string")
    pairs = {"Admin0Name": "ADM0_NAME", "Admin1Name": "ADM1_NAME", "Admin2Name": "ADM2_NAME", "Admin1GUID": "ADM1_GUID", "Admin2GUID": "ADM2_GUID"}
    summary, detail = V.mismatches(df, dim, "EPID", pairs)
    assert {r.column_name: r.missing for r in summary.collect()} == {"Admin0Name": 1, "Admin1Name": 2, "Admin2Name": 3, "Admin1GUID": 2, "Admin2GUID": 3}
    assert detail.count() == 11
    with pytest.raises(ValueError, match="The number of name columns must match"):
        V.mismatches(df, dim, "EPID", {"Admin0Name": "ADM0_NAME", "Admin1Name": "ADM0_NAME"})


def test_hierarchy(spark):
    df = spark.createDataFrame([("a", "p"), ("b", "p"), ("a", "q"), ("a", "q"), ("a", None)], "x string, y string")
    assert V.admin_hierarchy(df, [("x", "y")]).first().non_unique == 0
    r = V.admin_hierarchy(df, [("x", "y")], true_hierarchy=True).first()
    assert (r.non_unique, r.unique_rows, r.proportion) == (1, 2, 50.0)
    assert V.non_unique_rows(df, ["x", "y"]).count() == 2


def test_check_data(spark):
    rows = [(1, "A", "P", "D", "a", "p", "d", 1.5, 2.5, date(2024, 1, 1), date(2024, 1, 2)), (2, None, "P", "D", "a", "p", "d", None, 2.5, date(2024, 1, 5), date(2024, 1, 2)), (3, "A", "P", "X", "a", "p", "x", 0.0, 0.0, None, date(2030, 1, 2)), (3, "A", "P", "D", "a", "p", "d", 95.0, 2.5, date(2024, 1, 1), date(2024, 1, 2))]
    df = spark.createDataFrame(rows, "ID int, Admin0Name string, Admin1Name string, Admin2Name string, Admin0GUID string, Admin1GUID string, Admin2GUID string, Latitude double, Longitude double, Date1 date, Date2 date")
    dim = spark.createDataFrame([("A", "P", "D", "{A}", "{P}", "{D}", 1.5, 2.5)], "ADM0_NAME string, ADM1_NAME string, ADM2_NAME string, ADM0_GUID string, ADM1_GUID string, ADM2_GUID string, CENTER_LAT double, CENTER_LON double")
    spec = V.preset("AFP", id_col="ID", dates=("Date1", "Date2"), date_pairs=(("Date1", "Date2"),))
    b = V.check_data(df, spec, dim, date(2025, 6, 30))
    got = {(r.header, r.column_name): r["count"] for r in b.summary.collect()}
    want = {
        ("Overall Data Summary", "Total Rows"): 4, ("Overall Data Summary", "Total Duplicate Rows"): 1, ("Geographical Names & ID Missing", "Admin0Name"): 1,
        ("Geographical Mismatches", "Admin2Name not in Shapefile"): 1, ("Geographical Mismatches", "Admin2GUID not in Shapefile"): 1, ("Date Check: Date1", "Date is Missing"): 1,
        ("Date Check: Date2", "Date into the future (beyond 2025)"): 1, ("Date Pair Check: Date1 ~ Date2", "Invalid Date Order (First date is after second date)"): 1,
        ("Coordinate Checks", "Missing Coordinates"): 1, ("Coordinate Checks", "Coordinates Out of Bounds (-90 to 90, -180 to 180)"): 1,
        ("Coordinate Checks", "Null Coordinates (Latitude and Longitude are 0, 0)"): 1,
    }
    for k, v in want.items():
        assert got[k] == v, k
    issues = {(r.id, r.test) for r in b.issues.collect()}
    assert (2, "Date1 ~ Date2 Invalid Date Order (First Date Is After Second Date)") in issues and (2, "Admin0Name Missing Value") in issues
    assert all(x.column_type in ("Geo", "Date", "Coordinate") for x in b.issues.collect())
    _, table = V.validate_data(df.withColumn("year", F.lit("2024")), spec, dim, "year", 2, date(2025, 6, 30))
    assert "2024" in table.columns
    from vigilark.sources.report import scorecard_html

    page = scorecard_html(table, ["2024"], "Cases <b>")
    assert "Cases &lt;b&gt;" in page and "Missing Coordinates" in page
    with pytest.raises(ValueError, match="missing in the data"):
        V.check_data(df.drop("Date1"), spec, dim)
    assert V.check_data(df.limit(0), spec, dim).issues.count() == 0


def test_full_checks_are_registered(spark, tmp_path):
    from vigilark.queries import reference

    days = "CaseDate date, InvestigationDate date, NotificationDate date, Stool1CollectionDate date, Stool2CollectionDate date"
    rows = [(i, "A", "P", "D", "a", "p", "d", la, lo, *[date(2024, 1, 2)] * 5) for i, la, lo in ((1, 40.7128, -74.0061), (2, -74.0061, 40.7128), (3, 40.7, -74.0061))]
    spark.createDataFrame(rows, f"EPID int, Admin0Name string, Admin1Name string, Admin2Name string, Admin0GUID string, Admin1GUID string, Admin2GUID string, Latitude double, Longitude double, {days}").write.parquet(f"{tmp_path}/polis_cases.parquet")
    dim = spark.createDataFrame([("A", "P", "D", "{A}", "{P}", "{D}", 40.7128, -74.0061)], "ADM0_NAME string, ADM1_NAME string, ADM2_NAME string, ADM0_GUID string, ADM1_GUID string, ADM2_GUID string, CENTER_LAT double, CENTER_LON double")
    dim.write.parquet(f"{tmp_path}/shp_global.parquet")
    q, d = reference.queries(), str(tmp_path)
    issues = {(r.id, r.test) for r in q["check_data_issues"](spark, d).collect()}
    assert issues == {(2, V.ISSUE_LABELS["potentially_flipped"]), (3, V.ISSUE_LABELS["low_precision"])}
    names = "Non-unique name Hierarchy (Admin0Name ~ Admin1Name ~ Admin2Name)"
    got = {(r.header, r.column_name): r["count"] for r in q["summary_table"](spark, d).collect()}
    assert got["Geographical Hierarchy", names] == 0 and got["Coordinate Checks", V.LABELS["Low Precision"]] == 1 == got["Coordinate Checks", V.LABELS["Potentially Flipped"]]


def test_detections(spark):
    s = "EPID string, Admin0Name string, VirusTypeName string, VirusDate date, UpdatedDate date, SurveillanceTypeName string, VdpvEmergenceGroupName string"
    old = spark.createDataFrame([("E1", "Country1", "WPV1", date(2023, 1, 1), date(2023, 1, 3), "AFP", None), ("E2", "Country2", "cVDPV2", date(2023, 1, 2), date(2023, 1, 4), "Environmental", "EMG-1")], s)
    new = spark.createDataFrame(
        [("E3", "Country1", "WPV1", date(2023, 2, 1), date(2023, 2, 3), "AFP", None, None, None, None, None, None), ("E4", "Country2", "cVDPV2", date(2023, 2, 2), date(2023, 2, 20), "Environmental", "EMG-2", date(2023, 2, 10), date(2023, 2, 15), "10", "8", "nOPV2")],
        s + ", VdpvClassificationChangeDate date, VdpvReportedToHQDate date, VdpvNtChangesClosestMatch string, VdpvNtChangesFromSabin string, VaccineOrigin string",
    )
    sia = spark.createDataFrame([("Country2", "Done", date(2023, 1, 16), "nOPV2"), ("Country1", "Done", date(2023, 1, 1), "bOPV")], "Admin0Name string, ActivityStatus string, ActivityDateFrom date, ActivityVaccineType string")
    got = new_detections(old, new, sia, date(2025, 6, 30)).collect()
    assert len(got) == 1
    r = got[0].asDict()
    assert (r["Country"], r["New Emergence"], r["Days to Confirm"], r["Days Since SIA"], r["Days Between"], r["Nt Changes"]) == ("Country2", True, 13, 17, "31", "10")
    assert r["New VDPV Class"] and r["2023 Detections"] == 1 and r["Last SIA Date"] == "16th Jan 2023"
    assert new_detections(old, new.limit(0), sia, date(2025, 6, 30)).count() == 0


def test_parts_types_and_order(spark, tmp_path):
    rows = [(i, None if i == 1 else "A", "P", "D", "a", "p", "d", 1.5, 2.5, date(2024 + i % 2, 1, 1)) for i in range(4)]
    cols = "SampleId int, Admin0Name string, Admin1Name string, Admin2Name string, Admin0GUID string, Admin1GUID string, Admin2GUID string, SiteYCoordinate double, SiteXCoordinate double, CollectionDate date"
    df = spark.createDataFrame(rows, cols)
    for c in ("DateShippedToRefLab", "DateReceivedInLab", "DateFinalCultureResult", "DateFinalResultsReported"):
        df = df.withColumn(c, F.lit(None if c.startswith("DateFinal") else "2024-06-01").cast("date"))
    dim = spark.createDataFrame([("A", "P", "D", "{A}", "{P}", "{D}", 1.5, 2.5)], "ADM0_NAME string, ADM1_NAME string, ADM2_NAME string, ADM0_GUID string, ADM1_GUID string, ADM2_GUID string, CENTER_LAT double, CENTER_LON double")
    assert {r.column_name: r.data_type for r in V.check_missing(df, types=True).collect()}["CollectionDate"] == "date"
    headers = lambda parts: {r.header for r in V.check_data(df, V.preset("ES"), dim, date(2025, 6, 30), parts=parts).summary.collect()}
    assert headers(()) == {V.HEADERS[0]} and headers(("hierarchy", "mismatches")) == {V.HEADERS[0], V.HEADERS[4], V.HEADERS[5]}
    with pytest.raises(ValueError, match="unknown parts"):
        headers(("nothing",))
    # the ES preset over weekly snapshots of a year: records of that year and the year before
    from vigilark.sources.snapshots import save_snapshot

    for day, n in ((date(2025, 1, 8), 2), (date(2025, 1, 15), 3), (date(2025, 1, 22), 4), (date(2023, 1, 4), 1)):
        save_snapshot(df.where(F.col("SampleId") < n), str(tmp_path), "env", day)
    bundle, table = V.validate_polis_snapshots(spark, str(tmp_path), "env", "ES", dim, 2025, snapshots=2, as_of=date(2025, 6, 30))
    out = V.in_report_order(table).collect()
    assert [c for c in table.columns if c[0] == "2"] == ["2025 W03", "2025 W04"]
    assert (out[0].column_name, out[0]["2025 W03"], out[0]["2025 W04"]) == ("Total Duplicate Rows", 0, 0) and (out[1]["2025 W03"], out[1]["2025 W04"]) == (3, 4)
    assert [r.header for r in out] == [h for h in dict.fromkeys(r.header for r in out) for r in out if r.header == h]
    assert [r.header_text for r in out if r.header_text] == list(dict.fromkeys(r.header for r in out))
    names = [r.column_name for r in out if r.header == V.HEADERS[3]]
    assert names == sorted(names, key=lambda c: ("Name" not in c, c))
    assert (1, "Admin0Name Missing Value") in {(r.id, r.test) for r in bundle.issues.collect()}
    with pytest.raises(ValueError, match="missing in the data"):
        V.validate_polis(df.drop("SampleId"), "ES", dim, "CollectionDate")
    with pytest.raises(ValueError, match="no snapshot"):
        V.validate_polis_snapshots(spark, str(tmp_path), "env", "ES", dim, 2020)
