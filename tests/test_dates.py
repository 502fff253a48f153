from datetime import date

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigilark.functions.dates import epi_week, format_date_ord, leap_issue
from vigilark.operators import dates as D

AS_OF = date(2025, 6, 30)
ONE = ["2023-06-15", "2024-07-20", None, "1999-12-31", "2025-08-22", "2020/23/10", "2020-02-29", "2019-02-29"]
TWO = ["2023-06-15", "2024-07-20", "2022-05-10", "2024-02-29", "2026-09-23", "2020/23/10", "2020-02-29", "2019-02-29"]


def flags(text):
    return [{"F": False, "T": True, "-": None}[c] for c in text.replace(" ", "")]


def column(df, name):
    return [r[name] for r in df.orderBy("n").collect()]


def frame(spark, values, name="date"):
    return spark.createDataFrame(list(enumerate(values)), f"n int, {name} string")


def test_leap_issue(spark):
    values = ["2020-02-29", "2019-02-29", "2021-03-01", "2020/02/29", "2019/02/29", "2021/03/01", None, "2020-13-29", "2019-02-30", "2020-02-30", "2019-13-29", "2019-02-29T00:00:00", ""]
    df = frame(spark, values).withColumn("x", leap_issue(F.col("date")))
    assert column(df, "x") == flags("FTF FTF F FFFF T F")


def test_validate_date(spark):
    df = D.validate_date(frame(spark, ONE), "date", as_of=AS_OF)
    want = {"missing": "FFTFFFFF", "non_date": "FFFFFFFT", "invalid": "FF-TFFFF", "future": "FF-FFFF-", "leap_issue": "FFFFFFFT", "format_issue": "FFFFFFFF"}
    for k, v in want.items():
        assert column(df, f"date_{k}") == flags(v), k


def test_validate_date_subset_of_tests(spark):
    df = D.validate_date(frame(spark, ["2019-02-29", "x"]), "date", tests=["format"], as_of=AS_OF)
    assert df.columns == ["n", "date", "date_format_issue"]
    assert column(df, "date_format_issue") == [False, True]


def test_validate_dates(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(ONE, TWO))]
    df = D.validate_dates(spark.createDataFrame(rows, "n int, date1 string, date2 string"), "date1", "date2", as_of=AS_OF)
    want = {
        "date1_missing": "FFTFFFFF", "date2_missing": "FFFFFFFF", "date1_non_date": "FFFFFTFT", "date2_non_date": "FFFFFTFT", "date1_invalid": "FF-TF-F-",
        "date2_invalid": "FFFFT-F-", "date1_future": "FF-FF-F-", "date2_future": "FFFFT-F-", "date1_leap_issue": "FFFFFFFT", "date2_leap_issue": "FFFFFFFT",
        "date1_format_issue": "FFFFFTFT", "date2_format_issue": "FFFFFTFT", "date1_invalid_order": "FF-FF-F-",
    }
    for k, v in want.items():
        assert column(df, k) == flags(v), k
    assert column(df, "date1") == ONE


@pytest.mark.parametrize("values, formats, want", [
    (["01-02-2021", "02-03-2021"], None, "%d-%m-%Y"), (["2021/02/01", "2021/03/02"], None, "%Y/%m/%d"), (["01-02-2021", "2021/03/02", "04.05.2021"], None, "%d-%m-%Y"),
    (["99-99-9999", "99/99/9999"], None, None), (["01-02-21", "02-03-21"], ["%d-%m-%y"], "%d-%m-%y"), ([], None, None), ([None], None, None),
])
def test_detect_format(spark, values, formats, want):
    df = frame(spark, values)
    got = (D.detect_date_format(df, "date", formats) if formats else D.detect_date_format(df, "date")).first()
    assert got["format"] == want


def test_autoparse(spark):
    df = spark.createDataFrame(
        [("2023-10-03", "10-03-2023", "03-10-23", "3 October 2023"), ("11.09.2022", "09-11-2022", "11-09-22", "11 Sep 2022"), ("25-12-21 23:59", "12-25-2021", "25-12-21", "25 Dec 21"), ("2020-08-15T00:00:00Z", "08-15-2020", "x", None)],
        "mixed string, mdy string, dmy2 string, named string",
    )
    got = D.autoparse_dates(df, ["mixed", "mdy", "dmy2", "named"]).collect()
    days = [date(2023, 10, 3), date(2022, 9, 11), date(2021, 12, 25), date(2020, 8, 15)]
    assert [r.mixed for r in got] == days and [r.mdy for r in got] == days
    assert [r.dmy2 for r in got] == days[:3] + [None] and [r.named for r in got] == days[:3] + [None]
    iso = spark.createDataFrame([("2021-03-20T00:01:00.513+01:00",)], "t string")
    assert D.autoparse_dates(iso, ["t"]).first().t == date(2021, 3, 19)
    assert D.autoparse_dates(iso, ["t"], local_date=True).first().t == date(2021, 3, 20)


def test_biannual(spark):
    df = spark.createDataFrame([(0, date(2021, 5, 1)), (1, date(2021, 11, 30)), (2, date(2022, 1, 15)), (3, None), (4, date(2005, 7, 1))], "n int, d date")
    assert column(D.categorize_biannual(df, "d"), "custom_biannual") == ["Jan 21 / Jun 21", "Jul 21 / Dec 21", "Jan 22 / Jun 22", "Other", "Jul 5 / Dec 5"]


def test_rounds(spark):
    df = spark.createDataFrame([(i, date(2024, *d)) for i, d in enumerate([(4, 28), (5, 3), (5, 4), (6, 1)])] + [(4, None)], "n int, today date")
    assert column(D.assign_round_number(df), "round") == ["Apr 2024", "Apr 2024", "Apr 2024", "Jun 2024", None]
    one = spark.createDataFrame([(0, date(2024, 1, 1)), (1, date(2024, 1, 1))], "n int, today date")
    assert column(D.assign_round_number(one), "round") == [None, None]
    assert D.assign_round_number(df.limit(0)).count() == 0


def brute_linkage(days, threshold):
    clusters = [[d] for d in days]
    while True:
        best = None
        for i in range(len(clusters) - 1):
            span = clusters[i + 1][-1] - clusters[i][0]
            if span <= threshold and (best is None or span < best[0]):
                best = (span, i)
        if best is None:
            return clusters
        i = best[1]
        clusters[i : i + 2] = [clusters[i] + clusters[i + 1]]


@settings(deadline=None, max_examples=200)
@given(st.sets(st.integers(0, 120), min_size=1, max_size=40), st.integers(0, 20))
def test_complete_linkage(days, threshold):
    days = sorted(days)
    c = D.complete_linkage(np.array(days), threshold)
    got = [[d for d, k in zip(days, c) if k == v] for v in dict.fromkeys(c)]
    assert got == brute_linkage(days, threshold)
    assert all(g[-1] - g[0] <= threshold for g in got)


def test_format_date_ord(spark):
    days = [date(2023, 1, d) for d in (1, 2, 3, 4, 11, 12, 13, 21, 22, 23)] + [None, date(2000, 12, 31)]
    df = spark.createDataFrame(list(enumerate(days)), "n int, d date").withColumn("x", format_date_ord(F.col("d")))
    tails = ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "22nd", "23rd"]
    assert column(df, "x") == [f"{t} Jan 2023" for t in tails] + ["NAth NA NA", "31st Dec 2000"]


def test_epi_week(spark):
    days = [(0, date(2024, 1, 1), 1), (1, date(2023, 12, 31), 1), (2, date(2022, 1, 1), 52), (3, date(2022, 1, 2), 1), (4, date(2020, 12, 31), 53)]
    df = spark.createDataFrame(days, "n int, d date, w int").withColumn("x", epi_week(F.col("d")))
    assert column(df, "x") == [w for _, _, w in days]


def test_iso_prefix_runs_over_all_rows(spark, monkeypatch):
    """A text beginning dd- is read as the prefix has it."""
    from vigilark.queries import reference

    rows = spark.createDataFrame([(1, 1, "12-03-2021"), (2, 1, "2021-03-12T10:00"), (3, 1, None)], "CaseId long, VersionNo int, day string")
    monkeypatch.setattr(reference, "_dirty", lambda spark, d: rows)
    got = {r.CaseId: r.day for r in reference.queries()["iso_prefix"](spark, "").selectExpr("CaseId", "cast(day as string) day").collect()}
    assert got == {1: "0012-03-20", 2: "2021-03-12", 3: None}
