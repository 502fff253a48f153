"""The operators of the general problems against brute force, and their defined results for nulls, ties, repeats and empty tables."""

import random
import re
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from vigilark.operators import column_profile as P
from vigilark.operators import instants as I
from vigilark.operators import work_ledger as W
from vigilark.operators.snapshot_diff import latest_state, snapshot_diff
from vigilark.plans import joins
from vigilark.plans.joins import hot_keys, join_dimension, latest_before, range_join
from vigilark.plans.ranks import ranked_in_groups
from vigilark.plans.rows import canonical_text
from vigilark.session import materialise

# ------------------------------------------------------------------ snapshots


def test_snapshot_diff(spark):
    rnd = random.Random(3)
    rows = []
    for w in ("2024_51", "2024_52", "2025_02"):
        for i in range(40):
            if rnd.random() < 0.8:
                for _ in range(rnd.choice([1, 1, 2])):
                    rows.append((w, i, rnd.choice([None, "a", ""]), rnd.choice(["x", "y"]), rnd.choice([None, datetime(2024, 1, rnd.randint(1, 3))])))
    rows += [(None, 1, "a", "x", None), ("2024_52", None, "a", "x", None)]
    df = spark.createDataFrame(rows, "week string, id long, v string, t string, u timestamp_ntz").withColumn("to_delivery_", F.lit(1))

    def state(w):
        best = {}
        for x, i, v, t, u in rows:
            if x == w and i is not None:
                best.setdefault(i, []).append((u is not None, u or datetime.min, (v, t)))
        return {i: {r[2] for r in rs if r[:2] == max(r[:2] for r in rs)} for i, rs in best.items()}

    got = {(r.id, r.from_delivery, r.to_delivery): r.change_kind for r in snapshot_diff(df, "week", ["id"], "u").collect()}
    for a, b in (("2024_51", "2024_52"), ("2024_52", "2025_02")):
        old, new = state(a), state(b)
        for i in range(40):
            k = got.get((i, a, b))
            if i in new and i not in old:
                assert k == "added"
            elif i in old and i not in new:
                assert k == "removed"
            elif i in old and len(old[i]) == len(new[i]) == 1:
                assert k == (None if old[i] == new[i] else "changed")
    assert not {k for k in got if k[0] is None}
    assert snapshot_diff(df.limit(0), "week", ["id"], "u").count() == 0
    assert snapshot_diff(df.where("week = '2024_51'"), "week", ["id"], "u").count() == 0
    assert latest_state(df, "week", ["id"], "u").groupBy("week", "id").count().where("count > 1").count() == 0


def test_canonical_text_is_unambiguous(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("", "a"), ("a", ""), ("1:a", ""), ("", "1:a"), ("~", None), (None, "~")], "x string, y string")
    assert df.select(canonical_text(["x", "y"]).alias("t")).distinct().count() == 8


# ------------------------------------------------------------------ ledger


def test_item_states(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    claims = [
        ("done", 1, "lease", t(1), t(3)), ("done", 1, "done", t(2), None), ("done", 1, "done", t(2), None),
        ("stale", 1, "lease", t(1), t(2)), ("stale", 2, "lease", t(3), t(4)), ("stale", 1, "done", t(5), None),
        ("late", 1, "lease", t(1), t(2)), ("late", 1, "done", t(5), None),
        ("open", 1, "lease", t(9), t(12)), ("failed", 1, "lease", t(9), t(12)), ("failed", 1, "failed", t(10), None),
        ("expired", 1, "lease", t(1), t(2)), ("forged", 7, "done", t(2), None), (None, 1, "done", t(2), None), ("open", None, "done", t(2), None),
    ]
    items = spark.createDataFrame([(x, 1) for x in ("done", "stale", "late", "open", "failed", "expired", "forged", "new")], "item string, x int")
    got = {r.item: r.state for r in W.item_states(items, spark.createDataFrame(claims, W.CLAIMS), F.lit(t(10)).cast("timestamp_ntz")).collect()}
    assert got == {"done": "done", "stale": "pending", "late": "pending", "open": "leased", "failed": "pending", "expired": "pending", "forged": "pending", "new": "pending"}


def hour(h):
    return datetime(2024, 1, 1) + timedelta(hours=h)


def test_ledger_survives_failures(spark, tmp_path):
    clock = [0]
    ledger = W.WorkLedger(spark, str(tmp_path / "ledger"), lambda: hour(clock[0]))
    items = spark.createDataFrame([(str(i), i, "x") for i in range(5)], "item string, n int, token string")
    work = lambda df: df.select("item", (F.col("n") * 10).alias("v"))

    def broken(df):
        raise RuntimeError("lost")

    clock[0] = 1.5
    with pytest.raises(RuntimeError, match="lost"):
        ledger.process(items, broken, hour(1), hour(2))
    clock[0] = 3.5
    ledger.process(items.where("n < 3"), work, hour(3), hour(4))
    more = items.union(spark.createDataFrame([("9", 9, None), (None, 7, None)], items.schema))
    # a run that never comes back: its items are pending again after the lease
    dead, taken = ledger.lease(more.where("n >= 3"), hour(5), hour(6))
    assert taken.count() == 3
    assert ledger.lease(more, hour(5), hour(6))[1].count() == 0
    clock[0] = 7.5
    ledger.process(more, work, hour(7), hour(8))
    # the dead run wakes up and writes: its commit is refused, its rows are not read
    taken.select("item", F.lit(-1).alias("v")).write.mode("overwrite").parquet(ledger.output_path(dead))
    with pytest.raises(W.StaleLease):
        ledger.end(dead, "done", hour(9))
    with pytest.raises(W.StaleLease):  # neither does a wrong clock help it
        ledger.end(dead, "done", hour(5.5))
    out = ledger.results(spark.createDataFrame([], "item string, v int").schema)
    assert sorted((r.item, r.v) for r in out.collect()) == [("0", 0), ("1", 10), ("2", 20), ("3", 30), ("4", 40), ("9", 90)]
    assert W.WorkLedger(spark, str(tmp_path / "none")).results(out.schema).count() == 0


def test_overrun_writer_is_refused(spark, tmp_path):
    """A leases from 1 to 2 o'clock and writes at 5; B leases at 4 and commits. What B wrote holds, and goes on to hold."""
    path, schema = str(tmp_path / "ledger"), spark.createDataFrame([], "item string, v int").schema
    items = spark.createDataFrame([("x",)], "item string")
    times = iter([hour(5)])
    a, b = W.WorkLedger(spark, path, lambda: next(times)), W.WorkLedger(spark, path, lambda: hour(4.5))

    def slow(df):
        b.process(items, lambda d: d.withColumn("v", F.lit(222)), hour(4), hour(6))
        assert [r.v for r in b.results(schema).collect()] == [222]
        return df.withColumn("v", F.lit(111))

    with pytest.raises(W.StaleLease):
        a.process(items, slow, hour(1), hour(2))
    assert [r.v for r in a.results(schema).collect()] == [222]
    b.end(2, "done", hour(7))  # a repeated end changes nothing
    assert [r.v for r in a.results(schema).collect()] == [222] and b.lease(items, hour(9), hour(10))[1].count() == 0


def test_concurrent_leases_share_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    items = spark.createDataFrame([(str(i),) for i in range(20)], "item string")

    def take(_):
        token, mine = W.WorkLedger(spark, str(tmp_path / "ledger")).lease(items, hour(1), hour(2))
        return token, [r.item for r in mine.collect()]

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(take, range(4)))
    assert sorted(t for t, _ in got) == [1, 2, 3, 4]
    assert sorted(i for _, mine in got for i in mine) == sorted(str(i) for i in range(20))


def test_outstanding_versions(spark):
    rnd = random.Random(4)
    day = lambda: date(2024, 1, 1) + timedelta(days=rnd.randint(0, 20))
    cases, log = [], []
    for i in range(80):
        for v in range(1, rnd.randint(2, 4)):
            u = rnd.choice([None, *[datetime(2024, 1, rnd.randint(1, 20), 5)] * 6])
            for _ in range(rnd.choice([1, 1, 2])):
                cases.append((i, v, ["A", "B"][i % 2] + " " * (i % 3 == 0), u, datetime(2024, 1, rnd.randint(1, 25), 3)))
    for k in range(25):
        a = day()
        b = a + timedelta(days=rnd.randint(0, 6))
        log.append((rnd.choice(["a", "B ", "Global", None]), a, b, rnd.choice([b, None, a]), rnd.choice(["Case", "Case", "Virus"]), rnd.choice(["success", "success", "failed", None]), datetime(2024, 1, rnd.randint(1, 28), 4)))
    c = spark.createDataFrame(cases + [(None, 1, "A", None, None), (1, None, "A", None, None)], "CaseId long, VersionNo int, WHORegion string, LastUpdateDate timestamp_ntz, ReceivedAt timestamp_ntz")
    g = spark.createDataFrame(log + log[:3], "Region string, QueryStartDate date, QueryEndDate date, DataEndDate date, PolisDataType string, RunStatus string, RunStartedAt timestamp_ntz")

    def covered(i, v):
        mine = [r for r in cases if r[:2] == (i, v)]
        u, first = mine[0][3], min(r[4] for r in mine)
        return any(
            s == "success" and t == "Case" and r and r.strip().lower() in (mine[0][2].strip().lower(), "global") and e and u and a <= u.date() <= min(b, e) and first <= at
            for r, a, b, e, t, s, at in log
        )

    # all deliveries of a version share its update date, as in the data
    dates = {}
    cases = [(i, v, w, dates.setdefault((i, v), u), at) for i, v, w, u, at in cases]
    c = spark.createDataFrame(cases + [(None, 1, "A", None, None), (1, None, "A", None, None)], c.schema)
    top = {i: max(v for j, v, *_ in cases if j == i) for i in {r[0] for r in cases}}
    want = {(i, v) for i, v in top.items() if not covered(i, v)}
    got = W.outstanding_versions(c, g)
    assert {(r.case_id, r.version_no) for r in got.where("state <> 'done'").collect()} == want and 0 < len(want) < len(top)
    assert W.outstanding_versions(c.limit(0), g).count() == 0
    assert W.outstanding_versions(c, g.limit(0)).where("state = 'pending'").count() == len(top)
    leased = W.outstanding_versions(c, g, now=datetime(2024, 1, 20), lease_hours=240)
    assert leased.where("state = 'leased'").count() > 0


def test_line_without_start_covers_nothing(spark):
    t = datetime(2024, 1, 5)
    cases = spark.createDataFrame([(1, 1, "NORO", t, t)], "CaseId long, VersionNo int, WHORegion string, LastUpdateDate timestamp_ntz, ReceivedAt timestamp_ntz")
    log = spark.createDataFrame([("NORO", None, date(2024, 2, 1), date(2024, 2, 1), "Case", "success", datetime(2024, 2, 2))],
                                "Region string, QueryStartDate date, QueryEndDate date, DataEndDate date, PolisDataType string, RunStatus string, RunStartedAt timestamp_ntz")
    assert [r.state for r in W.outstanding_versions(cases, log).collect()] == ["pending"]


# ------------------------------------------------------------------ profile


def test_profile_and_findings(spark):
    rows = [(1, "ab", 5)] * 6 + [(1, None, 5), (1, "  ", 500), (2, "ab", 5), (2, "9", 5), (2, "cd", 5), (2, None, None), (4, None, None), (None, "zz", 1)]
    df = spark.createDataFrame(rows, "load int, c string, n int")
    rules = spark.createDataFrame([("c", True, "^[a-z]+$", None, None, 0.2, 0.1, 0.25, 1.6), ("n", False, None, 1.0, 100.0, None, None, None, None), ("other", True, ".", None, None, 0.0, 0.0, 0.0, 0.0)],
                                  "column_name string, categorical boolean, pattern string, min_value double, max_value double, max_bad_share double, max_null_step double, max_distance double, max_distinct_ratio double")
    counts = P.value_counts(df, "load", ["c", "n"])
    profile = P.column_profile(counts, rules)
    got = {(r.load, r.column_name): r for r in profile.collect()}
    assert (got[1, "c"].n_rows, got[1, "c"].n_null, got[1, "c"].n_distinct) == (8, 2, 1)
    assert got[2, "c"].distance == pytest.approx(2 / 3) and got[4, "c"].distance is None and got[1, "c"].distance is None
    found = {(r.load, r.column_name, r.finding) for r in P.profile_findings(profile, rules).collect()}
    assert found == {(2, "c", "pattern"), (2, "c", "distance"), (2, "c", "distinct"), (1, "n", "range")}
    assert P.profile_findings(P.column_profile(P.value_counts(df.limit(0), "load", ["c"]), rules), rules).count() == 0
    assert P.column_profile(counts).count() == 6


def induced(spark, rows):
    """{(column, value): expression or None if the value does not conform} by matched_values."""
    df = spark.createDataFrame(rows, "column_name string, value string, n long").groupBy("column_name", "value").agg(F.sum("n").alias("n"))
    got = P.matched_values(P.kinds_of_values(df.select(F.lit(1).alias("load"), "column_name", "value", "n"))).collect()
    return {(r.column_name, r.value): r.expression if r.conforming else None for r in got}


def test_induced_expressions(spark):
    values = [f"AB-{i:03d}" for i in range(1000)] + [f"{i:06d}:{'x' if i % 2 else 'y'}" for i in range(900)] + [f"{i:06d}" for i in range(500)] + ["?!x 9Z~~a1B2"]
    got = induced(spark, [("c", v, 1) for v in values])
    assert got["c", "AB-007"] == r"^AB\-\p{N}{3}$"
    assert got["c", "000007:x"] == got["c", "000008"] == r"^\p{N}{6}(?::(?:x|y))?$"  # alternatives in an optional tail
    assert got["c", "?!x 9Z~~a1B2"] is None
    codes = induced(spark, [("c", v, n) for v, n in (("Done", 900), ("Planned", 800), ("Cancelled", 700), ("Dnoe", 1), ("A+B (x)", 500))])
    assert codes["c", "Done"] == codes["c", "Planned"] == "^(?:Cancelled|Done|Planned)$" and codes["c", "Dnoe"] is None and codes["c", "A+B (x)"]
    assert P.induce_expressions(spark.createDataFrame([], "column_name string, value string, n long")).count() == 0


def test_expressions_match_what_conforms(spark):
    """In every script, with marks, private-use, control and supplementary characters: what conforms is matched, by Java's rules and by regex's."""
    import regex

    rnd = random.Random(11)
    words = ["東京", "大阪", "京都", "Москва", "Αθήνα", "서울", "القاهرة", "दिल्ली", "กรุงเทพ", "ÅNGSTRÖM", "e\u0301te\u0301", "a\ue001b", "\ue003", "x\u0001y", "😀😀", "１２３", "٣٤", "𝔸b", "ǅ", "[a]", "a{2}", "^$", "\\Q", "&&", "a-z", "\u200b", "₤5", "\n z"]
    rows = [("w", w * rnd.randint(1, 3), rnd.choice([1, 5, 400])) for w in words for _ in range(8)]
    rows += [("p", f"{rnd.choice(words)}{rnd.choice('-/ .')}{rnd.randint(0, 9999)}", 3) for _ in range(600)] + [("k", w, 50) for w in ("東京", "大阪", "京都")]
    got = induced(spark, rows)
    assert got["k", "東京"] and got["k", "東京"] == got["k", "京都"]
    for (c, v), e in got.items():
        if e:
            e = e.replace(r"[\p{L}\p{M}&&[^\p{Lu}]]", r"[[\p{L}\p{M}]--[\p{Lu}]]")
            assert regex.search("(?V1)" + e[:-1] + r"\Z", v), (c, v, e)
    assert sum(e is not None for e in got.values()) > len(got) / 2
    # by signature alone: what the groups' expressions say holds before anything is matched
    df = spark.createDataFrame(rows, "column_name string, value string, n long").groupBy("column_name", "value").agg(F.sum("n").alias("n")).withColumn("sig", P.signature(F.col("value")))
    j = df.join(P.induce_expressions(df), ["column_name", "sig"]).where("conforming and expression not like '%(?:%'")
    assert j.where(~F.expr("value rlike expression")).count() == 0 and j.count() > 0


def test_rare_odd_values_are_nonconforming(spark):
    """Letters, digits and punctuation too: an odd value among thousands of regular ones is no expression of its own."""
    rows = [("c", f"{chr(65 + i % 26)}{chr(65 + i % 7)}-{i:05d}", 1) for i in range(5000)] + [("c", v, n) for v, n in (("#REF!", 1), ("99", 1), ("xxx", 1), ("n/a", 1))] + [("c", "AB-00000", 2000)]
    rows += [("w", "".join(chr(97 + (i * k) % 26) for k in range(1, 4 + i % 9)), 2) for i in range(1, 2000)] + [("w", "?!x 9Z~~a1B2", 1)]
    got = induced(spark, rows)
    assert {v for (c, v), e in got.items() if e is None} == {"#REF!", "99", "xxx", "n/a", "?!x 9Z~~a1B2"}
    loads = spark.createDataFrame([(1, v) for _, v, n in rows[:5005] for _ in range(n)], "load int, c string")
    assert P.column_profile(P.value_counts(loads, "load", ["c"])).first().n_nonconforming == 4


def test_findings_without_rules(spark):
    """A column without a pattern is held to its own expressions, and a load that is spread differently over them is found."""
    rows = [(1, f"K{i:04d}") for i in range(3000)] + [(2, f"K{i:04d}") for i in range(2000)] + [(2, f"{i:03d}/B") for i in range(1000)]
    rows += [(3, f"K{i:04d}") for i in range(400)] + [(3, "".join(rnd)) for rnd in (random.Random(k).sample("aB9?! -_/xZ", 8) for k in range(60))]
    rules = spark.createDataFrame([], "column_name string, categorical boolean, pattern string, min_value double, max_value double, max_bad_share double, max_null_step double, max_distance double, max_distinct_ratio double")
    p = P.column_profile(P.value_counts(spark.createDataFrame(rows, "load int, c string"), "load", ["c"]), rules)
    found = {(r.load, r.finding) for r in P.profile_findings(p, rules, 0.1, 0.25).collect()}
    assert found == {(2, "coverage"), (3, "pattern"), (3, "coverage")} and P.profile_findings(p, rules).count() == 0


def test_columns_without_rules_are_profiled(spark, tmp_path):
    from vigilark.queries import problems

    sia = spark.createDataFrame([(1, 1, "OFF01", 5), (2, 1, None, 7), (3, 2, "OFF02", None)], "ActivityId long, LoadNo int, office_code string, TargetPopulation long")
    sia.write.parquet(f"{tmp_path}/polis_sia.parquet")
    rules = spark.createDataFrame([("TargetPopulation", False, None, 0.0, 6.0, None, None, None, None)], "column_name string, categorical boolean, pattern string, min_value double, max_value double, max_bad_share double, max_null_step double, max_distance double, max_distinct_ratio double")
    rules.write.parquet(f"{tmp_path}/column_rules.parquet")
    got = {(r.load_no, r.column_name): (r.n_rows, r.n_null, r.n_distinct) for r in problems.p6_profile(spark, str(tmp_path)).collect()}
    assert {c for _, c in got} == {"ActivityId", "office_code", "TargetPopulation"} and got[1, "office_code"] == (2, 1, 1) and got[2, "ActivityId"] == (1, 0, 1)
    assert {(r.load_no, r.column_name, r.n_rows) for r in problems.p6_coverage(spark, str(tmp_path)).collect()} == {(n, c, 3 - n) for n in (1, 2) for c in sia.columns if c != "LoadNo"}
    assert {r.column_name for r in problems.p6_expressions(spark, str(tmp_path)).collect()} == {"ActivityId", "office_code", "TargetPopulation"}
    assert {tuple(r) for r in problems.p6_found(spark, str(tmp_path)).collect()} == {(1, "TargetPopulation", "range")}


# ------------------------------------------------------------------ instants

PARIS, KATHMANDU, NEW_YORK = "Europe/Paris", "Asia/Kathmandu", "America/New_York"


def us(y, m, d, h=0, mi=0, s=0, micro=0, zone="UTC", fold=0):
    t = datetime(y, m, d, h, mi, s, micro, tzinfo=ZoneInfo(zone), fold=fold)
    return round((t - datetime(1970, 1, 1, tzinfo=ZoneInfo("UTC"))) / timedelta(microseconds=1))


CASES = [
    ("2024-03-01T10:00:00Z", PARIS, "DMY", us(2024, 3, 1, 10)), ("2024-03-01 10:00", PARIS, "DMY", us(2024, 3, 1, 9)), ("03/04/2024", NEW_YORK, "MDY", us(2024, 3, 4, zone=NEW_YORK)),
    ("03/04/2024", PARIS, "DMY", us(2024, 4, 3, zone=PARIS)), ("2024/03/04", NEW_YORK, "MDY", us(2024, 3, 4, zone=NEW_YORK)), ("05-01-18 12:52", PARIS, "DMY", us(2018, 1, 5, 12, 52, zone=PARIS)),
    ("2024-03-31 02:30", PARIS, "DMY", us(2024, 3, 31, 1, 30)), ("2024-10-27 02:30", PARIS, "DMY", us(2024, 10, 27, 0, 30)), ("2024-10-27 02:30 CET", PARIS, "DMY", us(2024, 10, 27, 1, 30)),
    ("2024-01-01T00:00:00+05:45", PARIS, "DMY", us(2023, 12, 31, 18, 15)), ("20240101T000000Z", PARIS, "DMY", us(2024, 1, 1)), ("Tue, 20 Mar 2018 10:21:08 +1100", PARIS, "DMY", us(2018, 3, 19, 23, 21, 8)),
    ("1529936916", PARIS, "DMY", 1529936916 * 10**6), ("1529936916123", PARIS, "DMY", 1529936916123 * 1000), ("1529936916123456", PARIS, "DMY", 1529936916123456), ("1529936916123456789", PARIS, "DMY", 1529936916123456),
    ("43175.125", KATHMANDU, "DMY", us(2018, 3, 16, 3, zone=KATHMANDU)), ("43288", PARIS, "DMY", us(2018, 7, 7, zone=PARIS)), ("20180128", PARIS, "DMY", us(2018, 1, 28, zone=PARIS)),
    ("２０１８－０３－０５ １４：１７", PARIS, "DMY", us(2018, 3, 5, 14, 17, zone=PARIS)), ("٢٠٢٤-٠٨-٢٠ ٠٦:٥٢", PARIS, "DMY", us(2024, 8, 20, 6, 52, zone=PARIS)),
    ("9 février 2025, 18:28", PARIS, "DMY", us(2025, 2, 9, 18, 28, zone=PARIS)), ("22 août 2022 12h21", PARIS, "DMY", us(2022, 8, 22, 12, 21, zone=PARIS)), ("July 4, 2018 11:12 PM", NEW_YORK, "MDY", us(2018, 7, 4, 23, 12, zone=NEW_YORK)),
    ("Mar 5, 2018 12:00 AM", PARIS, "DMY", us(2018, 3, 5, zone=PARIS)), ("2018-10-21T10:15:47.667759912Z", PARIS, "DMY", us(2018, 10, 21, 10, 15, 47, 667759)), ("2024-04-13 11:13:39,594", PARIS, "DMY", us(2024, 4, 13, 11, 13, 39, 594000, zone=PARIS)),
    ("2018-12-25 14:06:56 GMT+03:00", PARIS, "DMY", us(2018, 12, 25, 11, 6, 56)), ("2018-06-09T03:32:54-04:00[America/New_York]", PARIS, "DMY", us(2018, 6, 9, 7, 32, 54)), ("2020-01-01 10:00 Asia/Kathmandu", PARIS, "DMY", us(2020, 1, 1, 10, zone=KATHMANDU)),
    ('"2018-02-15T23:44:28Z"', PARIS, "DMY", us(2018, 2, 15, 23, 44, 28)), ("2018-04-03t01:37:14z ", None, None, us(2018, 4, 3, 1, 37, 14)), ("2024-03-01 10:00", None, "DMY", None), ("03/04/2024", PARIS, None, None),
    ("2021-02-30", PARIS, "DMY", None), ("31/04/2022 10:00", PARIS, "DMY", None), ("13/13/2020", PARIS, "DMY", None), ("T12:00:00Z", PARIS, "DMY", None), ("Q3 2022", PARIS, "DMY", None), ("0000-00-00", PARIS, "DMY", None),
    ("", PARIS, "DMY", None), (" ", PARIS, "DMY", None), (None, PARIS, "DMY", None), ("#VALUE!", PARIS, "DMY", None), ("2021-02-30T00:00:00Z", PARIS, "DMY", None), ("1" * 5000, PARIS, "DMY", None),
    ("2018-02-27 14:23:04 PST", "Asia/Manila", "MDY", us(2018, 2, 27, 6, 23, 4)), ("24:00", PARIS, "DMY", None), ("2024-01-01 24:00", PARIS, "DMY", us(2024, 1, 2, zone=PARIS)), ("0", PARIS, "DMY", None),
]


def test_instants(spark, tmp_path):
    df = spark.createDataFrame([(i, t, z, o, "x") for i, (t, z, o, _) in enumerate(CASES + CASES[:3])], "id int, t string, z string, o string, text string")
    store = I.InstantDictionary(spark, str(tmp_path / "d"))
    got = {r.id: r.utc_us for r in I.normalise_instants(df, "t", "z", "o", store).collect()}
    bad = [(c[0], c[3], got[i]) for i, c in enumerate(CASES) if got[i] != c[3]]
    assert not bad
    assert len(got) == len(CASES) + 3
    before = store.read().count()
    I.normalise_instants(df, "t", "z", "o", store).count()
    assert store.read().count() == before  # nothing is parsed again
    assert I.normalise_instants(df.limit(0), "t", "z", "o", store).count() == 0
    # two runs at once parse the same texts into folders of their own: no row is lost or doubled
    both = I.InstantDictionary(spark, str(tmp_path / "both"))
    for _ in range(2):
        I.parse_dictionary(I.dictionary_entries(df, "t", "z", "o").distinct()).write.parquet(f"{both.path}/batch-000000-{_}")
    assert {r.id: r.utc_us for r in I.normalise_instants(df, "t", "z", "o", both).collect()} == got
    many = df.select("id", "t", "z", "o", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("x"))
    assert I.normalise_instants(many, "t", "z", "o", I.InstantDictionary(spark, str(tmp_path / "m"))).where("utc_us is not null").count() == 40 * sum(v is not None for v in got.values())


# ------------------------------------------------------------------ plans


def test_salted_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 == 0 else str(i % 5)) for i in range(300)] + [(999, None)], "id long, k string")
    right = spark.createDataFrame([("hot", 1), ("1", 2), ("9", 3), (None, 4)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, left.join(right, ["k"], how).collect()))
        assert sorted(map(str, join_dimension(left, right, ["k"], how, max_rows=1, spread=F.col("id")).collect())) == want
        assert sorted(map(str, join_dimension(left, right, ["k"], how).collect())) == want
    with pytest.raises(ValueError):
        join_dimension(left, right, ["k"], "full")


@pytest.mark.parametrize("hot_rows", [10, 70, 1000])
def test_salts_of_hot_keys(spark, monkeypatch, hot_rows):
    """Only the keys of many rows are repeated; a table beyond the counted broadcast doesn't go through the driver after all."""
    monkeypatch.setattr(joins, "HOT_ROWS", hot_rows)
    left = spark.createDataFrame([(i, "hot" if i % 3 == 0 else str(i % 5)) for i in range(300)] + [(999, None)], "id long, k string")
    right = materialise(spark.createDataFrame([("hot", 1), ("hot", 5), ("1", 2), ("9", 3), (None, 4)], "k string, v int"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = left.join(right, ["k"], how)
        for spread, hot in ((None, None), (F.col("id"), None), (F.col("id"), lambda: hot_keys(left, ["k"]))):
            got = join_dimension(left, right, ["k"], how, max_rows=1, spread=spread, hot=hot)
            assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
            merged = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            assert "SortMergeJoin" in merged and merged.count("BroadcastHashJoin") <= (2 if hot else 0)
    assert {r.k for r in hot_keys(left, ["k"]).collect()} == {10: {"hot", *"01234"}, 70: {"hot"}, 1000: set()}[hot_rows]


@pytest.mark.parametrize("width", [1, 7, 400])
def test_range_join(spark, width):
    rnd = random.Random(5)
    day = lambda: date(2024, 1, 1) + timedelta(days=rnd.randint(0, 60))
    spans = [(rnd.choice("ab"), a, a + timedelta(days=rnd.randint(-2, 20)), i) for i, a in enumerate(day() for _ in range(30))] + [(None, day(), day(), 90), ("a", None, day(), 91)]
    points = [(rnd.choice(["a", "b", None]), rnd.choice([None, *[day()] * 9]), i) for i in range(80)] + [("a", date(2024, 1, 5), 1)] * 2
    p, s = spark.createDataFrame(points, "k string, d date, i int"), spark.createDataFrame(spans, "k string, lo date, hi date, j int")
    hits = [(i, j) for k, d, i in points for u, a, b, j in spans if k and k == u and d and a and a <= d < b]
    got = range_join(p, s, "d", "lo", "hi", width, ["k"]).collect()
    assert sorted((r.i, r.j) for r in got) == sorted(hits)
    outer = range_join(p, s, "d", "lo", "hi", width, ["k"], "left").collect()
    assert sorted((r.i, -1 if r.j is None else r.j) for r in outer) == sorted(hits + [(i, -1) for k, d, i in points if not any(k and k == u and d and a and a <= d < b for u, a, b, _ in spans)])


def test_latest_before(spark):
    rnd = random.Random(6)
    t = lambda: datetime(2024, 1, rnd.randint(1, 9), rnd.randint(0, 3))
    marks, rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, t(), t()])) for _ in range(40)], [(i, rnd.choice(["a", "a", "b", "c", None]), rnd.choice([None, *[t()] * 9])) for i in range(90)]
    got = latest_before(spark.createDataFrame(rows + rows[:5], "i int, g string, x timestamp_ntz"), spark.createDataFrame(marks, "g string, m timestamp_ntz"), "x", "m", ["g"]).collect()
    want = {i: max((m for g, m in marks if m and x and g and g == k and m <= x), default=None) for i, k, x in rows}
    assert len(got) == 95 and all(r.m == want[r.i] for r in got)


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_ranked_in_groups(spark, monkeypatch, most):
    import vigilark.plans.ranks as R

    monkeypatch.setattr(R, "MAX_PLANNED", most)
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", 10)
    df = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else str(i % 7)) for i in range(200)], "id long, g string")
    got = ranked_in_groups(df, "g", ["id"]).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in groups.values()) and len(got) == 200
    assert ranked_in_groups(df.limit(0), "g", ["id"]).count() == 0


def test_scratch(spark):
    from vigilark.session import clear_scratch, known_size, list_dir, materialise, materialise_all, shared_dir

    df = materialise(spark.range(3), "test-scratch")
    assert known_size(df) == (3, 48) and known_size(spark.range(3)) is None and known_size(materialise(spark.range(3).where("id > 5"))) == (0, 0)
    assert df.count() == 3 and any(n.startswith("test-scratch") for n in list_dir(spark, shared_dir(spark)))
    a, b = materialise_all((spark.range(2), "one"), (spark.range(5), "two"))
    assert (a.count(), b.count(), known_size(b)) == (2, 5, (5, 80))
    clear_scratch(spark)
    assert not any(n.startswith("test-scratch") for n in list_dir(spark, shared_dir(spark)))
