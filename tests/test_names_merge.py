import random
from datetime import date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigilark.functions import distance as D
from vigilark.functions.fmt import big_mark, decimal_places, detection_text
from vigilark.functions.text import fold_accents, name_key
from vigilark.operators import merge as M
from vigilark.operators import names as N
from vigilark.operators import raster as R

words = st.text("abcdé ", max_size=8)


@settings(deadline=None, max_examples=150)
@given(words, words)
def test_distance_laws(a, b):
    for m, f in D._METHODS.items():
        assert f(a, a) == 0, m
        assert f(a, b) == pytest.approx(f(b, a)), m
        assert f(a, b) >= 0, m
    assert D.damerau(a, b) <= D.osa(a, b) <= D.lcs(a, b)


def test_distance_values():
    assert D.damerau("CA", "ABC") == 2 and D.osa("CA", "ABC") == 3
    assert D.jaro("MARTHA", "MARHTA") == pytest.approx(1 - 0.944444, abs=1e-5)
    assert D.jaro_winkler("DIXON", "DICKSONX") == pytest.approx(1 - 0.813333, abs=1e-5)
    assert D.hamming("abc", "ab") == float("inf") and D.lcs("abcd", "bd") == 2
    assert D.qgram("abc", "abd") == 2 and D.jaccard("abc", "abd") == 0.5 and D.jaro("", "") == 0


def test_rank_matches(spark):
    a = spark.createDataFrame([("New York",), ("Los Angeles",), (None,)], "n string")
    b = spark.createDataFrame([("New York",), ("Los Angeles",), ("Chicago",)], "n string")
    r = N.rank_matches(a, b, "n", "n", method="lv").orderBy("name_to_match", "match_rank").collect()
    assert [x.matched_names for x in r] == ["Los Angeles", "Chicago", "New York", "New York", "Chicago", "Los Angeles"]  # ties by name
    assert [x.distance for x in r] == [0, 10, 10, 0, 8, 10]
    with pytest.raises(ValueError, match="unknown method"):
        N.rank_matches(a, b, "n", "n", method="zz")
    for m in D.METHODS:
        assert N.rank_matches(a, b, "n", "n", method=m, top=1).where("name_to_match = matched_names").count() == 2


def test_suggestions_of_whole_table(spark, tmp_path):
    """All levels, letters outside ASCII as typed, by every method."""
    from vigilark.queries import reference

    todo = [(1, "Level0 ", "Angolá", None, None), (2, "level1", "Cabïnda", "ANGOLA", None), (3, "level1", "Cabînda", "ANGOLA", None), (4, "LEVEL2", "Belizé", "ANGOLA", "CABINDA"), (5, "level2", None, "ANGOLA", "CABINDA")]
    spark.createDataFrame(todo, "todo_id long, level string, name_to_match string, level0_name string, level1_name string").write.parquet(f"{tmp_path}/geoname_todo.parquet")
    shp = spark.createDataFrame([("ANGOLA", "CABINDA", "BELIZE"), ("UGANDA", "TESO", "BUKEDEA")], "ADM0_NAME string, ADM1_NAME string, ADM2_NAME string").withColumn("ENDDATE", F.lit("9999-12-31").cast("timestamp_ntz"))
    shp.write.parquet(f"{tmp_path}/shp_global.parquet")
    q = reference.queries()
    for m in D.METHODS:
        got = q[f"suggest_{m}"](spark, str(tmp_path)).where("match_rank = 1").collect()
        assert {(r.level, r.name_to_match) for r in got} == {("level0", "ANGOLÁ"), ("level1", "CABÏNDA"), ("level1", "CABÎNDA"), ("level2", "BELIZÉ")}, m
        if m == "lv":
            assert {(r.matched_names, r.distance) for r in got} == {("ANGOLA", 1.0), ("CABINDA", 1.0), ("BELIZE", 1.0)}


def test_all_decisions_are_applied(spark, tmp_path):
    """A decision of level 0 has no parents; lower levels are found under the corrected ones."""
    from vigilark.queries import reference

    rows = [(1, "Level0", "Uga", "Uganda", None, None, "2024"), (2, "level1", "Tezo", "Teso", "UGANDA", None, "2024"), (3, "level2", "Bokedea", "Bukedea", "Uganda", "Teso", "2024"), (4, "level2", "Bokedea", "X", "UGA", "TEZO", None)]
    df = spark.createDataFrame(rows, "decision_id long, level string, name_to_match string, replacement string, level0_prepped string, level1_prepped string, created_time string")
    df.withColumn("level2_prepped", F.lit(None).cast("string")).write.parquet(f"{tmp_path}/geoname_cache.parquet")
    got = {r.decision_id: tuple(r)[2:] for r in reference.queries()["apply_decisions"](spark, str(tmp_path)).collect()}
    full = ("UGANDA", "TESO", "BUKEDEA")
    assert got == {1: ("UGANDA", None, None), 2: ("UGANDA", "TESO", None), 3: full, 4: full}


@pytest.mark.parametrize("method", D.METHODS)
def test_jvm_distances_equal_python(spark, method):
    texts = ["", "a", "ab", "ba", "aab", "KAROLIN", "KATHRIN", "CAROLINE", "Ñandú", "东京都", "Tymczak", "Pfister", "Ashcraft", "Honeyman", "9x", "Q-R S"]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts] + [(None, "a"), ("a", None)], "a string, b string")
    one = D.distance_function(method)
    for r in df.select("a", "b", D.string_distance(F.col("a"), F.col("b"), method).alias("d")).collect():
        assert (r.d is None) if r.a is None or r.b is None else r.d == pytest.approx(one(r.a, r.b), abs=1e-9), (r.a, r.b)


@pytest.mark.parametrize("method", ["lv", "jw", "soundex"])
def test_blocks_without_parents(spark, monkeypatch, method):
    """Many reference names in blocks rank as one list does, ties by name."""
    monkeypatch.setattr(N, "REFERENCE_PER_TASK", 40)
    monkeypatch.setattr(N, "NAMES_PER_TASK", 5)
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("ABCÉ") for _ in range(rnd.randint(0, 6)))
    names, ref = sorted({word() for _ in range(20)}), sorted({word() for _ in range(150)})
    a = spark.createDataFrame([(w, "x") for w in names + names[:3]] + [(None, "x")], "n string, distance string")
    b = spark.createDataFrame([(w,) for w in ref + ref[:3]] + [(None,)], "c string")
    one = D.distance_function(method)
    got = {}
    for r in N.rank_matches(a, b, "n", "c", [], method, 3).collect():
        got.setdefault(r.name_to_match, {})[r.match_rank] = r.matched_names
    for n in names:
        assert [got[n][k] for k in (1, 2, 3)] == sorted(ref, key=lambda c: (round(one(n, c), 9), c))[:3]
    assert N.rank_matches(a, b.limit(0), "n", "c", [], method, 3).count() == 0 and N.rank_matches(a, b, "n", "c", [], method).count() == len(names) * len(ref)


def test_many_reference_names(spark):
    """A quarter of a million reference names and no parent: the true name is found first."""
    ref = spark.range(250_000).select(F.concat(F.lit("PLACE"), F.hex(F.col("id") * 7919)).alias("c"))
    a = spark.createDataFrame([("PLACE1EEF",), ("PLACE73A27C1X",)], "n string")
    got = {r.name_to_match: (r.matched_names, r.distance) for r in N.rank_matches(a, ref, "n", "c", [], "lv", 1).collect()}
    best = {r.n: r.d for r in a.join(ref).groupBy("n").agg(F.min(F.levenshtein("n", "c")).alias("d")).collect()}
    assert got["PLACE1EEF"] == ("PLACE1EEF", 0.0) and {n: d for n, (_, d) in got.items()} == best


def test_five_levels_region_and_store(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    levels = [f"l{i}" for i in range(5)]
    ref = spark.createDataFrame([("A", "B", "C", "D", "E", "afro"), ("A", "B", "C", "D", "F", "EURO")], ", ".join(f"{c} string" for c in [*levels, "WHO_REGION"]))
    t = spark.createDataFrame([("a", "b", "c", "d", "e"), ("a", "b", "c", "d", "x"), ("z", "b", "c", "d", "e"), ("a", None, "c", "d", "e")], ", ".join(f"{c} string" for c in levels))
    s = "level string, name_to_match string, replacement string, created_time string, " + ", ".join(f"level{i}_prepped string" for i in range(5))
    decisions = [("level4", "X", "E", "2024-01-01", "A", "B", "C", "D", None), ("level0", "Z", "A", "2024-01-01", None, None, None, None, None), ("level4", "X", "Q", "2020-01-01", "A", "B", "C", "D", None)]
    store = N.DecisionStore(spark, str(tmp_path / "decisions"))
    assert store.read() is None
    with ThreadPoolExecutor(3) as pool:
        assert sorted(pool.map(lambda r: store.save(spark.createDataFrame([r], s)), decisions)) == [1, 2, 3]
    done, todo = N.prep_geonames(t, ref, levels, store.read(), top=2, who_region="AFRO")
    assert sorted((r.l0, r.l4, r.matched) for r in done.collect()) == [("A", "E", False), ("A", "E", True), ("A", "E", True), ("A", "E", True)]
    assert N.prep_geonames(t, ref, levels, None, who_region="euro")[0].where("matched").count() == 0
    with pytest.raises(ValueError, match="not present"):
        N.prep_geonames(t, ref, ["nothing"])
    got = N.split_long_name(spark.createDataFrame([("A_B_C",), ("A",), (None,)], "g string"), "g", ["x", "y"]).collect()
    assert [tuple(r) for r in got] == [("A_B_C", "A", "B"), ("A", "A", None), (None, None, None)]


def test_match_names_and_types(spark):
    ref = spark.createDataFrame([], "CountryName string, NameOfCapital string, ProvinceName string, DistrictName string, SiteName string")
    t = spark.createDataFrame([], "COUNTRYNAME string, nameofcapital string, province_Name string, DISTRICT_name string, siteName string, GDP string")
    out, rest = N.match_names(ref, t)
    assert out.columns == [*ref.columns, "GDP"] and rest == ["GDP"]
    types = spark.createDataFrame([], "i int, l boolean, s string, n double, d date, p timestamp")
    raw = spark.createDataFrame([("1.7", "T", "a", "1.5", "2024-02-29", "x", "k"), ("x", "yes", None, "", "2023-02-29", "y", None)], "i string, l string, s string, n string, d string, p string, extra string")
    a, b = N.match_datatypes(types, raw).collect()
    assert (a.i, a.l, a.s, a.n, a.d, a.p) == (1, True, "a", 1.5, date(2024, 2, 29), "x") and (b.i, b.l, b.n, b.d) == (None, None, None, None)


def test_prep_geonames(spark):
    lookup = spark.createDataFrame([("ANGOLA", "CABINDA", "BELIZE"), ("UGANDA", "TESO", "BUKEDEA"), ("ZAMBIA", "LUSAKA", "RUFUNSA")], "a string, b string, c string")
    target = spark.createDataFrame([("Angola", "CABONDA", "BALIZE", 1), ("UGA", "TESO", "BOKEDEA", 2), ("ZAMBIA", "LUSAKA", "RAFUNSA", 3), (None, None, None, 4)], "a string, b string, c string, k int")
    done, todo = N.prep_geonames(target, lookup, ["a", "b", "c"], method="lv")
    assert done.where("matched").count() == 0
    first = {(r.level, r.name_to_match): r.matched_names for r in todo.where("match_rank = 1").collect()}
    assert first == {("level0", "UGA"): "UGANDA", ("level1", "CABONDA"): "CABINDA", ("level2", "RAFUNSA"): "RUFUNSA", ("level2", "BOKEDEA"): "BUKEDEA"}
    s = "level string, name_to_match string, replacement string, level0_prepped string, level1_prepped string, created_time string"
    decided = spark.createDataFrame([("level0", "uga", "Uganda", None, None, "2024"), ("level0", "UGA", "KENYA", None, None, "2023"), ("level1", "CABONDA", "CABINDA", "ANGOLA", None, "2024"), ("level2", "BALIZE", "BELIZE", "ANGOLA", "CABINDA", "2024"), ("level2", "BOKEDEA", "BUKEDEA", "UGANDA", "TESO", "2024"), ("level2", "RAFUNSA", "WRONG", "OTHER", "LUSAKA", "2024")], s)
    done, todo = N.prep_geonames(target, lookup, ["a", "b", "c"], decided, "lv")
    got = {r.k: (r.a, r.b, r.c, r.matched) for r in done.collect()}
    assert got == {1: ("ANGOLA", "CABINDA", "BELIZE", True), 2: ("UGANDA", "TESO", "BUKEDEA", True), 3: ("ZAMBIA", "LUSAKA", "RAFUNSA", False), 4: (None, None, None, False)}
    stats = {r.level: (r.matched, r.total) for r in N.match_stats(lookup, lookup, ["a", "b", "c"]).collect()}
    assert stats == {"a": (3, 3), "b": (3, 3), "c": (3, 3)}
    merged = N.merge_decisions(decided.where("replacement <> 'KENYA'"), decided.where("replacement = 'KENYA'"))
    assert merged.count() == 6 and merged.where("upper(name_to_match) = 'UGA'").count() == 2


def test_merge(spark):
    s = "_id long, form int, v string, t timestamp_ntz"
    old = spark.createDataFrame([(1, 1, "a", datetime(2024, 1, 1)), (2, 1, "b", None), (None, 1, "n", datetime(2024, 1, 1))], s)
    new = spark.createDataFrame([(1, 1, "c", datetime(2024, 2, 1)), (2, 1, "d", datetime(2020, 1, 1)), (3, 2, "e", None), (None, 1, "m", datetime(2023, 1, 1))], s).withColumn("extra", F.lit(1))
    got = {(r._id, r.form): (r.v, r.extra) for r in M.merge_latest(old, new, ["_id", "form"], "t").collect()}
    assert got == {(1, 1): ("c", 1), (2, 1): ("d", 1), (3, 2): ("e", 1), (None, 1): ("n", None)}
    again = M.merge_latest(M.merge_latest(old, new, ["_id", "form"], "t"), new, ["_id", "form"], "t")
    assert again.count() == 4
    assert M.merge_latest(None, new.limit(0), ["_id"], "t").count() == 0


def test_append_and_logs(spark):
    days = lambda a, b: spark.createDataFrame([(date(2021, 1, d),) for d in range(a, b)], "Date date")
    assert M.append_since(days(1, 11), days(5, 21), "Date").count() == 20
    assert M.append_since(days(1, 11).limit(0), days(5, 21), "Date", until="2021-01-10").count() == 6
    df = spark.createDataFrame([(1, None, None), (2, "x", None)], "a int, b string, c string")
    assert M.drop_empty_columns(df).columns == ["a", "b"] and M.drop_empty_columns(df.limit(0)).columns == ["a", "b", "c"]
    log = {r.a: r.note for r in M.load_log(df.where("a = 1").drop("c"), df, "a").collect()}
    assert log == {1: "", 2: " Initial Download"}
    assert M.append_log(df, df.withColumn("c", F.lit("later")), ["a"], "c").where("c is null").count() == 0


def test_formatting(spark):
    df = spark.createDataFrame([(40.7128,), (-74.006,), (45.0,), (-45.0,), (0.1 + 0.2,), (12.345678901234567,), (None,)], "v double")
    assert [r[0] for r in df.select(decimal_places(F.col("v"))).collect()] == [4, 3, 2, 3, 1, 13, None]
    d = spark.createDataFrame([("WPV1", 2.0), ("cVDPV2", 1.0), ("other", 1.0)], "v string, n double")
    assert [r[0] for r in d.select(detection_text(F.col("n"), F.col("v"), ["WPV1", "cVDPV2"])).collect()] == ["2 WPV1", "1 cVDPV2", None]
    assert d.select(big_mark(F.lit(1234567.891), 2, " ")).first()[0] == "1 234 567.89"


def test_folding(spark):
    df = spark.createDataFrame([("Goménimofé.",), ("ＡＢ",), ("Straße ﬁx",), ("  -- ",), (None,), ("éA",)], "t string")
    assert [r[0] for r in df.select(name_key(F.col("t"))).collect()] == ["gomenimofe", "ab", "strassefix", "", None, "ea"]
    assert df.select(fold_accents(F.lit("Łódź Ñ"))).first()[0] == "Lodz N"


def test_bands(spark):
    assert [r.lower for r in R.overlapping_bands(spark, 1, 10).orderBy("lower").collect()] == [1, 5, 10]
    assert [r.lower for r in R.overlapping_bands(spark, 85, 99).collect()] == [80]
    cells = spark.createDataFrame([("A", 2020, "m", 1, 0, 0, 2.0), ("A", 2020, "f", 5, 0, 0, 3.0), ("A", 2020, "f", 20, 0, 0, 9.0), ("A", 2020, "m", 5, 1, 0, None), ("A", 2020, "f", 5, 1, 0, 1.0)], "iso3 string, year int, sex string, lower int, x int, y int, value double")
    assert {(r.x, r.value) for r in R.age_band_sum(cells, 1, 9).collect()} == {(0, 5.0), (1, None)}
