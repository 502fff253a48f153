import random

import pytest
from pyspark.sql import functions as F

from vigilark.llm import name_mapping as N
from vigilark.operators import set_similarity as J
from vigilark.plans import joins as P

PLACES = [("0", "LOMBOKII", "g1"), ("0", "LOMBOKIINIA", "g2"), ("0", "EAST POVUNAR", "g3"), ("0", "WEST POVUNAR", "g4"), ("0", "QUELI JIACHITEO", "g5"), ("0", "Z.A.A.", "g6"), ("0", "MBENKIZIMIQUE", "g7"), ("1/X", "BAS-TOMMA", "p1"), ("1/X", "NEMKO EST", "p2"), ("1/X", "NEMKO", "p3")]
TYPED = {
    "lombokii": "g1", "LÖMBOKÏI": "g1", "LOМВOKII": "g1", "L0MBOKII": "g1", "Lomb okii": "g1", "LOMB​OKII": "g1", "Lmobokii": "g1", "LOMBOKII (71)": "g1", "Kingdom of Lombokii": "g1", "Lommbokii": "g1",
    "Lmbokiiinia": "g2", "WEST POVNUAR": "g4", "East Pvunar": "g3", "JIACHITEO QUELI": "g5", "Keli Jiachiteo": "g5", "zaa": "g6", "Mbenkizimiq.": "g7", "mbenkizimik": "g7", "Republic of EAST POVUNAR": "g3",
    "VELHUT": None, "national": None, "mobile team 12": None, "99": None, "???": None, "": None, " ": None, "zab": None,
}


def frame(spark, rows):
    df = spark.createDataFrame([(s, n, p) for s, n, p in rows], "scope string, name string, parents array<string>")
    return df.withColumn("id", F.concat_ws("|", "scope", "name")).withColumn("entry", F.lit("clash"))


def test_mapping(spark):
    rows = [("0", n, []) for n in TYPED] + [("1/X", "B. TOMMA", ["X"]), ("1/X", "Tomma Bas, X", ["X"]), ("1/X", "X - nemko est", ["X"]), ("1/X", "Prov. Nemko", ["X"]), ("1/Y", "NEMKO", ["Y"]), (None, "NEMKO", None), ("0", None, None), ("0", "x" * 5000, [])]
    ref = spark.createDataFrame(PLACES + PLACES[:2] + [("0", None, "n"), (None, "LOMBOKII", "n")], "scope string, name string, entry string")
    got = {r.id: r.entry for r in N.map_names(frame(spark, rows), ref).collect()}
    assert {n: got.get(f"0|{n}") for n in TYPED} == TYPED
    assert (got["1/X|B. TOMMA"], got["1/X|Tomma Bas, X"], got["1/X|X - nemko est"], got["1/X|Prov. Nemko"]) == ("p1", "p1", "p2", "p3")
    assert "1/Y|NEMKO" not in got and "NEMKO" not in got
    assert N.map_names(frame(spark, rows), ref.limit(0)).count() == 0
    assert N.map_names(frame(spark, rows).limit(0), ref).count() == 0


def test_mapping_beyond_broadcasts(spark, monkeypatch):
    """Names and pairs too many for a broadcast, some of them in many rows, map to the same entries; only hot keys are broadcast."""
    monkeypatch.setattr(P, "fits", lambda df, *most: not most)
    monkeypatch.setattr(P, "HOT_ROWS", 2)
    rows = [("0", n, []) for n in TYPED]
    mapped = N.map_names(frame(spark, rows), spark.createDataFrame(PLACES, "scope string, name string, entry string"))
    got = {r.id: r.entry for r in mapped.collect()}
    assert {n: got.get(f"0|{n}") for n in TYPED} == TYPED
    plan = mapped._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("SortMergeJoin") == 2 and plan.count("BroadcastHashJoin") == 2


@pytest.mark.parametrize("threshold, rows", [(0.3, 200_000), (0.3, 0), (0.5, 200_000), (0.8, 0)])
def test_join_against_brute_force(spark, monkeypatch, threshold, rows):
    """The prefix, length and position filters lose no pair, whether the prefixes are broadcast or joined under salts."""
    monkeypatch.setattr(J, "BROADCAST_ROWS", rows)
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("ABC") for _ in range(rnd.randint(0, 9)))
    left = [(i, rnd.choice("xy"), w) for i, w in enumerate(sorted({word() for _ in range(120)}))]
    right = [(i, rnd.choice("xy"), w) for i, w in enumerate(sorted({word() for _ in range(60)}))]

    def pairs(w):
        out, t = set(), f"^{w}$"
        for i in range(len(t) - 1):
            k = 1
            while (t[i : i + 2], k) in out:
                k += 1
            out.add((t[i : i + 2], k))
        return out

    want = {}
    for i, s, a in left:
        for j, u, b in right:
            x, y = pairs(a), pairs(b)
            if s == u and a and b and len(x & y) / len(x | y) >= threshold:
                want[i, j] = round(len(x & y) / len(x | y), 9)
    s = "key long, scope string, text string"
    got = {(r.lk, r.rk): round(r.jaccard, 9) for r in J.similarity_join(spark.createDataFrame(left, s), spark.createDataFrame(right, s), "key", "text", "scope", threshold).collect()}
    assert got == want and want


def test_hot_spelling(spark, tmp_path):
    """A third of the rows is one spelling: no task gets them all, and the best entry is that of the greatest similarity."""
    from vigilark.llm import queries as Q

    shp = spark.createDataFrame([(n, f"{{G{i}}}") for i, n in enumerate(("LOMBOKII", "LOMBOKIINIA", "KIMLOO"))], "ADM0_NAME string, ADM0_GUID string")
    for c in ("ADM1_NAME", "ADM1_GUID", "ADM2_NAME", "ADM2_GUID"):
        shp = shp.withColumn(c, F.lit(None).cast("string"))
    shp.withColumn("ENDDATE", F.lit("9999-12-31").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/shp_global.parquet")
    sia = spark.range(3000).select(F.col("id").alias("ActivityId"), F.when(F.col("id") % 3 == 0, "Lombokki").otherwise(F.concat(F.lit("Kimlo"), F.col("id").cast("string"))).alias("Admin0Name"))
    sia.union(spark.createDataFrame([(5000, None), (5001, " "), (5002, "KIMLOO")], "ActivityId long, Admin0Name string")).write.parquet(f"{tmp_path}/polis_sia.parquet")
    spark.createDataFrame([], "todo_id long, level string, name_to_match string, level0_name string, level1_name string").write.parquet(f"{tmp_path}/geoname_todo.parquet")
    spark.createDataFrame([(1, "level0", "Lombok Land", "{G0}")], "synonym_id int, level string, synonym string, adm_guid string").write.parquet(f"{tmp_path}/geo_synonym.parquet")
    got = Q.p1_found(spark, str(tmp_path)).groupBy("canon_guid").count().collect()
    n = {r.canon_guid: r["count"] for r in got}
    assert n["g0"] == 1000 and sum(n.values()) == 3000 and set(n) <= {"g0", "g2", "none"}
