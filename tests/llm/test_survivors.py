import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vigilark.llm import survivors as S
from vigilark.plans import joins as P

SCHEMA = "id long, g string, a string, b string, trust int, at timestamp"


def rows(seed=1, n=300):
    rnd = random.Random(seed)
    return [
        (i, rnd.choice(["hot", "hot", *"uvwxyz", None]), rnd.choice([None, "", "N/A", " unknown ", "-", "Lens", "LENS", "valve"]), rnd.choice([None, "?", "x"]), rnd.choice([None, 0, 3, 5]), rnd.choice([None, datetime(2024, rnd.randint(1, 3), 1)]))
        for i in range(n)
    ]


def value(v):
    return v is not None and v.strip().upper() not in S.NO_VALUE


def test_ranked(spark):
    data = rows()
    df = spark.createDataFrame(data + data[:50], SCHEMA).withColumn("value", F.lit(1)).withColumn("field_name", F.lit("clash"))
    got = {(r.group_id, r.field_name): r.id for r in S.survivors(df, ["g"], "id", ["a", "b"], "trust", "at", "ranked").collect()}
    want = {}
    for g in {r[1] for r in data if r[1]}:
        mine = [r for r in data if r[1] == g]
        if len(mine) < 2:
            continue
        for k, f in ((2, "a"), (3, "b")):
            have = [r for r in mine if value(r[k])]
            if have:
                want[min(r[0] for r in mine), f] = max(have, key=lambda r: (r[4] or 0, r[5] is not None, r[5] or datetime.min, -r[0]))[0]
    assert got == want and want
    assert S.survivors(df.limit(0), ["g"], "id", ["a"], "trust", "at", "ranked").count() == 0


def test_summed_votes(spark):
    """Two sources of some trust outvote one of more; an old vote counts less; spelling comes from the strongest vote."""
    t = lambda y: datetime(y, 1, 1)
    data = [(1, "g", "Lens", None, 4, t(2024)), (2, "g", "valve", None, 3, t(2024)), (3, "g", "VALVE ", None, 2, t(2024)), (4, "h", "old", "b", 5, t(2010)), (5, "h", "new", None, 1, t(2024)), (6, "single", "x", "x", 1, t(2024)), (7, "tie", "b", None, 1, t(2024)), (8, "tie", "a", None, 1, t(2024)), (9, "none", None, None, 1, None), (10, "none", "-", "", 1, None)]
    df = spark.createDataFrame(data + data, SCHEMA)
    won = S.survivors(df, ["g"], "id", ["a", "b"], "trust", "at")
    got = {r.g: (r.a, r.b) for r in S.surviving_records(won, ["g"], ["a", "b"]).collect()}
    assert got == {"g": ("valve", None), "h": ("new", "b"), "tie": ("a", None)}
    assert S.survivors(df.limit(0), ["g"], "id", ["a"], "trust", "at").count() == 0


@pytest.mark.parametrize("votes", ["ranked", "sum"])
@pytest.mark.parametrize("hot_rows", [0, 40, 1000])
def test_groups_beyond_broadcasts(spark, monkeypatch, votes, hot_rows):
    """Groups too many for a broadcast, all, some or none of them of many rows, have the same survivors, and no table of them is broadcast."""
    data = rows()
    df = spark.createDataFrame(data + data[:50] + [(999, "single", "x", "x", 1, None)] * 60, SCHEMA).withColumnRenamed("g", "c")
    run = lambda: S.survivors(df, ["c"], "id", ["a", "b"], "trust", "at", votes)
    want = sorted(map(str, run().collect()))
    no = lambda *_: False
    monkeypatch.setattr(P, "fits", no)
    monkeypatch.setattr(S, "fits", no, raising=False)
    monkeypatch.setattr(S, "HOT_ROWS", hot_rows, raising=False)
    won = run()
    assert sorted(map(str, won.collect())) == want and len(want) > 10
    assert "BroadcastHashJoin" not in won._jdf.queryExecution().executedPlan().toString()


def test_best_vote_outweighs_all_others(spark):
    """A thousand votes of little trust against one, of one trust against a later one, of one time against a smaller id."""
    t = lambda y: datetime(y, 1, 1)
    data = [(1000 + i, "trust", "many", None, 4, t(2024)) for i in range(1000)] + [(5000, "trust", "one", None, 5, None)]
    data += [(6000 + i, "time", "many", None, 4, t(2023)) for i in range(1000)] + [(7500, "time", "one", None, 4, t(2024))]
    data += [(8000 + i, "id", "one" if i == 0 else "many", None, 4, None) for i in range(1000)]
    won = S.survivors(spark.createDataFrame(data, SCHEMA), ["g"], "id", ["a"], "trust", "at", "ranked")
    assert {(r.g, r.id, r.value) for r in won.collect()} == {("trust", 5000, "one"), ("time", 7500, "one"), ("id", 8000, "one")}


def test_times(spark):
    texts = ["2022-12-15 16:09:44", "2022-06-20T03:24:26Z", "2024-08-21T15:37:01+08:00", "1671839788", "1671839788123", "2024-01-01", "soon", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", F.unix_seconds(S.utc_time(F.col("t"))).alias("s"))
    u = lambda *a: int((datetime(*a) - datetime(1970, 1, 1)).total_seconds())
    want = [u(2022, 12, 15, 16, 9, 44), u(2022, 6, 20, 3, 24, 26), u(2024, 8, 21, 7, 37, 1), 1671839788, 1671839788, u(2024, 1, 1), None, None, None]
    assert [r.s for r in df.orderBy("n").collect()] == want
