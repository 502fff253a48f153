import math
import random

import pytest
from pyspark.sql import functions as F

from vigilark.operators import coords as C
from vigilark.operators import spatial as S

DIM = [("{0CDA1C45-9529-4188-BE2F-863E287EDA71}", 40.7128, -74.0060), ("{387991C9-EA43-4C8C-8C96-E7F69F068F16}", 41.8781, -87.6298)]
ARGS = ("id", "region_id", "lat", "lon", "correct_lat", "correct_lon")


@pytest.fixture
def dim(spark):
    return spark.createDataFrame(DIM, "region_id string, correct_lat double, correct_lon double")


def test_flip(spark, dim):
    df = spark.createDataFrame([(DIM[0][0], 40.7128, -74.0060), (DIM[1][0].lower(), -74.0060, 40.7128)], "id string, lat double, lon double")
    got = sorted(C.correct_flipped(df, dim, *ARGS).collect(), key=lambda r: r.potentially_flipped)
    assert [r.potentially_flipped for r in got] == [False, True]
    assert [round(r.lat) for r in got] == [41, 41] and [round(r.lon) for r in got] == [-74, -74]
    assert got[0].asDict().keys() >= {"flipped_confidence_score"} and list(got[0].asDict())[-2:] == ["lat", "lon"]


@pytest.mark.parametrize("k, args, message", [
    (0, ("no", "region_id", "lat", "lon", "correct_lat", "correct_lon"), "join key 'no' is not present in the data"),
    (1, ("id", "no", "lat", "lon", "correct_lat", "correct_lon"), "join key 'no' is not present in the shapefile_data"),
    (2, ("id", "region_id", "lat", "lon", "no", "correct_lon"), "column 'no' is not present in the shapefile_data"),
    (3, ("id", "region_id", "lat", "lon", "correct_lat", "no"), "column 'no' is not present in the shapefile_data"),
])
def test_errors(spark, dim, k, args, message):
    with pytest.raises(ValueError, match=message):
        C.check_coord_flip(spark.createDataFrame([("a", 1.0, 2.0)], "id string, lat double, lon double"), dim, *args)


def test_check_coords(spark):
    rows = [("A1", "40.7128", "-74.0060", "USA"), ("B2", "-74.0060", "40.7128", "USA"), ("C3", None, "-0.1278", "UK"), ("D4", "51.5074", None, "UK"), ("E5", "48.8566", "2.3522", "France"), ("F6", "x", "1", "France"), ("G7", "95", "0", None), ("H8", "0", "0", "UK")]
    df = spark.createDataFrame(rows, "id string, lat string, lon string, country string")
    got = {r.id: r for r in C.check_coords(df, "lat", "lon", land=[[(-10, 40), (10, 40), (10, 60), (-10, 60)]]).collect()}
    assert [k for k, r in got.items() if r.missing_coords] == ["C3", "D4"]
    assert [k for k, r in got.items() if r.parse_failed] == ["F6"]
    assert [k for k, r in got.items() if r.out_of_bounds] == ["G7"]
    assert [k for k, r in got.items() if r.null_count] == ["H8"]
    assert (got["A1"].lat_precision, got["A1"].lon_precision, got["H8"].lat_precision) == (4, 3, 1)
    assert got["E5"].on_water == "Land" and got["A1"].on_water == "Ocean" and got["C3"].on_water is None
    flags = C.check_coords(df, "lat", "lon")
    by = C.summarise_coords(flags, ["country"])
    assert by.count() == 4 and "Missing Coords" in by.columns
    assert C.summarise_coords(flags).first()["Missing Coords"] == "2"
    with pytest.raises(ValueError, match="unknown checks"):
        C.check_coords(df, "lat", "lon", ["nothing"])
    assert C.check_coords(df.limit(0), "lat", "lon").count() == 0


def test_land_water(spark):
    land, lake = [[(0, 0), (10, 0), (10, 10), (0, 10)]], [[(4, 4), (6, 4), (6, 6), (4, 6)]]
    df = spark.createDataFrame([(0, 5.0, 5.0), (1, 1.0, 1.0), (2, 20.0, 20.0), (3, None, 1.0)], "n int, x double, y double")
    got = df.select("n", C.land_water(F.col("x"), F.col("y"), land, lake).alias("w")).orderBy("n").collect()
    assert [r.w for r in got] == ["Inland water", "Land", "Ocean", None]


def test_nearest(spark):
    dim = spark.createDataFrame(
        [(-4.222, 15.02222, "9999-12-31 01:00:00", "Mock Area 1"), (-3.2, 43.2, "9999-12-31 01:00:00", "Mock Area 2"), (-24.5, 23.5, "9999-12-31 01:00:00", "Mock Area 3"), (-24.0, 15.9, "2001-01-01 00:00:00", "Old")],
        "CENTER_LON double, CENTER_LAT double, ENDDATE string, ADM2_NAME string",
    )
    df = spark.createDataFrame([(1, -24.0, 15.9), (2, None, 1.0), (3, 170.0, -80.0)], "id int, lon double, lat double")
    got = {r.id: r.adm for r in C.find_nearest(df, "id", "lon", "lat", dim).collect()}
    assert got == {1: "Mock Area 3", 3: "Mock Area 1"}


def hav(x, y, u, v):
    a = math.sin(math.radians(v - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(v)) * math.sin(math.radians(u - x) / 2) ** 2
    return 2 * S.EARTH_KM * math.asin(min(1, math.sqrt(a)))


@pytest.mark.parametrize("limit", [200_000, 40])
def test_near_centres(spark, limit):
    """Both forms, one hierarchy and cells, against brute force: poles, date line, repeated and missing rows, ties of two districts in one place."""
    rnd = random.Random(5)
    places = [(0.0, 0.0), (179.999, 10.0), (-179.999, 10.0), (20.0, 89.99), (-160.0, 89.985), (10.0, -89.9), (0.01, 0.01), (50.0, 78.5), (50.05, 78.5)]
    centres = [(f"c{i}", x, y) for i, (x, y) in enumerate(places + [(rnd.uniform(-1, 1), rnd.uniform(-1, 1)) for _ in range(30)])] + [("twin", 0.0, 0.0), ("gone", None, 1.0), (None, 0.0, 0.0)]
    near = [(max(-180.0, min(180.0, x + rnd.uniform(-0.05, 0.05))), max(-90.0, min(90.0, y + rnd.uniform(-0.05, 0.05)))) for x, y in places for _ in range(20)]
    points = [(i, x, y) for i, (x, y) in enumerate(near + [(180.0, 10.0), (-180.0, 10.0), (0.0, 90.0), (12.0, -90.0)])] + [(0, *near[0]), (900, None, 1.0), (901, 200.0, 0.0), (902, float("nan"), 0.0)]
    p = spark.createDataFrame(points, "id long, lon double, lat double").withColumn("region", F.lit("clash"))
    c = spark.createDataFrame(centres, "cid string, x double, y double")
    got = {(r.id, r.cid) for r in S.points_near_centres(p, "id", "lon", "lat", c, "cid", "x", "y", 3.0, limit).collect()}
    want = {(i, k) for i, x, y in points for k, u, v in centres if i < 900 and k and u is not None and hav(x, y, u, v) <= 3.0}
    assert got == want and want
    assert S.points_near_centres(p.limit(0), "id", "lon", "lat", c, "cid", "x", "y", 3.0, limit).count() == 0
    assert S.points_near_centres(p, "id", "lon", "lat", c.limit(0), "cid", "x", "y", 3.0, limit).count() == 0


@pytest.mark.parametrize("limit", [500_000, 50])
def test_nearest_centres(spark, limit):
    """Both forms against brute force: poles, date line, ties of two centres in one place, repeated and missing rows."""
    rnd = random.Random(7)
    spots = [(rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for _ in range(300)] + [(rnd.uniform(0, 1), rnd.uniform(0, 1)) for _ in range(200)]
    centres = [(f"c{i}", x, y) for i, (x, y) in enumerate(spots)] + [("a twin", *spots[3]), ("nan", float("nan"), 1.0), (None, 0.0, 0.0), ("none", None, None)]
    points = [(i, rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for i in range(150)] + [(200 + i, x, y) for i, (x, y) in enumerate([spots[3], (180.0, 0.0), (-180.0, 0.0), (0.0, 90.0), (5.0, -90.0), *spots[-9:]])]
    p = spark.createDataFrame(points + points[:5] + [(900, None, 1.0), (None, 1.0, 1.0)], "id long, lon double, lat double").withColumn("reach", F.lit("clash"))
    c = spark.createDataFrame(centres + centres[:9], "nm string, x double, y double")
    got = {r.id: (r.nm, r.km) for r in S.nearest_centres(p, "id", "lon", "lat", c, "nm", "x", "y", limit).collect()}
    assert set(got) == {i for i, _, _ in points}
    for i, x, y in points:
        km, name = min((round(hav(x, y, u, v), 9), n) for n, u, v in centres[:501])
        assert got[i][0] == name and got[i][1] == pytest.approx(km, abs=1e-6)
    assert S.nearest_centres(p, "id", "lon", "lat", c.limit(0), "nm", "x", "y", limit).count() == 0
    assert S.nearest_centres(p.limit(0), "id", "lon", "lat", c, "nm", "x", "y", limit).count() == 0


def test_many_centres_and_triangles(spark):
    """60,000 centres give what the broadcast form gives, in cells that are split; so do 100,000 triangles, without a literal per cell."""
    c = spark.range(60_000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("nm"), ((F.hash("id") % 18000) / 100.0).cast("double").alias("x"), ((F.hash(F.col("id") + 7) % 9000) / 100.0).cast("double").alias("y"))
    p = spark.range(500).select("id", ((F.hash(F.col("id") + 1) % 18000) / 100.0 + 0.003).alias("lon"), ((F.hash(F.col("id") + 2) % 8900) / 100.0 + 0.002).alias("lat"))
    rows = lambda most: sorted(map(tuple, S.nearest_centres(p, "id", "lon", "lat", c, "nm", "x", "y", most).collect()))
    assert rows(10_000) == rows(500_000) and len(rows(500_000)) == p.where("lon between -180 and 180").count()
    ring = F.array(*[F.struct((F.col("x") + dx).alias("lon"), (F.col("y") + dy).alias("lat")) for dx, dy in ((0, 0), (0.3, 0), (0.3, 0.3), (0, 0.3))])
    r = c.limit(50_000).where("x < 179 and y < 89").select(F.expr("cast(substring(nm, 2) as int)").alias("rid"), ring.alias("ring"))
    cells = S.regions_of_points(p, "id", "lon", "lat", r, "rid", "ring", 1000)
    assert len(cells._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, S.regions_of_points(p, "id", "lon", "lat", r, "rid", "ring").collect()))


def test_bad_rings_are_reported(spark):
    ring = lambda *p: [{"lon": float(x), "lat": float(y)} for x, y in p]
    bow, square, big = ring((0, 0), (2, 2), (2, 0), (0, 2)), ring((5, 5), (6, 5), (6, 6), (5, 6)), ring((10, 10), (20, 10), (20, 20), (10, 20))
    rows = [(1, bow, None), (2, square, []), (3, big, [ring((12, 12), (14, 12), (14, 14), (12, 14)), ring((15, 15), (16, 15), (15.5, 18))]), (4, big, [ring((30, 30), (31, 30), (31, 31))]), (5, ring((0, 0), (1, 1), (2, 2)), None)]
    r = spark.createDataFrame(rows, "rid int, ring array<struct<lon double, lat double>>, holes array<array<struct<lon double, lat double>>>")
    assert {x.rid for x in S.ring_problems(r, "rid", "ring", "holes").collect()} == {1, 4}
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.5, 5.5), (3, 11.0, 11.0), (4, 13.0, 13.0), (5, 12.0, 13.0), (6, 15.5, 16.0), (7, 19.0, 19.0)], "id int, lon double, lat double")
    got = {x.id: x.rid for x in S.regions_of_points(p, "id", "lon", "lat", r, "rid", "ring", holes="holes", bad="skip").collect()}
    assert got == {2: 2, 3: 3, 5: 3, 7: 3}
    with pytest.raises(Exception, match="crosses itself|not inside"):
        S.regions_of_points(p, "id", "lon", "lat", r, "rid", "ring", holes="holes").collect()


@pytest.mark.parametrize("seed", range(12))
def test_random_polygons_with_holes(seed):
    """Star-shaped rings of many corners with star-shaped holes: areas agree, and so does containment with crossing counts."""
    rnd = random.Random(seed)
    star = lambda x, y, r, n: [(x + r * q * math.cos(a), y + r * q * math.sin(a)) for a, q in ((2 * math.pi * (k + rnd.random() * 0.8) / n, rnd.uniform(0.6, 1)) for k in range(n))]
    outer, holes = star(0, 0, 10, rnd.choice([8, 60, 400])), [star(x, y, 1.2, rnd.choice([3, 7, 40])) for x, y in rnd.sample([(-3, 0), (3, 0), (0, 3), (0, -3), (0, 0)], rnd.randint(0, 4))]
    tri = S.ear_clip(outer, holes)
    size = lambda ring: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])))
    assert sum(S._cross(*t) for t in tri) == pytest.approx(size(outer) - sum(map(size, holes)))
    for _ in range(200):
        p = rnd.uniform(-10, 10), rnd.uniform(-10, 10)
        want = S._inside(p, outer) and not any(S._inside(p, h) for h in holes)
        assert any(all(S._cross(u, v, p) >= 0 for u, v in zip(t, t[1:] + t[:1])) for t in tri) == want


def test_land_water_regions(spark):
    at = lambda *p: [{"lon": float(x), "lat": float(y)} for x, y in p]
    land = spark.createDataFrame([(at((0, 0), (10, 0), (10, 10), (0, 10)), [at((1, 1), (2, 1), (2, 2), (1, 2))])], "ring array<struct<lon double, lat double>>, holes array<array<struct<lon double, lat double>>>")
    lakes = spark.createDataFrame([(at((4, 4), (6, 4), (6, 6), (4, 6)),)], "ring array<struct<lon double, lat double>>")
    df = spark.createDataFrame([(0, "5", "5"), (1, "3", "3"), (2, "20", "20"), (3, None, "1"), (4, "x", "1"), (5, "1.5", "1.5"), (6, "3", "3"), (7, "500", "3")], "n int, lon string, lat string")
    got = {r.n: r.on_water for r in C.check_coords(df, "lat", "lon", ["on_water"], land=land, lakes=lakes).collect()}
    assert got == {0: "Inland water", 1: "Land", 2: "Ocean", 3: None, 4: None, 5: "Ocean", 6: "Land", 7: None}
    # rings of many corners take the same way
    coast = [[(10 * math.cos(2 * math.pi * k / 3000), 10 * math.sin(2 * math.pi * k / 3000)) for k in range(3000)]]
    flags = C.check_coords(df, "lat", "lon", ["on_water"], land=coast, lakes=[[(4, 4), (6, 4), (6, 6), (4, 6)]])
    assert len(flags._jdf.queryExecution().optimizedPlan().toString()) < 50_000
    assert {r.n: r.on_water for r in flags.collect()} == {0: "Inland water", 1: "Land", 2: "Ocean", 3: None, 4: None, 5: "Land", 6: "Land", 7: None}


def test_ear_clip():
    area = lambda t: abs((t[1][0] - t[0][0]) * (t[2][1] - t[0][1]) - (t[2][0] - t[0][0]) * (t[1][1] - t[0][1])) / 2
    star = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    ring = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(star, star[1:] + star[:1])) / 2
    assert sum(map(area, S.ear_clip(star))) == pytest.approx(ring)
    assert sum(map(area, S.ear_clip(star[::-1] + [star[-1]]))) == pytest.approx(ring)
    assert S.ear_clip([(0, 0), (1, 1)]) == [] and S.ear_clip([(0, 0), (1, 1), (2, 2)]) == [] and S.ear_clip([]) == []


@pytest.mark.parametrize("limit", [200_000, 3])
def test_regions(spark, limit):
    """Two squares that share a border, a concave region, and a null ring; border points go to the smaller id."""
    ring = lambda *p: [{"lon": float(x), "lat": float(y)} for x, y in p]
    regions = [(2, ring((0, 0), (1, 0), (1, 1), (0, 1))), (1, ring((1, 0), (2, 0), (2, 1), (1, 1))), (3, ring((5, 5), (9, 5), (9, 9), (7, 6), (5, 9))), (4, None), (5, ring((0, 0), (1, 1)))]
    r = spark.createDataFrame(regions, "rid int, ring array<struct<lon double, lat double>>")
    points = [(1, 0.5, 0.5), (2, 1.0, 0.5), (3, 1.5, 0.5), (4, 7.0, 8.0), (5, 7.0, 5.5), (6, 3.0, 3.0), (7, None, 1.0), (1, 0.5, 0.5)]
    p = spark.createDataFrame(points, "id long, lon double, lat double")
    got = {x.id: x.rid for x in S.regions_of_points(p, "id", "lon", "lat", r, "rid", "ring", limit).collect()}
    assert got == {1: 2, 2: 1, 3: 1, 5: 3}
