"""Queries of the preparation and validation operators, each over whole tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilark.functions.dates import epi_week, format_date_ord, iso_prefix_date, iso_year, leap_issue
from vigilark.functions.fmt import big_mark, compression_columns, decimal_places, detection_text
from vigilark.functions.geo import distance_m
from vigilark.operators import coords, dates, names, validation
from vigilark.operators.detections import new_detections
from vigilark.operators.merge import append_log, append_since, drop_empty_columns, first_per_group, load_log, merge_latest, union_tagged
from vigilark.operators.raster import age_band_sum, download_plan, download_summary
from vigilark.operators.snapshot_diff import deliveries
from vigilark.operators.spatial import regions_of_points
from vigilark.plans.joins import latest_before, range_join
from vigilark.session import scratch_path, table
from vigilark.sources.filters import comparison_filter, logical_filter, odata_filter
from vigilark.sources import files
from vigilark.sources.snapshots import read_snapshots, retained, save_snapshot
from vigilark.streaming.merge import BucketedTable, VersionedTable, dedup_pages, gap_sessions, merge_stream, windowed_counts

AS_OF = date(2025, 6, 30)
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ missing values

_CASE_COLS = (
    "CaseId", "VersionNo", "EPID", "WHORegion", "Admin0Name", "Admin1Name", "Admin2Name", "Admin0GUID", "Admin1GUID", "Admin2GUID", "Latitude", "Longitude", "CaseDate",
    "NotificationDate", "InvestigationDate", "Stool1CollectionDate", "Stool2CollectionDate", "LastUpdateDate", "ReceivedAt",
)
_KEYS = ("EPID", "Admin0Name")


def _missing_sql(group: str = "") -> str:
    g = f"{group}, " if group else ""
    by = f" GROUP BY {group}" if group else ""
    cols = [c for c in _CASE_COLS if c != group]
    parts = [
        f"SELECT {g}'{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing_count, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 2) AS missing_percent, "
        f"'{'High' if c in _KEYS else 'Standard'}' AS priority, count(*) FILTER ({c} IS NULL) = count(*) AS completely_null FROM polis_cases{by}"
        for c in cols
    ]
    return " UNION ALL ".join(parts)


@query(_missing_sql())
def check_missing(spark: SparkSession, d: str) -> DataFrame:
    return validation.check_missing(table(spark, d, "polis_cases"), key_columns=_KEYS)


@query(_missing_sql("WHORegion"))
def check_missing_grouped(spark: SparkSession, d: str) -> DataFrame:
    return validation.check_missing(table(spark, d, "polis_cases"), key_columns=_KEYS, group_by=["WHORegion"])


@query("SELECT CaseId FROM polis_cases WHERE Latitude IS NULL")
def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    return validation.missing_ids(table(spark, d, "polis_cases"), "CaseId", "Latitude")


# ------------------------------------------------------------------ dates

_DIRTY = """CASE CaseId % 9 WHEN 0 THEN NULL WHEN 1 THEN {dmy} WHEN 2 THEN '2019-02-29' WHEN 3 THEN 'not a date' WHEN 4 THEN '1999-12-31'
  WHEN 5 THEN '2031-01-15' WHEN 6 THEN '2021-13-45' ELSE {iso} END"""
_DIRTY_SPARK = _DIRTY.format(dmy="date_format(CaseDate, 'dd-MM-yyyy')", iso="date_format(CaseDate, 'yyyy-MM-dd')")
_DIRTY_SQL = _DIRTY.format(dmy="strftime(CaseDate, '%d-%m-%Y')", iso="strftime(CaseDate, '%Y-%m-%d')")
_CLEAN_SQL = _DIRTY.format(dmy="strftime(CaseDate, '%Y-%m-%d')", iso="strftime(CaseDate, '%Y-%m-%d')")


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "polis_cases").select("CaseId", "VersionNo", "ReceivedAt", F.expr(_DIRTY_SPARK).alias("day"))


@query(f"""WITH t AS (SELECT CaseId, VersionNo, {_CLEAN_SQL} AS day FROM polis_cases), u AS (SELECT *, try_cast(day AS DATE) AS x FROM t)
SELECT CaseId, VersionNo, day, day IS NULL AS day_missing, x IS NULL AND day IS NOT NULL AS day_non_date, NOT starts_with(day, '20') AS day_invalid,
  year(x) > 2025 AS day_future, coalesce(day = '2019-02-29', false) AS day_leap_issue, x IS NULL AND day IS NOT NULL AND day <> '2019-02-29' IS TRUE AS day_format_issue FROM u""".replace("day IS NOT NULL AND day <> '2019-02-29' IS TRUE", "day IS NOT NULL AND coalesce(day <> '2019-02-29', false)"))
def validate_date(spark: SparkSession, d: str) -> DataFrame:
    return dates.validate_date(_dirty(spark, d).drop("ReceivedAt"), "day", as_of=AS_OF)


_MIXED = """CASE CaseId % {n} WHEN 0 THEN NULL WHEN 1 THEN '2019-02-29' WHEN 2 THEN 'not a date' WHEN 3 THEN '1999-12-31' WHEN 4 THEN '2031-01-15' WHEN 5 THEN '2021-13-45' ELSE {iso} END"""
_MIXED_SPARK = [_MIXED.format(n=n, iso=f"date_format({c}, 'yyyy-MM-dd')") for n, c in ((9, "NotificationDate"), (11, "InvestigationDate"))]
_MIXED_SQL = [_MIXED.format(n=n, iso=f"strftime({c}, '%Y-%m-%d')") for n, c in ((9, "NotificationDate"), (11, "InvestigationDate"))]


@query(f"""WITH t AS (SELECT CaseId, VersionNo, {_MIXED_SQL[0]} AS a, {_MIXED_SQL[1]} AS b FROM polis_cases), u AS (SELECT *, try_cast(a AS DATE) AS x, try_cast(b AS DATE) AS y FROM t)
SELECT CaseId, VersionNo, a, b, a IS NULL AS a_missing, b IS NULL AS b_missing, x IS NULL AND a IS NOT NULL AS a_non_date, y IS NULL AND b IS NOT NULL AS b_non_date,
  NOT year(x) BETWEEN 2000 AND 2025 AS a_invalid, NOT year(y) BETWEEN 2000 AND 2025 AS b_invalid, year(x) > 2025 AS a_future, year(y) > 2025 AS b_future,
  coalesce(a = '2019-02-29', false) AS a_leap_issue, coalesce(b = '2019-02-29', false) AS b_leap_issue, x IS NULL AND a IS NOT NULL AS a_format_issue, y IS NULL AND b IS NOT NULL AS b_format_issue,
  x = y AS a_same, x > y AS a_invalid_order FROM u""")
def validate_dates(spark: SparkSession, d: str) -> DataFrame:
    """All seven tests on two columns of text."""
    t = table(spark, d, "polis_cases").select("CaseId", "VersionNo", F.expr(_MIXED_SPARK[0]).alias("a"), F.expr(_MIXED_SPARK[1]).alias("b"))
    return dates.validate_dates(t, "a", "b", as_of=AS_OF)


@query(f"""WITH t AS (SELECT CaseId, VersionNo, {_DIRTY_SQL} AS day FROM polis_cases) SELECT CaseId, VersionNo, coalesce(day = '2019-02-29', false) AS leap FROM t""")
def leap_dates(spark: SparkSession, d: str) -> DataFrame:
    return _dirty(spark, d).select("CaseId", "VersionNo", leap_issue(F.col("day")).alias("leap"))


@query(f"""WITH t AS (SELECT CaseId, VersionNo, {_CLEAN_SQL} AS day FROM polis_cases) SELECT CaseId, VersionNo, try_cast(day AS DATE) AS day FROM t""")
def autoparse_dates(spark: SparkSession, d: str) -> DataFrame:
    return dates.autoparse_dates(_dirty(spark, d).drop("ReceivedAt"), ["day"])


@query(f"""WITH t AS (SELECT CaseId, VersionNo, {_DIRTY_SQL} AS day FROM polis_cases)
SELECT CaseId, VersionNo, CAST(CASE WHEN regexp_matches(day, '^\\d{{4}}-') THEN try_cast(day AS DATE)
  WHEN regexp_matches(day, '^\\d{{2}}-') THEN make_date(CAST(day[1:2] AS INT), CAST(day[4:5] AS INT), CAST(day[7:8] AS INT)) END AS VARCHAR) AS day FROM t""")
def iso_prefix(spark: SparkSession, d: str) -> DataFrame:
    """All rows; a text such as 12-03-2021 is read as the 20th of March of the year 12, as the rule has it. As text: dates so early don't fit all
    clients."""
    return _dirty(spark, d).select("CaseId", "VersionNo", iso_prefix_date(F.col("day")).cast("string").alias("day"))


_FORMATS = """CASE WHEN o_orderkey % 10 < 6 THEN {dmy} WHEN o_orderkey % 10 < 8 THEN {ymd} WHEN o_orderkey % 10 = 8 THEN {mdy} ELSE 'n/a' END"""
_FORMATS_SQL = _FORMATS.format(dmy="strftime(o_orderdate, '%d/%m/%Y')", ymd="strftime(o_orderdate, '%Y-%m-%d')", mdy="strftime(o_orderdate, '%m/%d/%Y')")
_FORMATS_SPARK = _FORMATS.format(dmy="date_format(o_orderdate, 'dd/MM/yyyy')", ymd="date_format(o_orderdate, 'yyyy-MM-dd')", mdy="date_format(o_orderdate, 'MM/dd/yyyy')")


@query(f"""WITH t AS (SELECT {_FORMATS_SQL} AS t FROM orders), n AS ({" UNION ALL ".join(f"SELECT '{f}' AS format, count(try_strptime(t, '{f}')) AS parsed FROM t" for f in ("%d/%m/%Y", "%m/%d/%Y", "%Y-%m-%d"))})
SELECT arg_max(format, parsed) AS format, max(parsed) AS parsed FROM n""")
def detect_date_format(spark: SparkSession, d: str) -> DataFrame:
    """Texts in three formats and some that are no dates: the one that reads the most."""
    return dates.detect_date_format(table(spark, d, "orders").select(F.expr(_FORMATS_SPARK).alias("t")), "t")


@query("""SELECT o_orderkey, CASE WHEN month(o_orderdate) <= 6 THEN 'Jan ' ELSE 'Jul ' END || (year(o_orderdate) % 100) || CASE WHEN month(o_orderdate) <= 6 THEN ' / Jun ' ELSE ' / Dec ' END
  || (year(o_orderdate) % 100) AS custom_biannual, make_date(year(o_orderdate), CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 7 END, 1) AS custom_biannual_ord FROM orders""")
def categorize_biannual(spark: SparkSession, d: str) -> DataFrame:
    return dates.categorize_biannual(table(spark, d, "orders"), "o_orderdate").select("o_orderkey", "custom_biannual", "custom_biannual_ord")


@query("""WITH s AS (SELECT CAST(range AS DATE) AS a FROM range(DATE '1995-01-01', DATE '2002-01-01', INTERVAL 6 MONTH))
SELECT s.a AS half_start, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN s ON o_orderdate >= s.a AND o_orderdate < s.a + INTERVAL 6 MONTH GROUP BY s.a""")
def biannual_range_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders and half-years by the general join of points and intervals."""
    halves = spark.sql("select explode(sequence(date'1995-01-01', date'2001-07-01', interval 6 months)) a").select("a", F.add_months("a", 6).alias("b"))
    orders = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    t = range_join(orders, halves, "day", "a", "b", 183)
    return t.groupBy(F.col("a").alias("half_start")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT c.country, count(*) FILTER (ok) AS downloaded, count(*) FILTER (NOT ok) AS failed, bool_and(ok) AS complete
FROM (SELECT s_nationkey AS country, s_suppkey % 5 AS year, bool_or(s_acctbal > 0) AS ok FROM supplier GROUP BY ALL) c GROUP BY c.country""")
def download_summaries(spark: SparkSession, d: str) -> DataFrame:
    return download_summary(table(spark, d, "supplier").select(F.col("s_nationkey").alias("country"), (F.col("s_suppkey") % 5).alias("year"), (F.col("s_acctbal") > 0).alias("success")))


@query()
def assign_round_number(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "polis_cases").select("CaseId", "VersionNo", "WHORegion", "CaseDate").withColumn("WHORegion", F.upper(F.trim("WHORegion")))
    return dates.assign_round_number(t, "CaseDate", ["WHORegion"], 7)


@query("""SELECT o_orderkey, CASE WHEN day(o_orderdate) BETWEEN 11 AND 13 THEN day(o_orderdate) || 'th' WHEN day(o_orderdate) % 10 = 1 THEN day(o_orderdate) || 'st'
  WHEN day(o_orderdate) % 10 = 2 THEN day(o_orderdate) || 'nd' WHEN day(o_orderdate) % 10 = 3 THEN day(o_orderdate) || 'rd' ELSE day(o_orderdate) || 'th' END
  || strftime(o_orderdate, ' %b %Y') AS label, weekofyear(o_orderdate) AS iso_week, isoyear(o_orderdate) AS iso_year FROM orders""")
def format_dates(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders")
    return t.select("o_orderkey", format_date_ord(F.col("o_orderdate")).alias("label"), F.weekofyear("o_orderdate").alias("iso_week"), iso_year(F.col("o_orderdate")).alias("iso_year"))


@query("""WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST(3 - dayofweek(o_orderdate) AS INT) AS w FROM orders) SELECT o_orderkey, CAST(floor((dayofyear(w) - 1) / 7) + 1 AS INT) AS epi_week FROM t""")
def epi_weeks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", epi_week(F.col("o_orderdate").cast("date")).alias("epi_week"))


# ------------------------------------------------------------------ coordinates

_CENTRES = """centres AS (SELECT g, a.la AS clat, a.lo AS clon FROM (SELECT replace(replace(lower(trim(ADM2_GUID)), '{', ''), '}', '') AS g, min(struct_pack(la := CENTER_LAT, lo := CENTER_LON)) AS a
  FROM shp_global WHERE ADM2_GUID IS NOT NULL GROUP BY 1)),
pts AS (SELECT CaseId, VersionNo, ReceivedAt, replace(replace(lower(trim(Admin2GUID)), '{', ''), '}', '') AS g, CASE WHEN CaseId % 11 = 0 THEN Longitude ELSE Latitude END AS lat,
  CASE WHEN CaseId % 11 = 0 THEN Latitude ELSE Longitude END AS lon FROM polis_cases),
j AS (SELECT pts.*, clat, clon FROM pts LEFT JOIN centres ON pts.g = centres.g),
m AS (SELECT *, {here} AS here, {swapped} AS swapped FROM j),
f AS (SELECT *, CASE WHEN abs(swapped - here) < 1e-6 THEN false WHEN abs(lat - lon) > 0.5 AND abs(clat - clon) > 0.5 AND swapped < 0.9 * here THEN true ELSE false END AS flag,
  100 * (here - swapped) / nullif(here, 0) * (1 + log10(abs(lat - lon) + 1)) * (1 + log10(abs(clat - clon) + 1)) AS sc FROM m)"""


def _hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return (
        f"CASE WHEN abs({lat1}) <= 90 AND abs({lat2}) <= 90 AND abs({lon1}) <= 180 AND abs({lon2}) <= 180 THEN 2 * 6378137.0 * asin(least(1.0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))) END"
    )


_FLIP_SQL = _CENTRES.replace("{here}", _hav("lon", "lat", "clon", "clat")).replace("{swapped}", _hav("lat", "lon", "clon", "clat"))
_DIM = ("Admin2GUID", "ADM2_GUID", "lat", "lon", "CENTER_LAT", "CENTER_LON")


def _points(spark: SparkSession, d: str) -> DataFrame:
    swap = F.col("CaseId") % 11 == 0
    t = table(spark, d, "polis_cases")
    return t.select("CaseId", "VersionNo", "ReceivedAt", "WHORegion", "Admin2GUID", F.when(swap, F.col("Longitude")).otherwise(F.col("Latitude")).alias("lat"), F.when(swap, F.col("Latitude")).otherwise(F.col("Longitude")).alias("lon"))


@query(f"WITH {_FLIP_SQL} SELECT CaseId, VersionNo, ReceivedAt, round(here, 3) AS metres FROM f")
def centre_distance(spark: SparkSession, d: str) -> DataFrame:
    t = coords.with_centre(_points(spark, d), table(spark, d, "shp_global"), *_DIM)
    return t.select("CaseId", "VersionNo", "ReceivedAt", F.round(distance_m(F.col("lon"), F.col("lat"), F.col("CENTER_LON"), F.col("CENTER_LAT")), 3).alias("metres"))


@query(f"WITH {_FLIP_SQL} SELECT CaseId, VersionNo, ReceivedAt, flag AS potentially_flipped, round(CASE WHEN sc IS NOT NULL THEN least(100, greatest(0, sc)) END, 3) AS score FROM f")
def coord_flip(spark: SparkSession, d: str) -> DataFrame:
    t = coords.check_coord_flip(_points(spark, d), table(spark, d, "shp_global"), *_DIM)
    return t.select("CaseId", "VersionNo", "ReceivedAt", "potentially_flipped", F.round("flipped_confidence_score", 3).alias("score"))


@query(f"WITH {_FLIP_SQL} SELECT CaseId, VersionNo, ReceivedAt, CASE WHEN flag THEN lon ELSE lat END AS lat, CASE WHEN flag THEN lat ELSE lon END AS lon FROM f")
def correct_flip(spark: SparkSession, d: str) -> DataFrame:
    return coords.correct_flipped(_points(spark, d), table(spark, d, "shp_global"), *_DIM).select("CaseId", "VersionNo", "ReceivedAt", "lat", "lon")


LAND = [[(-180.0, -60.0), (180.0, -60.0), (180.0, 60.0), (-180.0, 60.0)]]
LAKES = [[(0.0, 0.0), (40.0, 0.0), (40.0, 20.0), (0.0, 20.0)]]
_WATER_SQL = """CASE WHEN longitude IS NULL OR latitude IS NULL THEN NULL WHEN latitude >= -60 AND latitude < 60 AND longitude >= -180 AND longitude < 180 THEN
  CASE WHEN latitude >= 0 AND latitude < 20 AND longitude >= 0 AND longitude < 40 THEN 'Inland water' ELSE 'Land' END ELSE 'Ocean' END"""


@query(f"SELECT _id, date_last_updated, {_WATER_SQL} AS place FROM ona_visits")
def land_water(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "ona_visits")
    return t.select("_id", "date_last_updated", coords.land_water(F.col("longitude"), F.col("latitude"), LAND, LAKES).alias("place"))


@query("""SELECT _id, date_last_updated, CASE WHEN latitude IS NULL OR longitude IS NULL OR NOT (latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180) THEN NULL
  WHEN NOT (latitude BETWEEN -60 AND 60 AND longitude BETWEEN -170 AND 170) OR (latitude > 25 AND latitude < 30 AND longitude > 10 AND longitude < 20) THEN 'Ocean'
  WHEN latitude BETWEEN 0 AND 20 AND longitude BETWEEN 0 AND 40 THEN 'Inland water' ELSE 'Land' END AS on_water FROM ona_visits""")
def land_water_regions(spark: SparkSession, d: str) -> DataFrame:
    """Land and lakes as tables of regions, the land with a hole; borders belong to the region."""
    ring = lambda x0, y0, x1, y1: [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    kind = "ring array<struct<lon double, lat double>>, holes array<array<struct<lon double, lat double>>>"
    land = spark.createDataFrame([(ring(-170, -60, 170, 60), [ring(10, 25, 20, 30)])], kind)
    lakes = spark.createDataFrame([(ring(0, 0, 40, 20), None)], kind)
    t = table(spark, d, "ona_visits").select("_id", "date_last_updated", "longitude", "latitude")
    return coords.with_land_water(t, "longitude", "latitude", land, lakes).select("_id", "date_last_updated", "on_water")


def _places(x: str) -> str:
    """Places after the point of a number written with up to 15 digits."""
    return f"length(regexp_replace(printf('%.15g', {x}), '^-?\\d+\\.', ''))"


_CHECK_SQL = f"""c AS (SELECT *, latitude IS NULL OR longitude IS NULL AS mis, coalesce(abs(latitude) > 90 OR abs(longitude) > 180, false) AS oob FROM ona_visits),
k AS (SELECT form_id_num, _id, date_last_updated, mis AS missing_coords, false AS parse_failed, oob AS out_of_bounds, coalesce(latitude = 0 AND longitude = 0, false) AS null_count,
  {_places("latitude")} AS lat_precision, {_places("longitude")} AS lon_precision, coalesce(NOT mis AND ({_places("latitude")} < 4 OR {_places("longitude")} < 4), false) AS low_precision,
  CASE WHEN NOT oob THEN {_WATER_SQL} END AS on_water FROM c)"""
_CHECKED = ("missing_coords", "parse_failed", "out_of_bounds", "lat_precision", "lon_precision", "low_precision", "null_count", "on_water")


def _checked(spark: SparkSession, d: str) -> DataFrame:
    """All checks; submissions have no unit, so flip has nothing to compare with."""
    return coords.check_coords(table(spark, d, "ona_visits"), "latitude", "longitude", land=LAND, lakes=LAKES)


@query(f"WITH {_CHECK_SQL} SELECT _id, date_last_updated, {', '.join(_CHECKED)} FROM k")
def check_coords(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).select("_id", "date_last_updated", *_CHECKED)


@query(f"""WITH {_CHECK_SQL} SELECT form_id_num, count(*) AS total_coords, count(*) FILTER (missing_coords) AS missing_coords, count(*) FILTER (parse_failed) AS parse_failed, count(*) FILTER (out_of_bounds) AS out_of_bounds,
  count(*) FILTER (low_precision) AS low_precision, count(*) FILTER (null_count) AS null_count, count(*) FILTER (on_water IN ('Ocean', 'Inland water')) AS on_water FROM k GROUP BY form_id_num""")
def check_coords_summary(spark: SparkSession, d: str) -> DataFrame:
    return coords.summarise_coords(_checked(spark, d), ["form_id_num"], headings=False, as_text=False)


@query("""SELECT o_orderkey, CASE WHEN o_totalprice = floor(o_totalprice) THEN length(CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR)) ELSE length(split_part(CAST(o_totalprice AS VARCHAR), '.', 2)) END AS places FROM orders""")
def number_precision(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", decimal_places(F.col("o_totalprice")).alias("places"))


@query("""WITH c AS (SELECT DISTINCT ADM2_NAME, CENTER_LON, CENTER_LAT FROM shp_global WHERE ENDDATE > TIMESTAMP '9900-12-31' AND CENTER_LON IS NOT NULL AND CENTER_LAT IS NOT NULL),
p AS (SELECT DISTINCT CaseId, VersionNo, Longitude AS x, Latitude AS y FROM polis_cases WHERE Longitude BETWEEN -180 AND 180 AND Latitude BETWEEN -90 AND 90)
SELECT CaseId, VersionNo, arg_min(ADM2_NAME, struct_pack(k := round(km, 9), n := ADM2_NAME)) AS adm, round(min(km), 3) AS km FROM (SELECT p.*, ADM2_NAME, 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(CENTER_LAT - y) / 2), 2)
  + cos(radians(y)) * cos(radians(CENTER_LAT)) * pow(sin(radians(CENTER_LON - x) / 2), 2)))) AS km FROM p, c) GROUP BY CaseId, VersionNo""")
def nearest_coord(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "polis_cases").select(F.struct("CaseId", "VersionNo").alias("k"), "Longitude", "Latitude").distinct()
    n = coords.find_nearest(p, "k", "Longitude", "Latitude", table(spark, d, "shp_global"))
    return n.select("k.CaseId", "k.VersionNo", "adm", F.round("km", 3).alias("km"))


@query("""WITH s AS (SELECT range AS i FROM range(0, 36)), r AS (SELECT i, -180 + 10 * i AS x FROM s)
SELECT _id, min(i) AS region_no FROM ona_visits JOIN r ON longitude BETWEEN x AND x + 10 WHERE latitude BETWEEN -60 AND 60 AND longitude BETWEEN -180 AND 180 GROUP BY _id""")
def regions_containing(spark: SparkSession, d: str) -> DataFrame:
    """Bands of ten degrees as regions; a point on a shared border belongs to the smaller number."""
    r = spark.range(36).select(F.col("id").alias("region_no"), (F.col("id") * 10.0 - 180).alias("x"))
    at = lambda x, y: F.struct(x.cast("double").alias("lon"), F.lit(float(y)).alias("lat"))
    r = r.withColumn("ring", F.array(at(F.col("x"), -60), at(F.col("x") + 10, -60), at(F.col("x") + 10, 60), at(F.col("x"), 60)))
    return regions_of_points(table(spark, d, "ona_visits"), "_id", "longitude", "latitude", r, "region_no", "ring")


# ------------------------------------------------------------------ names


@query("SELECT n_nationkey AS NationKey, n_name AS NationName, n_regionkey AS n_regionkey FROM nation")
def match_names(spark: SparkSession, d: str) -> DataFrame:
    ref = spark.createDataFrame([], "NationKey int, NationName string")
    target = table(spark, d, "nation").toDF("NATION_KEY", "nation name", "n_regionkey")
    return names.match_names(ref, target)[0]


@query("""SELECT CAST(trunc(try_cast(a AS DOUBLE)) AS INT) AS a, CASE WHEN b IN ('T', 'TRUE', 'true', 'True') THEN true WHEN b IN ('F', 'FALSE', 'false', 'False') THEN false END AS b, try_cast(c AS DOUBLE) AS c,
  try_cast(dt AS DATE) AS dt, k FROM (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE p_size || '.7' END AS a, CASE p_partkey % 4 WHEN 0 THEN 'T' WHEN 1 THEN 'false' WHEN 2 THEN 'yes' END AS b,
  CASE WHEN p_partkey % 3 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) || '.25' END AS c, CASE WHEN p_partkey % 2 = 0 THEN '2024-02-29' ELSE '2023-02-29' END AS dt FROM part)""")
def match_datatypes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").selectExpr(
        "p_partkey AS k", "CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE p_size || '.7' END AS a", "CASE p_partkey % 4 WHEN 0 THEN 'T' WHEN 1 THEN 'false' WHEN 2 THEN 'yes' END AS b",
        "CASE WHEN p_partkey % 3 = 0 THEN 'n/a' ELSE p_size || '.25' END AS c", "CASE WHEN p_partkey % 2 = 0 THEN '2024-02-29' ELSE '2023-02-29' END AS dt",
    )
    return names.match_datatypes(spark.createDataFrame([], "a int, b boolean, c double, dt date"), t)


_LEVELS = ("Admin0Name", "Admin1Name", "Admin2Name")


def _lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "shp_global").where(F.year("ENDDATE") == 9999).select(*[F.col(f"ADM{i}_NAME").alias(c) for i, c in enumerate(_LEVELS)]).distinct()


_LOOKUP_SQL = "lk AS (SELECT DISTINCT ADM0_NAME AS Admin0Name, ADM1_NAME AS Admin1Name, ADM2_NAME AS Admin2Name FROM shp_global WHERE year(ENDDATE) = 9999)"


@query("SELECT CaseId, VersionNo, ReceivedAt, concat_ws('_', Admin0Name, Admin1Name, Admin2Name) AS long_geo FROM polis_cases")
def geo_long_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "polis_cases").select("CaseId", "VersionNo", "ReceivedAt", names.long_name(*_LEVELS).alias("long_geo"))


@query("WITH " + _LOOKUP_SQL + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS level, count(*) FILTER (EXISTS (SELECT 1 FROM lk WHERE lk.{c} IS NOT DISTINCT FROM t.v)) AS matched, count(*) AS total FROM (SELECT DISTINCT {c} AS v FROM polis_cases) t" for c in _LEVELS))
def match_stats(spark: SparkSession, d: str) -> DataFrame:
    return names.match_stats(table(spark, d, "polis_cases"), _lookup(spark, d), _LEVELS)


def _suggest(spark: SparkSession, d: str, method: str) -> DataFrame:
    """The three nearest names of the dimension for every typed name of every level under its parents, texts in upper case but else as typed."""
    t, ref = table(spark, d, "geoname_todo"), names.upper_levels(_lookup(spark, d), _LEVELS)
    out = None
    for i, c in enumerate(_LEVELS):
        up = list(_LEVELS[:i])
        at = t.where(F.lower(F.trim("level")) == f"level{i}").select(*[F.upper(f"level{k}_name").alias(p) for k, p in enumerate(up)], F.upper("name_to_match").alias(c))
        r = names.rank_matches(at, ref, c, c, up, method, 3)
        parents = [F.col(p) if p in up else F.lit(None).cast("string").alias(p) for p in _LEVELS[:2]]
        r = r.select(F.lit(f"level{i}").alias("level"), *parents, "name_to_match", "matched_names", F.round("distance", 6).alias("distance"), "match_rank")
        out = r if out is None else out.unionByName(r)
    return out


def _suggest_sql(distance: str) -> str:
    """DuckDB's distances count bytes: xx and yy are the names with each letter outside ASCII written as one unused ASCII character; x and y as typed."""
    return f"""WITH {_LOOKUP_SQL},
t AS (SELECT lower(trim(level)) AS level, upper(level0_name) AS p0, upper(level1_name) AS p1, upper(name_to_match) AS x FROM geoname_todo WHERE name_to_match IS NOT NULL),
a AS (SELECT DISTINCT level, CASE WHEN level <> 'level0' THEN p0 END AS p0, CASE WHEN level = 'level2' THEN p1 END AS p1, x FROM t),
b AS (SELECT DISTINCT 'level0' AS level, NULL AS p0, NULL AS p1, upper(Admin0Name) AS y FROM lk UNION SELECT 'level1', upper(Admin0Name), NULL, upper(Admin1Name) FROM lk UNION SELECT 'level2', upper(Admin0Name), upper(Admin1Name), upper(Admin2Name) FROM lk),
j AS (SELECT a.level, a.p0, a.p1, x, y FROM a JOIN b ON a.level = b.level AND y IS NOT NULL AND (a.level = 'level0' OR a.p0 = b.p0) AND (a.level <> 'level2' OR a.p1 = b.p1)),
odd AS (SELECT c, row_number() OVER (ORDER BY c) AS n FROM (SELECT DISTINCT unnest(string_split(x, '')) AS c FROM a UNION SELECT DISTINCT unnest(string_split(y, '')) FROM b) WHERE unicode(c) > 126),
m AS (SELECT coalesce(string_agg(c, '' ORDER BY n), '') AS f, coalesce(string_agg(chr(CAST(CASE WHEN n <= 26 THEN 96 + n ELSE n - 26 END AS INT)), '' ORDER BY n), '') AS g FROM odd),
k AS (SELECT j.*, translate(x, f, g) AS xx, translate(y, f, g) AS yy FROM j, m),
e AS (SELECT *, {distance} AS distance FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY level, p0, p1, x ORDER BY round(distance, 9), y) AS match_rank FROM e)
SELECT level, p0 AS Admin0Name, p1 AS Admin1Name, x AS name_to_match, y AS matched_names, round(distance, 6) AS distance, match_rank FROM r WHERE match_rank <= 3"""


_HEAD = "(CASE " + " ".join(f"WHEN least(length(xx), length(yy)) < {k} OR left(xx, {k}) <> left(yy, {k}) THEN {k - 1}" for k in (1, 2, 3, 4)) + " ELSE 4 END)"
_COUNT = "len(list_filter(string_split({}, ''), lambda q: q = c))"
_EACH = "list_transform(list_distinct(string_split(xx || yy, '')), lambda c: {})"
_X, _Y = _COUNT.format("xx"), _COUNT.format("yy")
_SUGGEST = {
    "lv": "CAST(levenshtein(xx, yy) AS DOUBLE)", "dl": "CAST(damerau_levenshtein(xx, yy) AS DOUBLE)", "jw": "1 - jaro_similarity(xx, yy)", "jaccard": "1 - jaccard(xx, yy)",
    "jaro_winkler": f"(1 - jaro_similarity(xx, yy)) * (1 - 0.1 * {_HEAD})", "hamming": "CASE WHEN length(xx) = length(yy) THEN CAST(hamming(xx, yy) AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END",
    "qgram": f"CAST(list_sum({_EACH.format(f'abs({_X} - {_Y})')}) AS DOUBLE)",
    "cosine": f"1 - list_sum({_EACH.format(f'{_X} * {_Y}')}) / sqrt(list_sum({_EACH.format(f'{_X} * {_X}')}) * list_sum({_EACH.format(f'{_Y} * {_Y}')}))",
    "osa": None, "lcs": None, "soundex": None,
}
for _m, _s in _SUGGEST.items():
    Q[f"suggest_{_m}"] = lambda spark, d, m=_m: _suggest(spark, d, m)
    if _s:
        SQL[f"suggest_{_m}"] = _suggest_sql(_s)


def _decision_sql(k: int) -> str:
    up = "".join(f", upper(level{i}_prepped) AS p{i}" for i in range(k))
    return f"""m{k} AS (SELECT upper(name_to_match) AS n{up}, arg_max(upper(replacement), row(coalesce(created_time, ''), upper(replacement))) AS r FROM geoname_cache
  WHERE lower(trim(level)) = 'level{k}' AND name_to_match IS NOT NULL AND replacement IS NOT NULL GROUP BY ALL)"""


@query(f"""WITH {_decision_sql(0)}, {_decision_sql(1)}, {_decision_sql(2)},
t AS (SELECT decision_id, lower(trim(level)) AS level, upper(CASE WHEN lower(trim(level)) = 'level0' THEN name_to_match ELSE level0_prepped END) AS a,
    upper(CASE WHEN lower(trim(level)) = 'level1' THEN name_to_match WHEN lower(trim(level)) = 'level2' THEN level1_prepped END) AS b, upper(CASE WHEN lower(trim(level)) = 'level2' THEN name_to_match END) AS c
  FROM geoname_cache WHERE lower(trim(level)) IN ('level0', 'level1', 'level2')),
t0 AS (SELECT t.* REPLACE (coalesce(m0.r, t.a) AS a) FROM t LEFT JOIN m0 ON t.a = m0.n),
t1 AS (SELECT t0.* REPLACE (coalesce(m1.r, t0.b) AS b) FROM t0 LEFT JOIN m1 ON t0.b = m1.n AND t0.a = m1.p0),
t2 AS (SELECT t1.* REPLACE (coalesce(m2.r, t1.c) AS c) FROM t1 LEFT JOIN m2 ON t1.c = m2.n AND t1.a = m2.p0 AND t1.b = m2.p1)
SELECT decision_id, level, a AS "Admin0Name", b AS "Admin1Name", c AS "Admin2Name" FROM t2""")
def apply_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The names of geoname_cache of levels 0 to 2 under the parents they were decided for, with all its decisions, level by level."""
    cache = table(spark, d, "geoname_cache")
    level = F.lower(F.trim("level"))
    at = [F.upper(F.when(level == f"level{i}", F.col("name_to_match")).when(level > f"level{i}", F.col(f"level{i}_prepped"))).alias(c) for i, c in enumerate(_LEVELS)]
    t = cache.where(level.isin("level0", "level1", "level2")).select("decision_id", level.alias("level"), *at)
    return names.apply_decisions(t, cache, _LEVELS)


@query("""WITH b AS (SELECT level, name_to_match, level0_prepped, level1_prepped, level2_prepped, level3_prepped, level4_prepped, created_time, replacement FROM geoname_cache),
r AS (SELECT *, row_number() OVER (PARTITION BY level, name_to_match, level0_prepped, level1_prepped, level2_prepped, level3_prepped, level4_prepped ORDER BY created_time DESC NULLS LAST, replacement NULLS FIRST) AS n FROM b)
SELECT level, name_to_match, level0_prepped, level1_prepped, level2_prepped, created_time, replacement FROM r WHERE n = 1""")
def merge_decisions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "geoname_cache")
    new = F.col("decision_id") % 2 == 0
    out = names.merge_decisions(t.where(~new), t.where(new))
    return out.select("level", "name_to_match", "level0_prepped", "level1_prepped", "level2_prepped", "created_time", "replacement")


@query(f"""WITH {_LOOKUP_SQL}, ref AS (SELECT DISTINCT upper(Admin0Name) AS a, upper(Admin1Name) AS b, upper(Admin2Name) AS c FROM lk),
t AS (SELECT DISTINCT upper(level0_name) AS a, upper(level1_name) AS b, upper(name_to_match) AS c FROM geoname_todo WHERE lower(trim(level)) = 'level2'),
u AS (SELECT * FROM t WHERE concat_ws('_', a, b, c) NOT IN (SELECT concat_ws('_', a, b, c) FROM ref)),
n AS (SELECT DISTINCT 'level0' AS level, NULL AS parent, a AS x FROM u WHERE a IS NOT NULL AND a NOT IN (SELECT a FROM ref)
  UNION SELECT DISTINCT 'level1', a, b FROM u WHERE b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ref WHERE ref.a = u.a AND ref.b = u.b)
  UNION SELECT DISTINCT 'level2', b, c FROM u WHERE c IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ref WHERE ref.b = u.b AND ref.c = u.c)),
k AS (SELECT DISTINCT 'level0' AS level, NULL AS parent, a AS y FROM ref UNION SELECT DISTINCT 'level1', a, b FROM ref UNION SELECT DISTINCT 'level2', b, c FROM ref),
odd AS (SELECT c, row_number() OVER (ORDER BY c) AS i FROM (SELECT DISTINCT unnest(string_split(x, '')) AS c FROM n) WHERE unicode(c) > 126),
m AS (SELECT coalesce(string_agg(c, '' ORDER BY i), '') AS f, coalesce(string_agg(chr(CAST(CASE WHEN i <= 26 THEN 96 + i ELSE i - 26 END AS INT)), '' ORDER BY i), '') AS g FROM odd),
e AS (SELECT n.level, n.parent, x, y, CAST(levenshtein(translate(x, f, g), translate(y, f, g)) AS DOUBLE) AS distance FROM n JOIN k ON n.level = k.level AND (n.level = 'level0' OR n.parent = k.parent) AND y IS NOT NULL, m),
r AS (SELECT *, row_number() OVER (PARTITION BY level, parent, x ORDER BY distance, y) AS match_rank FROM e)
SELECT level, parent, 'lv' AS algorithm_name, x AS name_to_match, y AS matched_names, distance, match_rank FROM r WHERE match_rank <= 3""")
def prep_geonames(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions for typed districts that the dimension does not have."""
    t = table(spark, d, "geoname_todo").where(F.lower(F.trim("level")) == "level2")
    t = t.select(F.col("level0_name").alias(_LEVELS[0]), F.col("level1_name").alias(_LEVELS[1]), F.col("name_to_match").alias(_LEVELS[2]))
    return names.prep_geonames(t, _lookup(spark, d), _LEVELS, method="lv", top=3)[1]


# ------------------------------------------------------------------ validation


@query("""SELECT 'Admin0Name ~ Admin1Name ~ Admin2Name' AS combination, count(*) AS total_rows, count(*) AS unique_rows, 0 AS non_unique, 100.0 AS proportion FROM (SELECT DISTINCT Admin0Name, Admin1Name, Admin2Name FROM polis_cases)
UNION ALL SELECT 'Admin0GUID ~ Admin1GUID ~ Admin2GUID', count(*), count(*), 0, 100.0 FROM (SELECT DISTINCT Admin0GUID, Admin1GUID, Admin2GUID FROM polis_cases)""")
def admin_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return validation.admin_hierarchy(table(spark, d, "polis_cases"), [_LEVELS, ("Admin0GUID", "Admin1GUID", "Admin2GUID")])


@query("""SELECT 'ADM0_NAME ~ ADM1_NAME ~ ADM2_NAME' AS combination, sum(p) AS total_rows, count(*) AS unique_rows, count(*) FILTER (p > 1) AS non_unique, round(100.0 * count(*) FILTER (p = 1) / count(*), 2) AS proportion
FROM (SELECT ADM2_NAME, count(*) AS p FROM (SELECT DISTINCT ADM0_NAME, ADM1_NAME, ADM2_NAME FROM shp_global WHERE ADM2_NAME IS NOT NULL) GROUP BY 1)""")
def admin_true_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return validation.admin_hierarchy(table(spark, d, "shp_global"), [("ADM0_NAME", "ADM1_NAME", "ADM2_NAME")], true_hierarchy=True)


@query("SELECT * FROM (SELECT OBJECTID, ADM0_NAME, ADM1_NAME, ADM2_NAME, count(*) OVER (PARTITION BY ADM0_NAME, ADM1_NAME, ADM2_NAME) AS n FROM shp_global) WHERE n > 1".replace("SELECT * FROM", "SELECT OBJECTID, ADM0_NAME, ADM1_NAME, ADM2_NAME FROM", 1))
def non_unique_ids(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "shp_global").select("OBJECTID", "ADM0_NAME", "ADM1_NAME", "ADM2_NAME")
    return validation.non_unique_rows(t, ["ADM0_NAME", "ADM1_NAME", "ADM2_NAME"])


_PLACES = {"Admin0Name": "ADM0_NAME", "Admin1Name": "ADM1_NAME", "Admin2Name": "ADM2_NAME", "Admin1GUID": "ADM1_GUID", "Admin2GUID": "ADM2_GUID"}
_MISMATCH = "d AS (SELECT DISTINCT EPID, Admin0Name, Admin1Name, Admin2Name, Admin1GUID, Admin2GUID FROM polis_cases), x AS (" + " UNION ALL ".join(
    f"SELECT EPID, '{a}' AS column_name, {a} AS value FROM d WHERE {a} IS NOT NULL AND {a} NOT IN (SELECT {b} FROM shp_global WHERE {b} IS NOT NULL)" for a, b in _PLACES.items()
) + ")"


@query(f"WITH {_MISMATCH} SELECT EPID, column_name, value FROM x")
def geo_mismatch_detail(spark: SparkSession, d: str) -> DataFrame:
    return validation.mismatches(table(spark, d, "polis_cases"), table(spark, d, "shp_global"), "EPID", _PLACES)[1]


@query(f"WITH {_MISMATCH} SELECT c.column_name, count(x.column_name) AS missing FROM (VALUES {', '.join(f"('{a}')" for a in _PLACES)}) c(column_name) LEFT JOIN x ON x.column_name = c.column_name GROUP BY c.column_name")
def geo_mismatch_summary(spark: SparkSession, d: str) -> DataFrame:
    return validation.mismatches(table(spark, d, "polis_cases"), table(spark, d, "shp_global"), "EPID", _PLACES)[0]


_SPEC = validation.preset("AFP")
_DATES = _SPEC.dates
_norm = {True: "replace(replace(lower({}), '{{', ''), '}}', '')", False: "{}"}


def _flags_sql() -> tuple[str, list[tuple[str, str, str, str, str]]]:
    """Flag expressions of the AFP check in SQL with their headers, labels and issue types."""
    out = []
    for a in _SPEC.places:
        out.append((f"{a} IS NULL", "Geographical Names & ID Missing", a, "Geo", f"{a} Missing Value"))
    for a, b in _SPEC.places.items():
        if a != "Admin0GUID":
            n = _norm["GUID" in b]
            out.append((f"{a} IS NOT NULL AND {n.format(a)} NOT IN (SELECT {n.format(b)} FROM shp_global WHERE {b} IS NOT NULL)", "Geographical Mismatches", f"{a} not in Shapefile", "Geo", f"{a} not in Shapefile"))
    for c in _DATES:
        h = f"Date Check: {c}"
        out += [
            (f"{c} IS NULL", h, "Date is Missing", "Date", f"{c} Missing Value"), ("false", h, "Non-date Value (Cannot be converted to date format)", "Date", f"{c} is not a date"),
            (f"coalesce(year({c}) NOT BETWEEN 2000 AND 2099, false)", h, "Invalid Date (Not starting with '20')", "Date", f"{c} Invalid Date (Not Starting With '20')"),
            (f"coalesce(year({c}) > 2025, false)", h, "Date into the future (beyond 2025)", "Date", f"{c} Future Dates (Beyond 2025)"),
            ("false", h, "Leap date (Feb 29th) appearing in Non-leap Year", "Date", f"{c} has leap issue"), ("false", h, "Date Format Issue (Not YYYY-MM-DD)", "Date", f"{c} has format issue"),
        ]
    for a, b in _SPEC.date_pairs:
        out.append((f"coalesce({a} > {b}, false)", f"Date Pair Check: {a} ~ {b}", "Invalid Date Order (First date is after second date)", "Date", f"{a} ~ {b} Invalid Date Order (First Date Is After Second Date)"))
    h = "Coordinate Checks"
    low = f"coalesce(({_places('Latitude')} < 4 OR {_places('Longitude')} < 4) AND Latitude IS NOT NULL AND Longitude IS NOT NULL, false)"
    flip = "coalesce(abs(swapped - here) >= 1e-6 AND abs(Latitude - Longitude) > 0.5 AND abs(clat - clon) > 0.5 AND swapped < 0.9 * here, false)"
    for key, test in (
        ("missing", "Latitude IS NULL OR Longitude IS NULL"), ("parse", "false"), ("out_of_bounds", "coalesce(abs(Latitude) > 90 OR abs(Longitude) > 180, false)"), ("precision", low),
        ("null_coords", "coalesce(Latitude = 0 AND Longitude = 0, false)"), ("flip", flip),
    ):
        out.append((test, h, validation.LABELS[coords.HEADING[key]], "Coordinate", validation.ISSUE_LABELS[coords.FLAG[key]]))
    return "", out


_FLAGS = _flags_sql()[1]
_esc = lambda s: s.replace("'", "''")
_FLAG_TABLE = """centres AS (SELECT replace(replace(lower(trim(ADM2_GUID)), '{', ''), '}', '') AS g, min(struct_pack(la := CENTER_LAT, lo := CENTER_LON)) AS a FROM shp_global WHERE ADM2_GUID IS NOT NULL GROUP BY 1),
pc AS (SELECT c.*, a.la AS clat, a.lo AS clon FROM polis_cases c LEFT JOIN centres ON replace(replace(lower(trim(c.Admin2GUID)), '{', ''), '}', '') = g),
ph AS (SELECT *, """ + _hav("Longitude", "Latitude", "clon", "clat") + " AS here, " + _hav("Latitude", "Longitude", "clon", "clat") + " AS swapped FROM pc), fl AS (SELECT EPID, GROUP_COLUMN AS grp, " + ", ".join(f"({e}) AS f{i}" for i, (e, *_x) in enumerate(_FLAGS)) + " FROM ph)"
_COMBOS = "".join(f" UNION ALL SELECT grp, 'Geographical Hierarchy', 'Non-unique {k} Hierarchy ({c})', 0 FROM fl WHERE grp IS NOT NULL GROUP BY grp" for k, c in (("name", "Admin0Name ~ Admin1Name ~ Admin2Name"), ("GUID", "Admin0GUID ~ Admin1GUID ~ Admin2GUID")))
_SUMMARY = " UNION ALL ".join(
    ["SELECT grp, 'Overall Data Summary' AS header, 'Total Rows' AS column_name, count(*) AS count FROM fl WHERE grp IS NOT NULL GROUP BY grp",
     "SELECT grp, 'Overall Data Summary', 'Total Duplicate Rows', count(*) - count(DISTINCT EPID) - max(CASE WHEN EPID IS NULL THEN 1 ELSE 0 END) FROM fl WHERE grp IS NOT NULL GROUP BY grp"]
    + [f"SELECT grp, '{_esc(h)}', '{_esc(c)}', count(*) FILTER (f{i}) FROM fl WHERE grp IS NOT NULL GROUP BY grp" for i, (_e, h, c, _k, _t) in enumerate(_FLAGS)]
) + _COMBOS


def _bundle(spark: SparkSession, d: str, group: str | None) -> validation.CheckBundle:
    return validation.check_data(table(spark, d, "polis_cases"), _SPEC, table(spark, d, "shp_global"), AS_OF, group)


@query(f"WITH {_FLAG_TABLE.replace('GROUP_COLUMN', 'Admin0Name')} SELECT grp AS \"group\", header, column_name, count FROM ({_SUMMARY})")
def summary_table(spark: SparkSession, d: str) -> DataFrame:
    return _bundle(spark, d, "Admin0Name").summary.select("group", "header", "column_name", "count")


@query(f"WITH {_FLAG_TABLE.replace('GROUP_COLUMN', 'Admin0Name')} " + " UNION ".join(f"SELECT EPID AS id, '{k}' AS column_type, '{_esc(t)}' AS test FROM fl WHERE f{i}" for i, (_e, _h, _c, k, t) in enumerate(_FLAGS)))
def check_data_issues(spark: SparkSession, d: str) -> DataFrame:
    return _bundle(spark, d, None).issues


_REGIONS = ("afro", "emro", "other")
_REGION = "CASE lower(trim(WHORegion)) WHEN 'noro' THEN 'afro' WHEN 'suro' THEN 'emro' ELSE 'other' END"


@query(f"WITH {_FLAG_TABLE.replace('GROUP_COLUMN', _REGION)}, s AS (SELECT grp, header, column_name, count FROM ({_SUMMARY})) SELECT header, column_name, "
       + ", ".join(f"CAST(coalesce(sum(count) FILTER (grp = '{g}'), 0) AS BIGINT) AS {g}" for g in _REGIONS) + " FROM s GROUP BY header, column_name")
def summary_by_group(spark: SparkSession, d: str) -> DataFrame:
    """The scorecard of three groups of regions side by side."""
    t = table(spark, d, "polis_cases").withColumn("part", F.expr(_REGION))
    return validation.validate_data(t, _SPEC, table(spark, d, "shp_global"), "part", 3, AS_OF)[1].select("header", "column_name", *_REGIONS)


def _weeks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "polis_virus")
    last = [r.w for r in retained(v.select(F.col("SnapshotWeek").alias("w")), "w", 2).collect()]
    new, old = (last + [None, None])[:2]
    return v.where(F.col("SnapshotWeek") == old), v.where(F.col("SnapshotWeek") == new)


@query("""WITH w AS (SELECT DISTINCT SnapshotWeek AS w FROM polis_virus ORDER BY w DESC LIMIT 2), o AS (SELECT * FROM polis_virus WHERE SnapshotWeek = (SELECT min(w) FROM w)), n AS (SELECT * FROM polis_virus WHERE SnapshotWeek = (SELECT max(w) FROM w)),
f AS (SELECT *, CASE WHEN VirusTypeName = 'WILD1' THEN 'WPV1' ELSE VirusTypeName END AS v FROM n WHERE year(VirusDate) > 2022 AND regexp_matches(VirusTypeName, '^WILD|^VDPV|^cVDPV') AND SurveillanceTypeName IN ('AFP', 'Environmental')
  AND EPID NOT IN (SELECT EPID FROM o WHERE EPID IS NOT NULL)),
p AS (SELECT Admin0Name, CASE WHEN VirusTypeName = 'WILD1' THEN 'WPV1' ELSE VirusTypeName END AS v, CASE WHEN count(*) = count(VirusDate) THEN max(VirusDate) END AS prior FROM o
  WHERE regexp_matches(CASE WHEN VirusTypeName = 'WILD1' THEN 'WPV1' ELSE VirusTypeName END, '^WPV|^VDPV|^cVDPV') AND SurveillanceTypeName IN ('AFP', 'Environmental') GROUP BY ALL),
g AS (SELECT Admin0Name, v, count(*) AS detections, max(VirusDate) AS latest FROM f GROUP BY ALL)
SELECT g.Admin0Name AS "Country", g.v AS "Virus", detections, CASE WHEN prior IS NULL THEN '' WHEN latest - prior < 0 THEN (latest - prior) || '*' ELSE CAST(latest - prior AS VARCHAR) END AS "Days Between"
FROM g LEFT JOIN p ON g.Admin0Name IS NOT DISTINCT FROM p.Admin0Name AND g.v = p.v""")
def detections_table(spark: SparkSession, d: str) -> DataFrame:
    old, new = _weeks(spark, d)
    sia = table(spark, d, "polis_sia").withColumn("ActivityDateFrom", iso_prefix_date(F.col("ActivityDateFrom")))
    r = new_detections(old, new, sia, AS_OF, title_case=False)
    years = [c for c in r.columns if c.endswith(" Detections")]
    total = sum((F.col(f"`{c}`") for c in years), F.lit(0)) if years else F.lit(0)
    return r.select("Country", "Virus", total.cast("long").alias("detections"), "Days Between")


def _ordinal(c: str) -> str:
    return (f"(CASE WHEN day({c}) BETWEEN 11 AND 13 THEN day({c}) || 'th' WHEN day({c}) % 10 = 1 THEN day({c}) || 'st' WHEN day({c}) % 10 = 2 THEN day({c}) || 'nd' "
            f"WHEN day({c}) % 10 = 3 THEN day({c}) || 'rd' ELSE day({c}) || 'th' END || strftime({c}, ' %b %Y'))")  # fmt: skip


_YEARS = tuple(range(AS_OF.year - 2, AS_OF.year + 1))


@query(f"""WITH w AS (SELECT DISTINCT SnapshotWeek AS w FROM polis_virus ORDER BY w DESC LIMIT 2), o AS (SELECT * FROM polis_virus WHERE SnapshotWeek = (SELECT min(w) FROM w)), n AS (SELECT * FROM polis_virus WHERE SnapshotWeek = (SELECT max(w) FROM w)),
f AS (SELECT *, CASE WHEN VirusTypeName = 'WILD1' THEN 'WPV1' ELSE VirusTypeName END AS v FROM n WHERE year(VirusDate) > 2022 AND regexp_matches(VirusTypeName, '^WILD|^VDPV|^cVDPV') AND SurveillanceTypeName IN ('AFP', 'Environmental')
  AND EPID NOT IN (SELECT EPID FROM o WHERE EPID IS NOT NULL)),
p AS (SELECT Admin0Name AS c, CASE WHEN VirusTypeName = 'WILD1' THEN 'WPV1' ELSE VirusTypeName END AS pv, CASE WHEN count(*) = count(VirusDate) THEN max(VirusDate) END AS prior FROM o
  WHERE regexp_matches(CASE WHEN VirusTypeName = 'WILD1' THEN 'WPV1' ELSE VirusTypeName END, '^WPV|^VDPV|^cVDPV') AND SurveillanceTypeName IN ('AFP', 'Environmental') GROUP BY ALL),
g AS (SELECT Admin0Name, v, {", ".join(f"count(*) FILTER (year(VirusDate) = {y}) AS y{y}" for y in _YEARS)}, max(VirusDate) AS latest FROM f GROUP BY ALL),
t AS (SELECT Admin0Name AS tc, v AS tv, VdpvEmergenceGroupName AS eg, CAST(VdpvClassificationChangeDate AS DATE) AS classified, CAST(VdpvReportedToHQDate AS DATE) AS hq, VdpvNtChangesClosestMatch AS near, VdpvNtChangesFromSabin AS sabin, VaccineOrigin AS origin
  FROM (SELECT *, row_number() OVER (PARTITION BY Admin0Name, v ORDER BY VirusDate DESC NULLS LAST, coalesce(EPID, '') DESC) AS rn FROM f) WHERE rn = 1),
m AS (SELECT (SELECT CASE WHEN count(*) = count(UpdatedDate) THEN CAST(max(UpdatedDate) AS DATE) END FROM o) AS old_max, (SELECT CASE WHEN count(*) = count(UpdatedDate) THEN CAST(max(UpdatedDate) AS DATE) END FROM n) AS new_max),
x AS (SELECT Admin0Name, ActivityVaccineType AS kind, string_split(nullif(regexp_extract(ActivityDateFrom, '^\\s*(\\d{{1,4}}-\\d{{1,2}}-\\d{{1,2}})', 1), ''), '-') AS k FROM polis_sia WHERE ActivityStatus = 'Done'),
s AS (SELECT Admin0Name, kind, TRY(make_date(CAST(k[1] AS INT), CAST(k[2] AS INT), CAST(k[3] AS INT))) AS d FROM x),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Admin0Name ORDER BY d DESC, kind DESC NULLS LAST) AS rn FROM s WHERE d IS NOT NULL) WHERE rn = 1)
SELECT array_to_string(list_transform(string_split(lower(g.Admin0Name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS "Country", v AS "Virus", {", ".join(f'y{y} AS "{y} Detections"' for y in _YEARS)},
  coalesce(eg, 'No Classification Given Yet') AS "Emergence Group", v IN ('cVDPV1', 'cVDPV2') AND NOT EXISTS (SELECT 1 FROM o WHERE o.VdpvEmergenceGroupName IS NOT DISTINCT FROM eg) AS "New Emergence",
  {_ordinal("latest")} AS "Latest Detection", CASE WHEN prior IS NULL THEN '' ELSE {_ordinal("prior")} END AS "Prior Detection",
  CASE WHEN prior IS NULL THEN '' WHEN latest - prior < 0 THEN (latest - prior) || '*' ELSE CAST(latest - prior AS VARCHAR) END AS "Days Between",
  CAST(hq - latest AS INT) AS "Days to Confirm", hq - latest > 90 AS "Delayed Report", CASE WHEN near IS NULL THEN coalesce(sabin, 'NA') || '**' ELSE near END AS "Nt Changes",
  v IN ('cVDPV1', 'cVDPV2') AND classified > old_max AND classified <= new_max AS "New VDPV Class", coalesce(origin, '') AS "Vaccine Origin", CASE WHEN d IS NULL THEN 'NAth NA NA' ELSE {_ordinal("d")} END AS "Last SIA Date",
  CAST(latest - d AS INT) AS "Days Since SIA", kind AS "Vaccine Type", try_cast(coalesce(near, sabin) AS DOUBLE) AS "Ntchanges"
FROM g JOIN t ON g.Admin0Name IS NOT DISTINCT FROM tc AND g.v = tv LEFT JOIN p ON g.Admin0Name IS NOT DISTINCT FROM c AND g.v = pv LEFT JOIN l ON l.Admin0Name IS NOT DISTINCT FROM g.Admin0Name, m""")
def detections_table_full(spark: SparkSession, d: str) -> DataFrame:
    """All columns; every year of the last three has one, with 0 where there was nothing."""
    old, new = _weeks(spark, d)
    sia = table(spark, d, "polis_sia").withColumn("ActivityDateFrom", iso_prefix_date(F.col("ActivityDateFrom")))
    r = new_detections(old, new, sia, AS_OF)
    return r.withColumns({f"{y} Detections": F.lit(0).cast("long") for y in _YEARS if f"{y} Detections" not in r.columns})


# ------------------------------------------------------------------ relational operators, formatting


@query("""SELECT VirusId, SnapshotWeek FROM polis_virus v WHERE NOT EXISTS (SELECT 1 FROM polis_cases c WHERE c.EPID = v.EPID)""")
def new_vs_old_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "polis_virus").join(table(spark, d, "polis_cases").select("EPID").distinct(), "EPID", "left_anti").select("VirusId", "SnapshotWeek")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1")
def first_of_group(spark: SparkSession, d: str) -> DataFrame:
    return first_per_group(table(spark, d, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id")]).select("user_id", "event_id", "value")


@query("SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS price FROM orders")
def big_marks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", big_mark(F.floor("o_totalprice")).alias("price"))


@query("SELECT Admin0Name, VirusTypeName, count(*) || ' ' || VirusTypeName AS text FROM polis_virus WHERE VirusTypeName IN ('WPV1', 'cVDPV2', 'VDPV1') GROUP BY Admin0Name, VirusTypeName")
def detection_texts(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "polis_virus").groupBy("Admin0Name", "VirusTypeName").agg(F.count("*").alias("n"))
    return g.select("Admin0Name", "VirusTypeName", detection_text(F.col("n"), F.col("VirusTypeName"), ["WPV1", "cVDPV2", "VDPV1"]).alias("text")).where("text is not null")


@query("""SELECT p_partkey, CAST(p_size * 1000 - p_size * 300 AS BIGINT) AS saved, round(100.0 * (p_size * 1000 - p_size * 300) / (p_size * 1000), 2) AS saved_percent, 'high' AS band FROM part""")
def compression_stats(spark: SparkSession, d: str) -> DataFrame:
    c = compression_columns(F.col("p_size").cast("long") * 1000, F.col("p_size").cast("long") * 300)
    return table(spark, d, "part").select("p_partkey", *[v.alias(k) for k, v in c.items()])


@query("SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_balance(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.rollup("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1")
def pivot_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).fillna(0)


@query("SELECT event_id, value - lag(value) OVER w AS step, ntile(4) OVER w AS quarter, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_frames(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", (F.col("value") - F.lag("value").over(w)).alias("step"), F.ntile(4).over(w).alias("quarter"), F.sum("value").over(w.rowsBetween(-2, 0)).alias("recent"))


@query("""SELECT 'both' AS side, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customer only', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).agg(F.lit("both").alias("side"), F.count("*").alias("n")).unionByName(c.subtract(s).agg(F.lit("customer only").alias("side"), F.count("*").alias("n")))


@query("""SELECT o.CaseId, o.VersionNo, max(r.RunStartedAt) AS last_run FROM (SELECT DISTINCT CaseId, VersionNo, ReceivedAt, upper(trim(WHORegion)) AS g FROM polis_cases) o JOIN polis_data_update_log r
  ON upper(trim(r.Region)) = o.g AND r.RunStartedAt <= o.ReceivedAt GROUP BY ALL""")
def asof_join(spark: SparkSession, d: str) -> DataFrame:
    """The latest run of the region before each delivery."""
    c = table(spark, d, "polis_cases").select("CaseId", "VersionNo", "ReceivedAt", F.upper(F.trim("WHORegion")).alias("g")).distinct()
    r = table(spark, d, "polis_data_update_log").select(F.upper(F.trim("Region")).alias("g"), F.col("RunStartedAt").alias("t")).distinct()
    j = latest_before(c, r, "ReceivedAt", "t", ["g"])
    return j.where("t is not null").groupBy("CaseId", "VersionNo").agg(F.max("t").alias("last_run"))


# ------------------------------------------------------------------ incremental state


@query("SELECT _id, form_id_num, max(date_last_updated) AS date_last_updated FROM ona_visits GROUP BY ALL")
def merge_newest(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "ona_visits")
    new = F.col("date_last_updated") >= F.lit("2024-01-01").cast("timestamp_ntz")
    return merge_latest(t.where(~new), t.where(new), ["_id", "form_id_num"], "date_last_updated").select("_id", "form_id_num", "date_last_updated")


@query("""WITH s AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-15') SELECT event_id FROM s UNION ALL SELECT event_id FROM events WHERE CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM s) AND CAST(ts AS DATE) <= DATE '2024-01-20'""")
def append_newer(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events")
    return append_since(t.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")), t, "ts", until="2024-01-20").select("event_id")


@query("SELECT decision_id, level, name_to_match, replacement, level0_prepped, level1_prepped, level2_prepped, created_time, name_of_creator FROM geoname_cache")
def drop_empty(spark: SparkSession, d: str) -> DataFrame:
    return drop_empty_columns(table(spark, d, "geoname_cache").withColumns({"level3_prepped": F.lit(None).cast("string"), "level4_prepped": F.lit(None).cast("string")}))


@query("""WITH b AS (SELECT form_id_num, count(*) AS o FROM ona_visits WHERE _id % 3 > 0 AND form_id_num % 7 > 0 GROUP BY 1), a AS (SELECT form_id_num, count(*) AS total_rows FROM ona_visits GROUP BY 1)
SELECT a.form_id_num, total_rows, total_rows - coalesce(o, 0) AS new_rows, 10 AS n_columns, 1 AS new_columns, CASE WHEN o IS NULL THEN ' Initial Download' ELSE '' END AS note FROM a LEFT JOIN b ON a.form_id_num = b.form_id_num""")
def load_logs(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "ona_visits")
    return load_log(t.where("_id % 3 > 0 and form_id_num % 7 > 0").drop("_duration"), t, "form_id_num")


@query("SELECT QueryStartDate, QueryEndDate, DataStartDate, DataEndDate, min(RunStartedAt) AS RunStartedAt FROM polis_data_update_log GROUP BY ALL")
def update_log(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "polis_data_update_log").select("QueryStartDate", "QueryEndDate", "DataStartDate", "DataEndDate", "RunStartedAt")
    return append_log(t.where("RunStartedAt < '2023-01-01'"), t.where("RunStartedAt >= '2023-01-01'"), ["QueryStartDate", "QueryEndDate", "DataStartDate", "DataEndDate"], "RunStartedAt")


@query("SELECT 'customer' AS source, c_nationkey AS k, c_name AS name, NULL AS s_acctbal FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_name, s_acctbal FROM supplier")
def union_with_source(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"), "s_acctbal")
    return union_tagged({"customer": c, "supplier": s})


@query("SELECT event_id FROM events WHERE value >= 10 AND value < 50 AND user_id != 7")
def filter_comparison(spark: SparkSession, d: str) -> DataFrame:
    return comparison_filter(table(spark, d, "events"), "value >= 10 & value < 50", "user_id != 7").select("event_id")


@query("SELECT CaseId, VersionNo, ReceivedAt FROM polis_cases WHERE Admin0Name IN ('LOMBOKII', 'KIMLOO') AND VersionNo = 1")
def filter_logical(spark: SparkSession, d: str) -> DataFrame:
    return logical_filter(table(spark, d, "polis_cases"), {"Admin0Name": ["LOMBOKII", "KIMLOO"], "VersionNo": 1}).select("CaseId", "VersionNo", "ReceivedAt")


@query("SELECT CaseId, EPID FROM polis_cases WHERE CaseDate BETWEEN DATE '2023-01-01' AND DATE '2023-06-30' AND WHORegion = 'NORO'")
def filter_odata(spark: SparkSession, d: str) -> DataFrame:
    return odata_filter(table(spark, d, "polis_cases"), "2023-01-01", "2023-06-30", "CaseDate", region="NORO", select=["CaseId", "EPID"])


@query("SELECT DISTINCT SnapshotWeek FROM polis_virus ORDER BY 1 DESC LIMIT 5")
def snapshot_retention(spark: SparkSession, d: str) -> DataFrame:
    return retained(table(spark, d, "polis_virus"), "SnapshotWeek", 5)


_CELLS = "SELECT 'AAA' AS iso3, 2020 AS year, CASE WHEN p_partkey % 2 = 0 THEN 'm' ELSE 'f' END AS sex, {starts}[1 + p_partkey % 18] AS lower, p_partkey % 13 AS x, p_partkey % 17 AS y, CASE WHEN p_partkey % 101 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS value FROM part"


@query(f"WITH c AS ({_CELLS.format(starts='[0, 1, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60, 65, 70, 75, 80]')}) SELECT iso3, year, x, y, CASE WHEN count(value) = count(*) THEN sum(value) END AS value FROM c WHERE lower IN (1, 5, 10) GROUP BY ALL")
def age_bands(spark: SparkSession, d: str) -> DataFrame:
    from vigilark.operators.raster import BAND_STARTS

    start = F.array(*[F.lit(x) for x in BAND_STARTS])[(F.col("p_partkey") % 18).cast("int")]
    c = table(spark, d, "part").select(
        F.lit("AAA").alias("iso3"), F.lit(2020).alias("year"), F.when(F.col("p_partkey") % 2 == 0, "m").otherwise("f").alias("sex"), start.alias("lower"), (F.col("p_partkey") % 13).alias("x"),
        (F.col("p_partkey") % 17).alias("y"), F.when(F.col("p_partkey") % 101 != 0, F.col("p_size").cast("double")).alias("value"),
    )
    return age_band_sum(c, 1, 10)


@query("SELECT c AS country, y AS year FROM (VALUES ('AAA'), ('BBB')) t(c), (VALUES (2019), (2020), (2021)) u(y) WHERE NOT (c = 'AAA' AND y = 2020)")
def download_plans(spark: SparkSession, d: str) -> DataFrame:
    return download_plan(spark, ["AAA", "BBB"], [2019, 2020, 2021], spark.createDataFrame([("AAA", 2020)], "country string, year int"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_flatten(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("p")).select("event_id", "p.k")


# ------------------------------------------------------------------ streams


@query("SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id")
def stream_merge(spark: SparkSession, d: str) -> DataFrame:
    """events as a stream, merged batch by batch into the newest row of each user."""
    schema = table(spark, d, "events").schema
    src = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    t = BucketedTable(spark, scratch_path(spark, "stream"), ["user_id"], 8)
    merge_stream(src, t, ["user_id"], "ts", scratch_path(spark, "stream-checkpoint")).awaitTermination()
    return t.read().select("user_id", "ts")


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events),
b AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM b GROUP BY user_id, k""")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    return gap_sessions(table(spark, d, "events"), "ts", "6 hours", ["user_id"]).select("user_id", "session_start", "n")


@query("SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """events as a stream, of each user and day the first row that comes within the watermark."""
    src = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    days = src.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("day"))
    path = scratch_path(spark, "deduplicated")
    out = dedup_pages(days, ["user_id", "day"], "ts", "1 day").select("user_id", "day")
    out.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch_path(spark, "dedup-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id " + dict(src.dtypes)["user_id"] + ", day date").parquet(path)


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY AS window_end, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Rows per day of events as a stream; the last batch's complete result is kept."""
    src = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*").select(F.col("ts").cast("timestamp").alias("ts"))
    kept = VersionedTable(spark, scratch_path(spark, "windows"))
    q = windowed_counts(src, "ts", "1 day").writeStream.outputMode("complete").foreachBatch(lambda df, n: kept.write(df, n))
    q.option("checkpointLocation", scratch_path(spark, "windows-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return kept.read().select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "n")


# ------------------------------------------------------------------ files and snapshots

_FORMATS_OF_FILES = ("csv", "tsv", "jsonl", "parquet", "orc")


@query("SELECT f AS format, s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier, (VALUES " + ", ".join(f"('{f}')" for f in _FORMATS_OF_FILES) + ") v(f)")
def files_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A table written in every format and read again."""
    t = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    back = {}
    for f in _FORMATS_OF_FILES:
        path = f"{scratch_path(spark, 'files')}/t.{f}"
        files.save(t, path)
        back[f] = files.read(spark, path).select([F.col(c.name).cast(c.dataType).alias(c.name) for c in t.schema])
    return union_tagged(back, "format")


@query("SELECT OBJECTID, ADM2_NAME, CENTER_LON AS lon, CENTER_LAT AS lat FROM shp_global WHERE CENTER_LON IS NOT NULL AND CENTER_LAT IS NOT NULL")
def geojson_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Points written as GeoJSON features and read again."""
    t = table(spark, d, "shp_global").where("CENTER_LON is not null and CENTER_LAT is not null")
    path = f"{scratch_path(spark, 'files')}/centres.geojson"
    files.save(t.select("OBJECTID", "ADM2_NAME", F.col("CENTER_LON").alias("lon"), F.col("CENTER_LAT").alias("lat")), path)
    return files.read(spark, path).select(F.col("OBJECTID").cast("int").alias("OBJECTID"), "ADM2_NAME", "lon", "lat")


@query("SELECT OBJECTID, ADM2_NAME, CENTER_LON AS lon, CENTER_LAT AS lat FROM shp_global")
def shapefile_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Points written as a shapefile and read again; rows without a centre have null shapes."""
    t = table(spark, d, "shp_global").select("OBJECTID", "ADM2_NAME", F.col("CENTER_LON").alias("lon"), F.col("CENTER_LAT").alias("lat"))
    path = f"{scratch_path(spark, 'files')}/centres.shp"
    files.save(t, path)
    return files.read(spark, path).select(F.col("OBJECTID").cast("int").alias("OBJECTID"), "ADM2_NAME", "lon", "lat")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def text_kinds(spark: SparkSession, d: str) -> DataFrame:
    """A third of a table each as CSV under a header of types, as text with a separator to be found, and as one CSV file."""
    t = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    part = [t.where(F.col("n_nationkey") % 3 == k) for k in range(3)]
    folder = scratch_path(spark, "files")
    head = ["# ---", "# fields:", *[x for c, k in (("n_nationkey", "integer"), ("n_name", "string"), ("n_regionkey", "integer")) for x in (f"#  - name: {c}", f"#    type: {k}")], "# ---"]
    rows = lambda df, sep: [sep.join(f'"{v}"' if isinstance(v, str) else str(v) for v in r) for r in df.collect()]  # noqa: E731 - a few nations
    write = lambda lines, name: spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{folder}/{name}")
    write([*head, ",".join(t.columns), *rows(part[0], ",")], "a.csvy")
    write([" ".join(t.columns), *rows(part[1], " ")], "b.txt")
    files.save(part[2], f"{folder}/c.csv", single=True)
    back = [files.read(spark, f"{folder}/{n}").select([F.col(c.name).cast(c.dataType).alias(c.name) for c in t.schema]) for n in ("a.csvy", "b.txt", "c.csv")]
    return back[0].unionByName(back[1]).unionByName(back[2])


@query("""WITH w AS (SELECT DISTINCT SnapshotWeek AS s FROM polis_virus WHERE SnapshotWeek IS NOT NULL ORDER BY s DESC LIMIT 3)
SELECT substr(SnapshotWeek, 1, 4) || ' W' || lpad(substr(SnapshotWeek, 6), 2, '0') AS snapshot, count(*) AS n FROM polis_virus WHERE SnapshotWeek IN (SELECT s FROM w) GROUP BY 1""")
def snapshot_history(spark: SparkSession, d: str) -> DataFrame:
    """Weekly deliveries saved one after the other with three kept, and read again."""
    v, root = table(spark, d, "polis_virus"), scratch_path(spark, "snapshots")
    for w in deliveries(v, "SnapshotWeek"):
        save_snapshot(v.where(F.col("SnapshotWeek") == w), root, "virus", date.fromisocalendar(int(w[:4]), int(w[5:]), 3), keep=3)
    return read_snapshots(spark, root, "virus").groupBy("snapshot").agg(F.count("*").alias("n"))


@query("SELECT 'customer' AS source, c_nationkey AS nationkey, CAST(NULL AS VARCHAR) AS name FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_name FROM supplier")
def table_of_every_source(spark: SparkSession, d: str) -> DataFrame:
    """The same table from every sub-folder of a folder, tagged; columns that one lacks are null, sources without it passed over."""
    root = scratch_path(spark, "databases")
    table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")).write.parquet(f"{root}/customer/people.parquet")
    table(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_name").alias("name")).write.parquet(f"{root}/supplier/people.parquet")
    table(spark, d, "region").write.parquet(f"{root}/other/places.parquet")
    return files.read_all(spark, root, "people")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
