"""Coordinate checks against the centres of administrative units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark.functions.fmt import big_mark, decimal_places
from vigilark.functions.geo import distance_m, in_rings
from vigilark.operators.spatial import BROADCAST_CENTRES, nearest_centres, regions_of_points
from vigilark.plans.joins import join_dimension, row_id
from vigilark.plans.rows import clean_guid

#: Corners up to which rings are tested by one expression per edge; more go through the regions of operators.spatial.
MAX_CORNERS = 500
CHECKS = ("missing", "parse", "out_of_bounds", "precision", "null_coords", "flip", "on_water")
Rings = list[list[tuple[float, float]]]

# Output column of each check and its heading in the summary.
FLAG = {
    "missing": "missing_coords", "parse": "parse_failed", "out_of_bounds": "out_of_bounds", "precision": "low_precision",
    "null_coords": "null_count", "flip": "potentially_flipped", "on_water": "on_water",
}
HEADING = {
    "missing": "Missing Coords", "parse": "Parse Failed", "out_of_bounds": "Out of Bounds", "precision": "Low Precision",
    "null_coords": "Null Coords", "flip": "Potentially Flipped", "on_water": "On Water",
}


def _require(df: DataFrame, column: str | None, what: str, where: str) -> None:
    if column is None or column not in df.columns:
        raise ValueError(f"The {what} '{column}' is not present in the {where} dataframe.")


def with_centre(df: DataFrame, dim: DataFrame, key: str, dim_key: str, lat: str, lon: str, dim_lat: str, dim_lon: str) -> DataFrame:
    """df with the centre of its unit: key in lower case without braces, joined to the same form of dim_key. A unit listed
    several times counts once (its smallest centre)."""
    _require(df, key, "join key", "data")
    _require(dim, dim_key, "join key", "shapefile_data")
    _require(dim, dim_lat, "column", "shapefile_data")
    _require(dim, dim_lon, "column", "shapefile_data")
    _require(df, lat, "column", "data")
    _require(df, lon, "column", "data")
    centre = F.min(F.struct(F.col(f"`{dim_lat}`").alias("la"), F.col(f"`{dim_lon}`").alias("lo"))).alias("__c")
    d = dim.where(F.col(f"`{dim_key}`").isNotNull()).groupBy(clean_guid(F.col(f"`{dim_key}`").cast("string")).alias(key)).agg(centre)
    left = df.drop(*[c for c in (dim_lat, dim_lon) if c in df.columns]).withColumn(key, clean_guid(F.col(f"`{key}`").cast("string")))
    j = join_dimension(left, d, [key], "left", spread=row_id(left))
    return j.withColumns({dim_lat: F.col("__c.la"), dim_lon: F.col("__c.lo")}).drop("__c")


def as_number(df: DataFrame, column: str) -> Column:
    """A column as DOUBLE: numbers as they are, texts where they look like numbers (a failed cast costs an exception), NaN as null."""
    c = F.col(f"`{column}`")
    if dict(df.dtypes)[column] == "string":
        c = F.when(c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), c.try_cast("double"))
    else:
        c = c.try_cast("double")
    return F.when(~F.isnan(c), c)


def flip_columns(lat: Column, lon: Column, clat: Column, clon: Column) -> dict[str, Column]:
    """Distances as given and swapped, whether the coordinates look swapped, and how sure that is (0 to 100)."""
    here, swapped = distance_m(lon, lat, clon, clat), distance_m(lat, lon, clon, clat)
    own, centre = F.abs(lat - lon), F.abs(clat - clon)
    flag = F.when(F.abs(swapped - here) < 1e-6, False).when((own > 0.5) & (centre > 0.5) & (swapped < 0.9 * here), True).otherwise(False)
    score = F.try_divide(100 * (here - swapped), here) * (1 + F.log10(own + 1)) * (1 + F.log10(centre + 1))
    clamped = F.when(score.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)))
    return {"dist_correct": here, "dist_flipped": swapped, "potentially_flipped": flag, "flipped_confidence_score": clamped}


def check_coord_flip(df: DataFrame, dim: DataFrame, key: str, dim_key: str, lat: str, lon: str, dim_lat: str, dim_lon: str) -> DataFrame:
    """df with the centre of each row's unit and the flip columns; rows without a unit are not flagged."""
    j = with_centre(df, dim, key, dim_key, lat, lon, dim_lat, dim_lon)
    la, lo = (as_number(j, c) for c in (lat, lon))
    return j.withColumns(flip_columns(la, lo, F.col(f"`{dim_lat}`"), F.col(f"`{dim_lon}`")))


def correct_flipped(df: DataFrame, dim: DataFrame, key: str, dim_key: str, lat: str, lon: str, dim_lat: str, dim_lon: str) -> DataFrame:
    """df with coordinates swapped back where they look swapped; keeps the flag and its score, the coordinates come last."""
    j = check_coord_flip(df, dim, key, dim_key, lat, lon, dim_lat, dim_lon)
    flag = F.col("potentially_flipped")
    la, lo = (as_number(j, c) for c in (lat, lon))
    rest = [f"`{c}`" for c in j.columns if c not in (lat, lon, dim_lat, dim_lon, "dist_correct", "dist_flipped")]
    return j.select(*rest, F.when(flag, lo).otherwise(la).alias(lat), F.when(flag, la).otherwise(lo).alias(lon))


def land_water(lon: Column, lat: Column, land: Rings, lakes: Rings) -> Column:
    """Land, Inland water (on land and in a lake) or Ocean; null without coordinates."""
    on_land, in_lake = in_rings(lon, lat, land), in_rings(lon, lat, lakes)
    return F.when(lon.isNull() | lat.isNull(), None).when(on_land & ~in_lake, "Land").when(on_land, "Inland water").otherwise("Ocean")


def with_land_water(df: DataFrame, lon: str, lat: str, land: DataFrame, lakes: DataFrame | None, out: str = "on_water") -> DataFrame:
    """df with Land, Inland water or Ocean by tables of regions (`ring` and perhaps `holes`, see spatial.regions_of_points); null without
    readable coordinates. Borders belong to the region. Each distinct place is looked up once."""
    la, lo = as_number(df, lat), as_number(df, lon)
    valid = la.between(-90, 90) & lo.between(-180, 180)
    d = df.withColumns({"__x": lo, "__y": la, "__k": F.when(valid, F.concat_ws(",", lo.cast("string"), la.cast("string")))})
    p = d.where("__k is not null").select("__k", "__x", "__y").distinct()

    def hits(regions: DataFrame, name: str) -> DataFrame:
        r = regions.withColumn("__r", F.lit(1))
        return regions_of_points(p, "__k", "__x", "__y", r, "__r", "ring", holes="holes" if "holes" in r.columns else None).withColumnRenamed("__r", name)

    spread = row_id(df)
    d = join_dimension(d, hits(land, "__land"), ["__k"], "left", spread=spread)
    d = join_dimension(d, hits(lakes, "__lake"), ["__k"], "left", spread=spread) if lakes is not None else d.withColumn("__lake", F.lit(None).cast("int"))
    place = F.when(F.col("__land").isNull(), "Ocean").when(F.col("__lake").isNull(), "Land").otherwise("Inland water")
    return d.withColumn(out, F.when(F.col("__k").isNotNull(), place)).drop("__x", "__y", "__k", "__land", "__lake")


def _as_table(spark: SparkSession, rings: Rings) -> DataFrame:
    return spark.createDataFrame([([(float(x), float(y)) for x, y in r],) for r in rings], "ring array<struct<lon double, lat double>>")


def check_coords(
    df: DataFrame, lat: str, lon: str, checks: Sequence[str] = CHECKS, dim: DataFrame | None = None, key: str | None = None,
    dim_key: str | None = None, dim_lat: str | None = None, dim_lon: str | None = None,
    land: Rings | DataFrame | None = None, lakes: Rings | DataFrame | None = None,
    min_precision: int = 4, strict_parity: bool = False,
) -> DataFrame:
    """df with one column per check, in one projection (and one join for "flip").

    missing_coords: either coordinate is null or blank before it is read as a number. parse_failed: a coordinate is there but no number.
    out_of_bounds: outside -90..90 or -180..180. lat_precision, lon_precision, low_precision: digits after the point. null_count:
    both are 0. potentially_flipped and companions: see flip_columns. on_water: Land, Inland water or Ocean; land and lakes are rings, or
    tables of regions (with_land_water). Rings of more than MAX_CORNERS corners in all become such a table, where borders belong to the
    region. strict_parity=True
    gives parse_failed its odd meaning in the reference results: true for missing rows, null for values out of bounds.
    "flip" needs dim and keys, "on_water" needs land; without them these checks are left out. Input columns whose names clash with a
    result column are replaced.
    """
    unknown = set(checks) - set(CHECKS)
    if unknown:
        raise ValueError(f"unknown checks: {', '.join(sorted(unknown))}")
    if "flip" in checks and dim is not None:
        j = with_centre(df, dim, key, dim_key, lat, lon, dim_lat, dim_lon)
    else:
        checks, j = [c for c in checks if c != "flip"], df
    if land is None:
        checks = [c for c in checks if c != "on_water"]
    elif not isinstance(land, DataFrame) and sum(map(len, [*land, *(lakes or [])])) > MAX_CORNERS:
        land, lakes = _as_table(df.sparkSession, land), _as_table(df.sparkSession, lakes) if lakes else None
    raw_la, raw_lo = F.col(f"`{lat}`"), F.col(f"`{lon}`")
    # one numeric reading of each coordinate, shared by all checks
    j = j.withColumns({"__la": as_number(j, lat), "__lo": as_number(j, lon)})
    la, lo = F.col("__la"), F.col("__lo")
    gone = lambda c, k: c.isNull() | (c.isin("", "NaN", "NA") if dict(df.dtypes)[k] == "string" else F.isnan(c.try_cast("double")))
    missing, unread = gone(raw_la, lat) | gone(raw_lo, lon), la.isNull() | lo.isNull()
    out = F.coalesce((F.abs(la) > 90) | (F.abs(lo) > 180), F.lit(False))
    new: dict[str, Column] = {}
    if "missing" in checks:
        new["missing_coords"] = missing
    if "parse" in checks:
        new["parse_failed"] = F.when(unread, True).when((F.abs(la) > 90) | (lo < -180) | (lo > 360), None).otherwise(False) if strict_parity else unread & ~missing
    if "out_of_bounds" in checks:
        new["out_of_bounds"] = out
    if "precision" in checks:
        p, q = decimal_places(la), decimal_places(lo)
        new |= {"lat_precision": p, "lon_precision": q, "low_precision": F.coalesce((p < min_precision) | (q < min_precision), F.lit(False)) & ~unread}
    if "null_coords" in checks:
        new["null_count"] = F.coalesce((la == 0) & (lo == 0), F.lit(False))
    if "flip" in checks:
        new |= flip_columns(la, lo, F.col(f"`{dim_lat}`"), F.col(f"`{dim_lon}`"))
    if "on_water" in checks and not isinstance(land, DataFrame):
        new["on_water"] = F.when(~out, land_water(lo, la, land, lakes or []))
    j = j.withColumns(new).drop("__la", "__lo")
    return with_land_water(j, lon, lat, land, lakes) if "on_water" in checks and isinstance(land, DataFrame) else j


def summarise_coords(flags: DataFrame, by: Sequence[str] = (), headings: bool = True, as_text: bool = True) -> DataFrame:
    """Number of flagged rows per group from check_coords; counts as text with separators under headings, or plain numbers."""
    have = [c for c in CHECKS if FLAG[c] in flags.columns]
    hit = lambda c: F.col("on_water").isin("Ocean", "Inland water") if c == "on_water" else F.col(FLAG[c])
    aggs = [F.count("*").alias("total_coords")] + [F.count_if(hit(c)).alias(FLAG[c]) for c in have]
    s = flags.groupBy(*by).agg(*aggs) if by else flags.agg(*aggs)
    names = {"total_coords": "Total Coords"} | {FLAG[c]: HEADING[c] for c in have}
    cols = [(big_mark(F.col(c)) if as_text else F.col(c)).alias(names[c] if headings else c) for c in names]
    return s.select(*by, *cols)


def find_nearest(points: DataFrame, point_id: str, lon: str, lat: str, dim: DataFrame, level: str = "adm2", max_centres: int = BROADCAST_CENTRES) -> DataFrame:
    """(point_id, adm, km): the current unit (ENDDATE after 9900) whose centre is nearest on the sphere; ties go to the smaller
    name. Points without coordinates have no row. Any number of centres, see spatial.nearest_centres."""
    if level not in ("adm0", "adm1", "adm2"):
        raise ValueError("level is adm0, adm1 or adm2")
    c = dim.where(F.col("ENDDATE").cast("timestamp_ntz") > F.lit("9900-12-31").cast("timestamp_ntz"))
    c = c.select(F.col(f"{level.upper()}_NAME").alias("adm"), "CENTER_LON", "CENTER_LAT")
    return nearest_centres(points, point_id, lon, lat, c, "adm", "CENTER_LON", "CENTER_LAT", max_centres)
