"""Population grids as tables: age bands that overlap a range, cell-wise sums, download plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Lower ends of the age bands in years; a band ends where the next begins, the last is open.
BAND_STARTS = (0, 1, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60, 65, 70, 75, 80)


def age_bands(spark: SparkSession) -> DataFrame:
    """(lower, upper): the 18 bands, upper null for the open one."""
    rows = [(float(a), float(b) if b is not None else None) for a, b in zip(BAND_STARTS, (*BAND_STARTS[1:], None))]
    return spark.createDataFrame(rows, "lower double, upper double")


def overlapping_bands(spark: SparkSession, low: int, high: int) -> DataFrame:
    """The bands that hold an age from low to high."""
    return age_bands(spark).where((F.col("lower") < high + 1) & (F.coalesce("upper", F.lit(float("inf"))) > low))


def age_band_sum(cells: DataFrame, low: int, high: int) -> DataFrame:
    """(iso3, year, x, y, value): sum over sexes and the bands overlapping low..high; null where any addend is null.

    cells: (iso3, year, sex, lower, x, y, value).
    """
    starts = [float(r["lower"]) for r in overlapping_bands(cells.sparkSession, low, high).collect()]  # at most 18
    on = cells.where(F.col("lower").cast("double").isin(starts))
    return on.groupBy("iso3", "year", "x", "y").agg(F.when(F.count("value") == F.count("*"), F.sum("value")).alias("value"))


def download_plan(spark: SparkSession, countries: list[str], years: list[int], existing: DataFrame) -> DataFrame:
    """(country, year): the files still to be fetched: all combinations without those in existing (country, year)."""
    c = spark.createDataFrame([(x, years) for x in countries], "country string, years array<int>")
    return c.select("country", F.explode("years").alias("year")).join(existing, ["country", "year"], "left_anti")


def download_summary(results: DataFrame) -> DataFrame:
    """(country, downloaded, failed, complete) from results (country, year, success): successes per country; null counts as failure. One
    result per file: of several for one country and year any success counts."""
    one = results.groupBy("country", "year").agg(F.max(F.coalesce("success", F.lit(False))).alias("ok"))
    ok = F.count_if("ok")
    return one.groupBy("country").agg(ok.alias("downloaded"), (F.count("*") - ok).alias("failed"), (ok == F.count("*")).alias("complete"))
