"""Detections that are new in a later delivery of virus records."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark.functions.dates import format_date_ord
from vigilark.session import collect_bounded

# Surveillance types and names of virus types that count.
SURVEILLANCE = ("AFP", "Environmental")
OLD_TYPES, NEW_TYPES = "^WPV|^VDPV|^cVDPV", "^WILD|^VDPV|^cVDPV"


def new_detections(
    old: DataFrame, new: DataFrame, campaigns: DataFrame, as_of: date, years: int = 3, title_case: bool = True, null_text: str = "NAth NA NA"
) -> DataFrame:
    """One row per country and virus with detections in `new` whose EPID is not in `old`, of the last `years` years.

    Counts per year ("2024 Detections"), the latest and the prior detection, days between them (a negative number is marked *), days to
    confirmation and whether that took more than 90, whether the emergence group is new, the number of nucleotide
    changes (** where it is the one from Sabin), whether the classification is newer than the old delivery, and the latest
    finished campaign of the country. WILD1 counts as WPV1; in `new` only raw names beginning WILD, VDPV or cVDPV are taken. A null
    country is a country of its own. Of several records of the latest date the one with the greatest EPID describes the row. A null date
    among the old detections makes Prior Detection unknown.
    """
    wpv = lambda c: F.when(c == "WILD1", "WPV1").otherwise(c)
    kept = F.col("SurveillanceTypeName").isin(*SURVEILLANCE)
    prev = old.withColumn("Virus", wpv(F.col("VirusTypeName"))).where(F.col("Virus").rlike(OLD_TYPES) & kept)
    prev = prev.groupBy("Admin0Name", "Virus").agg(F.when(F.count_if(F.col("VirusDate").isNull()) == 0, F.max(F.to_date("VirusDate"))).alias("prior"))
    newest = lambda d: F.when(F.count_if(F.col("UpdatedDate").isNull()) == 0, F.max(F.to_date("UpdatedDate")))
    old_max = old.agg(newest(old).alias("old_max"))
    new_max = new.agg(newest(new).alias("new_max"))
    known = old.select("EPID").where("EPID is not null").distinct()
    fresh = new.where((F.year("VirusDate") > as_of.year - years) & F.col("VirusTypeName").rlike(NEW_TYPES) & kept).join(known, "EPID", "left_anti")
    # a null EPID is in old if old has one
    has_null = old.where("EPID is null").limit(1).select(F.lit(True).alias("n"))
    fresh = fresh.join(has_null, F.col("EPID").isNull() & F.col("n"), "left_anti").withColumn("Virus", wpv(F.col("VirusTypeName")))
    fresh = fresh.withColumns({"VirusDate": F.to_date("VirusDate"), "year": F.year("VirusDate")})
    seen = sorted(r.year for r in collect_bounded(fresh.select("year").distinct(), 10_000, "years"))
    nt = F.coalesce(F.col("VdpvNtChangesClosestMatch").cast("string"), F.col("VdpvNtChangesFromSabin").cast("string"))
    nt_text = F.when(F.col("VdpvNtChangesClosestMatch").isNull(), F.concat(F.coalesce(F.col("VdpvNtChangesFromSabin").cast("string"), F.lit("NA")), F.lit("**"))).otherwise(F.col("VdpvNtChangesClosestMatch").cast("string"))
    described = F.struct(
        F.col("VdpvEmergenceGroupName").alias("group"), F.to_date("VdpvClassificationChangeDate").alias("classified"), F.to_date("VdpvReportedToHQDate").alias("hq"),
        nt_text.alias("nt_text"), nt.try_cast("double").alias("nt"), F.col("VaccineOrigin").alias("origin"),
    )
    g = fresh.groupBy("Admin0Name", "Virus").agg(
        *[F.count_if(F.col("year") == y).alias(f"{y} Detections") for y in seen],
        F.max("VirusDate").alias("latest"),
        F.max_by(described, F.struct("VirusDate", F.coalesce("EPID", F.lit("")), F.xxhash64("VdpvEmergenceGroupName", "VaccineOrigin", "VdpvNtChangesClosestMatch"))).alias("top"),
    )
    done = campaigns.where(F.col("ActivityStatus") == "Done").withColumn("d", F.to_date("ActivityDateFrom")).where("d is not null")
    last = done.groupBy(F.col("Admin0Name").alias("c")).agg(F.max_by(F.struct("ActivityVaccineType", "d"), F.struct("d", "ActivityVaccineType")).alias("sia"))
    groups = old.select(F.col("VdpvEmergenceGroupName").alias("eg")).distinct().withColumn("known_group", F.lit(True))
    p = prev.select(F.col("Admin0Name").alias("pc"), F.col("Virus").alias("pv"), "prior")
    j = g.join(p, F.col("Admin0Name").eqNullSafe(F.col("pc")) & (F.col("Virus") == F.col("pv")), "left")
    j = j.join(last, F.col("Admin0Name").eqNullSafe(F.col("c")), "left").join(groups, F.col("top.group").eqNullSafe(F.col("eg")), "left")
    j = j.crossJoin(F.broadcast(old_max)).crossJoin(F.broadcast(new_max))  # one row each
    gap = F.datediff("latest", "prior")
    confirm = F.datediff(F.col("top.hq"), "latest")
    circulating = F.col("Virus").isin("cVDPV1", "cVDPV2")
    country = F.initcap("Admin0Name") if title_case else F.col("Admin0Name")
    newly = circulating & (F.col("top.classified") > F.col("old_max")) & (F.col("top.classified") <= F.col("new_max"))
    return j.select(
        country.alias("Country"), "Virus", *[f"{y} Detections" for y in seen],
        F.coalesce("top.group", F.lit("No Classification Given Yet")).alias("Emergence Group"),
        (circulating & F.col("known_group").isNull()).alias("New Emergence"),
        format_date_ord(F.col("latest")).alias("Latest Detection"),
        F.when(F.col("prior").isNull(), "").otherwise(format_date_ord(F.col("prior"))).alias("Prior Detection"),
        F.when(gap.isNull(), "").when(gap < 0, F.concat(gap.cast("string"), F.lit("*"))).otherwise(gap.cast("string")).alias("Days Between"),
        confirm.alias("Days to Confirm"), (confirm > 90).alias("Delayed Report"), F.col("top.nt_text").alias("Nt Changes"), newly.alias("New VDPV Class"),
        F.coalesce("top.origin", F.lit("")).alias("Vaccine Origin"), format_date_ord(F.col("sia.d"), null_text).alias("Last SIA Date"),
        F.datediff("latest", F.col("sia.d")).alias("Days Since SIA"), F.col("sia.ActivityVaccineType").alias("Vaccine Type"), F.col("top.nt").alias("Ntchanges"),
    )
