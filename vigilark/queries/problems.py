"""Queries of the general data problems: nearness, snapshot changes, incremental work, profiles, instants."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilark.operators.column_profile import MAX_COLUMNS, column_profile, kinds_of_values, matched_values, profile_findings, value_counts
from vigilark.operators.instants import InstantDictionary, dictionary_entries, normalise_instants
from vigilark.operators.snapshot_diff import latest_state, snapshot_diff
from vigilark.operators.spatial import points_near_centres
from vigilark.operators.work_ledger import WorkLedger, outstanding_versions
from vigilark.plans.joins import join_dimension
from vigilark.plans.rows import clean_guid
from vigilark.session import collect_bounded, materialise, scratch_path

NEAR_KM = 3.0


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Submissions and the current districts whose centre is at most 3 km away."""
    visits = spark.read.parquet(f"{d}/ona_visits.parquet").select("_id", "longitude", "latitude")
    shapes = spark.read.parquet(f"{d}/shp_global.parquet").where(F.year("ENDDATE") == 9999)
    centres = shapes.select(clean_guid(F.col("ADM2_GUID")).alias("adm2_guid"), "CENTER_LON", "CENTER_LAT")
    near = points_near_centres(visits, "_id", "longitude", "latitude", centres, "adm2_guid", "CENTER_LON", "CENTER_LAT", NEAR_KM)
    return near.select(F.col("_id").alias("visit_id"), "adm2_guid")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Virus records added, removed or changed between consecutive deliveries."""
    virus = spark.read.parquet(f"{d}/polis_virus.parquet")
    diff = snapshot_diff(virus, "SnapshotWeek", ["VirusId"], "UpdatedDate")
    return diff.select(F.col("VirusId").alias("virus_id"), F.col("from_delivery").alias("week_from"), F.col("to_delivery").alias("week_to"), "change_kind")


def p3_changes_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Number of changes per delivery, kind and virus type of the later (or last) state."""
    virus = spark.read.parquet(f"{d}/polis_virus.parquet")
    diff = snapshot_diff(virus, "SnapshotWeek", ["VirusId"], "UpdatedDate")
    state = latest_state(virus, "SnapshotWeek", ["VirusId"], "UpdatedDate").select(F.col("SnapshotWeek").alias("w"), "VirusId", "VirusTypeName", "Admin0Name")
    at = F.when(F.col("change_kind") == "removed", F.col("from_delivery")).otherwise(F.col("to_delivery"))
    j = diff.withColumn("w", at).join(state, ["w", "VirusId"])
    return j.groupBy("to_delivery", "change_kind", "VirusTypeName").agg(F.count("*").alias("n"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Record versions that the next run still has to process."""
    cases = spark.read.parquet(f"{d}/polis_cases.parquet").select("CaseId", "VersionNo", "WHORegion", "LastUpdateDate", "ReceivedAt")
    log = spark.read.parquet(f"{d}/polis_data_update_log.parquet")
    return outstanding_versions(cases, log).where("state <> 'done'").select("case_id", "version_no")


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every record version with the run that processed it: two runs of a WorkLedger, the first over what was delivered before 2024, the second over
    everything, of which it takes only what is new."""
    cases = spark.read.parquet(f"{d}/polis_cases.parquet").where("CaseId is not null and VersionNo is not null")
    items = cases.groupBy("CaseId", "VersionNo").agg(F.min("ReceivedAt").alias("seen")).withColumn("item", F.concat_ws("/", "CaseId", "VersionNo"))
    now = datetime(2026, 1, 1)
    ledger = WorkLedger(spark, scratch_path(spark, "ledger"), lambda: now)
    out = lambda df: df.select("item", F.col("CaseId").alias("case_id"), F.col("VersionNo").alias("version_no"))
    first = ledger.process(items.where("seen < '2024-01-01'"), out, now, now + timedelta(hours=1))
    ledger.process(items, out, now, now + timedelta(hours=1))
    done = ledger.results(T.StructType([T.StructField("case_id", T.LongType()), T.StructField("version_no", T.IntegerType())]))
    return done.select("case_id", "version_no", F.when(F.col("token") == first, 1).otherwise(2).alias("run"))


def _profile(spark: SparkSession, d: str, only_rules: bool = False):
    """Value counts of every column of polis_sia, or of those with a rule, and the rules."""
    sia = spark.read.parquet(f"{d}/polis_sia.parquet")
    rules = spark.read.parquet(f"{d}/column_rules.parquet")
    columns = [c for c in sia.columns if c != "LoadNo"]
    if only_rules:
        named = {r.column_name for r in collect_bounded(rules.select("column_name").distinct(), MAX_COLUMNS, "rules")}
        columns = [c for c in columns if c in named]
    return value_counts(sia, "LoadNo", columns), rules


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Places where a load of polis_sia breaks a rule or departs from the load before."""
    counts, rules = _profile(spark, d, only_rules=True)
    return profile_findings(column_profile(counts, rules), rules).select(F.col("load").alias("load_no"), "column_name", "finding")


def p6_profile(spark: SparkSession, d: str) -> DataFrame:
    """The profile of every column in every load: standard aggregates, broken rules, shift."""
    counts, rules = _profile(spark, d)
    p = column_profile(counts, rules)
    cols = ("n_rows", "n_null", "n_distinct", "min_number", "max_number", "n_nonmatching", "n_below", "n_above")
    return p.select(F.col("load").alias("load_no"), "column_name", *cols, F.round("distance", 6).alias("distance"))


def p6_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What the induced expressions say of every column in every load: rows outside them, the shift of their coverage, and all
    findings, columns without rules held to a twentieth of such rows and a quarter of shift."""
    counts, rules = _profile(spark, d)
    p = materialise(column_profile(counts, rules), "profile")
    f = profile_findings(p, rules, 0.05, 0.25).groupBy("load", "column_name").agg(F.array_sort(F.collect_list("finding")).alias("findings"))
    j = p.join(f, ["load", "column_name"], "left")
    return j.select(F.col("load").alias("load_no"), "column_name", "n_rows", "n_nonconforming", F.round("coverage_distance", 6).alias("coverage_distance"), F.coalesce("findings", F.array().cast("array<string>")).alias("findings"))


def p6_expressions(spark: SparkSession, d: str) -> DataFrame:
    """The induced expressions of every column, the values and rows they hold, and those that none holds."""
    counts, _ = _profile(spark, d)
    m = matched_values(kinds_of_values(counts)).where(~F.col("blank")).groupBy("column_name", "value", "expression", "conforming").agg(F.sum("n").alias("n"))
    return m.groupBy("column_name", "expression", "conforming").agg(F.count("*").alias("n_values"), F.sum("n").alias("n_rows"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Date texts of two tables as microseconds UTC, for texts that denote an instant and are not in the normal form."""
    zones = spark.read.parquet(f"{d}/office_zones.parquet").dropDuplicates(["office_code"])
    sia = spark.read.parquet(f"{d}/polis_sia.parquet").select(F.lit("polis_sia").alias("src"), F.col("ActivityId").alias("rec_id"), "office_code", F.col("ActivityDateFrom").alias("text"))
    ona = spark.read.parquet(f"{d}/ona_visits.parquet").select(F.lit("ona_visits").alias("src"), F.col("_id").alias("rec_id"), "office_code", F.col("today").alias("text"))
    store = InstantDictionary(spark, scratch_path(spark, "instants"))
    rows = []
    for r in (sia, ona):  # the second table parses only what the first did not hold
        todo = r.where(F.col("text").isNotNull() & ~F.col("text").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\z"))
        rows.append(join_dimension(todo, zones, ["office_code"], "left", spread=F.col("rec_id")))
        store.extend(dictionary_entries(rows[-1], "text", "tz_name", "date_order"))
    both = normalise_instants(rows[0].unionByName(rows[1]), "text", "tz_name", "date_order", store, extend=False)
    return both.where("utc_us is not null").select("src", "rec_id", "utc_us").distinct()


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p3_found, p3_changes_by_type, p4_found, p4_runs, p6_found, p6_profile, p6_coverage, p6_expressions, p7_found)}


_LATEST = """
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY SnapshotWeek, VirusId ORDER BY UpdatedDate DESC NULLS LAST) AS rn FROM polis_virus
    WHERE SnapshotWeek IS NOT NULL AND VirusId IS NOT NULL) WHERE rn = 1),
weeks AS (SELECT w AS week_to, lag(w) OVER (ORDER BY w) AS week_from FROM (SELECT DISTINCT SnapshotWeek AS w FROM polis_virus WHERE SnapshotWeek IS NOT NULL)),
pairs AS (SELECT * FROM weeks WHERE week_from IS NOT NULL),
o AS (SELECT p.week_from, p.week_to, l.VirusId, row(l.EPID, l.Admin0Name, l.VirusTypeName, l.VirusDate, l.SurveillanceTypeName, l.VdpvEmergenceGroupName,
        l.VdpvClassificationChangeDate, l.VdpvReportedToHQDate, l.VdpvNtChangesFromSabin, l.VdpvNtChangesClosestMatch, l.VaccineOrigin) AS v,
        l.VirusTypeName FROM pairs p JOIN latest l ON l.SnapshotWeek = p.week_from),
n AS (SELECT p.week_from, p.week_to, l.VirusId, row(l.EPID, l.Admin0Name, l.VirusTypeName, l.VirusDate, l.SurveillanceTypeName, l.VdpvEmergenceGroupName,
        l.VdpvClassificationChangeDate, l.VdpvReportedToHQDate, l.VdpvNtChangesFromSabin, l.VdpvNtChangesClosestMatch, l.VaccineOrigin) AS v,
        l.VirusTypeName FROM pairs p JOIN latest l ON l.SnapshotWeek = p.week_to),
diff AS (
  SELECT coalesce(o.VirusId, n.VirusId) AS virus_id, coalesce(o.week_from, n.week_from) AS week_from, coalesce(o.week_to, n.week_to) AS week_to,
    CASE WHEN o.VirusId IS NULL THEN 'added' WHEN n.VirusId IS NULL THEN 'removed' ELSE 'changed' END AS change_kind,
    CASE WHEN n.VirusId IS NULL THEN o.VirusTypeName ELSE n.VirusTypeName END AS vt
  FROM o FULL OUTER JOIN n ON o.VirusId = n.VirusId AND o.week_to = n.week_to
  WHERE o.VirusId IS NULL OR n.VirusId IS NULL OR o.v IS DISTINCT FROM n.v)
"""

_UNPIVOT = """
cells AS (
  SELECT LoadNo AS load, 'ActivityId' AS column_name, CAST(ActivityId AS VARCHAR) AS value FROM polis_sia
  UNION ALL SELECT LoadNo, 'office_code', office_code FROM polis_sia UNION ALL
  SELECT LoadNo, 'Admin0Name', Admin0Name FROM polis_sia
  UNION ALL SELECT LoadNo, 'ActivityStatus', ActivityStatus FROM polis_sia
  UNION ALL SELECT LoadNo, 'ActivityVaccineType', ActivityVaccineType FROM polis_sia
  UNION ALL SELECT LoadNo, 'ActivityDateFrom', ActivityDateFrom FROM polis_sia
  UNION ALL SELECT LoadNo, 'TargetPopulation', CAST(TargetPopulation AS VARCHAR) FROM polis_sia
  UNION ALL SELECT LoadNo, 'AgeGroupMonths', CAST(AgeGroupMonths AS VARCHAR) FROM polis_sia),
c AS (SELECT cells.*, (value IS NULL OR regexp_full_match(value, '\\s*')) AS blank, try_cast(value AS DOUBLE) AS num, r.* EXCLUDE (column_name)
  FROM cells LEFT JOIN column_rules r USING (column_name) WHERE load IS NOT NULL),
base AS (SELECT load, column_name, count(*) AS n_rows, count(*) FILTER (blank) AS n_null, count(DISTINCT value) FILTER (NOT blank) AS n_distinct,
  count(*) FILTER (NOT blank AND pattern IS NOT NULL AND NOT regexp_matches(value, pattern)) AS n_nonmatching,
  count(*) FILTER (NOT blank AND num < min_value) AS n_below, count(*) FILTER (NOT blank AND num > max_value) AS n_above,
  min(num) FILTER (NOT blank) AS min_number, max(num) FILTER (NOT blank) AS max_number FROM c GROUP BY ALL),
shares AS (SELECT c.load, c.column_name, c.value, count(*) / any_value(b.n_rows - b.n_null) AS s FROM c JOIN base b ON b.load = c.load AND b.column_name = c.column_name WHERE NOT blank GROUP BY ALL),
shift AS (SELECT load, column_name, sum(abs(d)) / 2 AS distance FROM (
    SELECT load, column_name, value, sum(s) AS d FROM (SELECT load, column_name, value, s FROM shares UNION ALL SELECT load + 1, column_name, value, -s FROM shares) GROUP BY ALL) GROUP BY ALL),
p AS (SELECT b.*, q.n_null / q.n_rows AS prev_null, q.n_distinct AS prev_distinct,
    CASE WHEN q.n_rows > q.n_null AND b.n_rows > b.n_null THEN shift.distance END AS distance
  FROM base b LEFT JOIN base q ON q.load = b.load - 1 AND q.column_name = b.column_name
  LEFT JOIN shift ON shift.load = b.load AND shift.column_name = b.column_name)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
SELECT DISTINCT v._id AS visit_id, replace(replace(lower(s.ADM2_GUID), '{', ''), '}', '') AS adm2_guid
FROM ona_visits v JOIN shp_global s
  ON year(s.ENDDATE) = 9999 AND abs(v.latitude - s.CENTER_LAT) < 0.05
  AND 2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians(s.CENTER_LAT - v.latitude) / 2), 2)
    + cos(radians(v.latitude)) * cos(radians(s.CENTER_LAT)) * pow(sin(radians(s.CENTER_LON - v.longitude) / 2), 2)))) <= 3
WHERE v.latitude BETWEEN -90 AND 90 AND v.longitude BETWEEN -180 AND 180""",
        "p3_found": f"WITH {_LATEST} SELECT virus_id, week_from, week_to, change_kind FROM diff",
        "p3_changes_by_type": f"WITH {_LATEST} SELECT week_to AS to_delivery, change_kind, vt AS VirusTypeName, count(*) AS n FROM diff GROUP BY ALL",
        "p4_found": """
WITH v AS (SELECT CaseId, VersionNo, lower(trim(any_value(WHORegion))) AS region, max(CAST(LastUpdateDate AS DATE)) AS day, min(ReceivedAt) AS first_seen
  FROM polis_cases WHERE CaseId IS NOT NULL AND VersionNo IS NOT NULL GROUP BY ALL),
newest AS (SELECT * FROM v WHERE VersionNo = (SELECT max(VersionNo) FROM v w WHERE w.CaseId = v.CaseId))
SELECT CaseId AS case_id, VersionNo AS version_no FROM newest n
WHERE NOT EXISTS (SELECT 1 FROM polis_data_update_log l WHERE l.RunStatus = 'success' AND l.PolisDataType = 'Case'
  AND (lower(trim(l.Region)) = n.region OR lower(trim(l.Region)) = 'global') AND l.DataEndDate IS NOT NULL
  AND n.day BETWEEN l.QueryStartDate AND least(l.QueryEndDate, l.DataEndDate) AND n.first_seen <= l.RunStartedAt)""",
        "p4_runs": """SELECT CaseId AS case_id, VersionNo AS version_no, CASE WHEN min(ReceivedAt) < TIMESTAMP '2024-01-01' THEN 1 ELSE 2 END AS run
FROM polis_cases WHERE CaseId IS NOT NULL AND VersionNo IS NOT NULL GROUP BY ALL""",
        "p6_profile": f"""WITH {_UNPIVOT}
SELECT load AS load_no, column_name, n_rows, n_null, n_distinct, min_number, max_number, n_nonmatching, n_below, n_above, round(distance, 6) AS distance FROM p""",
        "p6_found": f"""
WITH {_UNPIVOT}
SELECT load AS load_no, column_name, finding FROM (
  SELECT p.load, p.column_name, unnest(list_filter([
    CASE WHEN n_rows > n_null AND n_nonmatching / (n_rows - n_null) > max_bad_share THEN 'pattern' END,
    CASE WHEN n_below + n_above > 0 THEN 'range' END,
    CASE WHEN abs(n_null / n_rows - prev_null) > max_null_step THEN 'null_step' END,
    CASE WHEN categorical AND distance > max_distance THEN 'distance' END,
    CASE WHEN greatest(n_distinct, prev_distinct) > max_distinct_ratio * least(n_distinct, prev_distinct) AND prev_distinct IS NOT NULL THEN 'distinct' END], lambda x: x IS NOT NULL)) AS finding
  FROM p JOIN column_rules r USING (column_name))""",
    }
