"""Queries of the corpus problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilark.functions.text import name_key
from vigilark.llm.name_mapping import map_names
from vigilark.llm.packing import pack
from vigilark.llm.subjects import predict_subjects, train_subjects
from vigilark.llm.survivors import survivors, surviving_records, utc_time
from vigilark.llm.tokens import token_counts, token_ids
from vigilark.plans.joins import hot_keys, join_dimension
from vigilark.plans.rows import clean_guid
from vigilark.session import collect_bounded, materialise

CAPACITY = 2048
#: Subject areas that one chain can hold.
MAX_AREAS = 1000


def _places(spark: SparkSession, d: str) -> DataFrame:
    """(scope, name, entry): countries, provinces and current districts with the scope they are typed in."""
    s = spark.read.parquet(f"{d}/shp_global.parquet")
    g = {k: clean_guid(F.col(f"ADM{k}_GUID")) for k in range(3)}
    sep = "\u0002"
    countries = s.select(F.lit("0").alias("scope"), F.col("ADM0_NAME").alias("name"), g[0].alias("entry"))
    provinces = s.select(F.concat_ws(sep, F.lit("1"), "ADM0_NAME").alias("scope"), F.col("ADM1_NAME").alias("name"), g[1].alias("entry"))
    now = s.where((F.year("ENDDATE") == 9999) & F.col("ADM0_NAME").isNotNull() & F.col("ADM1_NAME").isNotNull())
    districts = now.select(F.concat_ws(sep, F.lit("2"), "ADM0_NAME", "ADM1_NAME").alias("scope"), F.col("ADM2_NAME").alias("name"), g[2].alias("entry"))
    return countries.union(provinces.where("ADM0_NAME is not null")).union(districts).distinct()


def _typed(spark: SparkSession, d: str) -> DataFrame:
    """(src, src_id, scope, name): every typed name with the scope it belongs to."""
    sia = spark.read.parquet(f"{d}/polis_sia.parquet").select(
        F.lit("polis_sia").alias("src"), F.col("ActivityId").alias("src_id"), F.lit("0").alias("scope"), F.col("Admin0Name").alias("name"),
    )
    todo = spark.read.parquet(f"{d}/geoname_todo.parquet")
    level = F.lower(F.trim("level"))
    sep = "\u0002"
    scope = (
        F.when(level == "level0", F.lit("0"))
        .when(level == "level1", F.concat_ws(sep, F.lit("1"), F.coalesce("level0_name", F.lit(""))))
        .when(level == "level2", F.concat_ws(sep, F.lit("2"), F.coalesce("level0_name", F.lit("")), F.coalesce("level1_name", F.lit(""))))
        .otherwise(F.lit("?"))
    )
    geo = todo.select(F.lit("geoname_todo").alias("src"), F.col("todo_id").alias("src_id"), scope.alias("scope"), F.col("name_to_match").alias("name"))
    return sia.unionByName(geo).where("src_id is not null").distinct()


def p1_matched(spark: SparkSession, d: str) -> DataFrame:
    """Every typed name that is not already a name of its scope, with its place and score."""
    places = _places(spark, d)
    syn = spark.read.parquet(f"{d}/geo_synonym.parquet").where(F.lower(F.trim("level")) == "level0")
    extra = syn.select(F.lit("0").alias("scope"), F.col("synonym").alias("name"), clean_guid(F.col("adm_guid")).alias("entry"))
    rows = _typed(spark, d).where(F.col("name").rlike(r"\S"))
    rows = join_dimension(rows, places.select("scope", "name").distinct(), ["scope", "name"], "left_anti", spread=F.col("src_id"))
    rows = materialise(rows.withColumn("id", F.concat_ws("\u0001", "scope", "name")), "names")
    # the scope names the parents, from the country down
    up = F.reverse(F.slice(F.split("scope", "\u0002"), 2, 2)).alias("parents")
    typed = rows.select("id", "scope", "name").distinct().select("id", "scope", "name", up)
    names = materialise(map_names(typed, places.unionByName(extra).distinct()), "mapped")
    # one spelling may hold a third of the rows
    return join_dimension(rows, names, ["id"], "left", spread=F.col("src_id"), hot=lambda: hot_keys(rows, ["id"])).drop("id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Typed names and the place they stand for, or 'none'."""
    return p1_matched(spark, d).select("src", "src_id", F.coalesce("entry", F.lit("none")).alias("canon_guid"))


FIELDS = ("replacement", "level0_prepped", "level1_prepped", "level2_prepped")


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decisions with the key of their group, trust and time; a name without letters or digits is no name."""
    c = spark.read.parquet(f"{d}/geoname_cache.parquet").withColumns(
        {"level_key": F.lower(F.trim("level")), "name_key": name_key(F.col("name_to_match")), "at": utc_time(F.col("created_time"))}
    )
    trust = spark.read.parquet(f"{d}/creator_trust.parquet").groupBy("name_of_creator").agg(F.max("trust").alias("trust"))
    c = c.withColumn("name_key", F.when(F.col("name_key") != "", F.col("name_key")))
    return join_dimension(c, trust, ["name_of_creator"], "left", spread=F.col("decision_id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The decision that gives each field of each group's survivor."""
    w = survivors(_decisions(spark, d), ["level_key", "name_key"], "decision_id", FIELDS, "trust", "at", votes="ranked")
    return w.select("group_id", "field_name", F.col("id").alias("decision_id"))


def p5_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The surviving decisions by summed votes."""
    w = survivors(_decisions(spark, d), ["level_key", "name_key"], "decision_id", FIELDS, "trust", "at", votes="sum")
    return surviving_records(w, ["level_key", "name_key"], FIELDS)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return token_ids(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Documents in containers of 2048 tokens."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return pack(token_counts(docs, "doc_id", "text"), "doc_id", "n_tokens", CAPACITY)


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    fill = p9_containers(spark, d).groupBy("container_id").agg(F.sum("size").alias("used"), F.count("*").alias("parts"))
    return fill.agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"),
        F.round(F.sum("used") / (F.count("*") * CAPACITY), 6).alias("fill"),
    )


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The subject areas of every document with content."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source", "family_id")
    labels = spark.read.parquet(f"{d}/subject_labels.parquet")
    areas = spark.read.parquet(f"{d}/subject_areas.parquet").where("subject <> ''").select("subject").distinct()
    names = [r.subject for r in collect_bounded(areas, MAX_AREAS, "subject areas")]
    chain = train_subjects(docs, labels, names, "doc_id", "text", "source", "subject", family_col="family_id")
    return predict_subjects(docs, chain, "doc_id", "text", "source")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters by subject; a document of two subjects counts half for each."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars")
    per = p10_found(spark, d).join(docs, "doc_id")
    per = per.withColumn("share", 1 / F.count("*").over(Window.partitionBy("doc_id")))
    return per.groupBy("subject").agg(F.count("*").alias("documents"), F.round(F.sum("share"), 6).alias("weight"), F.round(F.sum(F.col("share") * F.col("n_chars")), 3).alias("chars"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p5_found, p5_survivors, p8_ids, p9_containers, p9_fill, p10_found, p10_composition)}


_DECISIONS = r"""
c AS (SELECT *, lower(trim(level)) AS lk, nullif(regexp_replace(lower(strip_accents(name_to_match)), '[^\p{L}\p{N}]+', '', 'g'), '') AS nk,
    CASE WHEN regexp_full_match(created_time, '\d{9,10}') THEN to_timestamp(CAST(created_time AS BIGINT))
      WHEN regexp_matches(created_time, '(Z|[+-]\d\d:\d\d)$') THEN try_cast(created_time AS TIMESTAMPTZ)
      ELSE try_cast(created_time || 'Z' AS TIMESTAMPTZ) END AS made,
    coalesce((SELECT max(trust) FROM creator_trust t WHERE t.name_of_creator = geoname_cache.name_of_creator), 0) AS trust
  FROM geoname_cache),
g AS (SELECT lk, nk, min(decision_id) AS group_id FROM c WHERE lk IS NOT NULL AND nk IS NOT NULL AND decision_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT decision_id) > 1),
u AS (SELECT lk, nk, decision_id, made, trust, 'replacement' AS field_name, replacement AS value FROM c
  UNION ALL SELECT lk, nk, decision_id, made, trust, 'level0_prepped', level0_prepped FROM c
  UNION ALL SELECT lk, nk, decision_id, made, trust, 'level1_prepped', level1_prepped FROM c
  UNION ALL SELECT lk, nk, decision_id, made, trust, 'level2_prepped', level2_prepped FROM c),
v AS (SELECT g.group_id, u.* FROM u JOIN g ON u.lk = g.lk AND u.nk = g.nk WHERE value IS NOT NULL AND upper(trim(value)) NOT IN ('', 'NA', 'N/A', 'NULL', 'UNKNOWN', '-', '?'))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": f"""
WITH {_DECISIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY group_id, field_name ORDER BY trust DESC, made DESC NULLS LAST, decision_id) AS rn FROM v)
SELECT group_id, field_name, decision_id FROM r WHERE rn = 1""",
        "p5_survivors": f"""
WITH {_DECISIONS},
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id, field_name, decision_id ORDER BY trust DESC, made DESC NULLS LAST, value DESC) AS rn FROM v) WHERE rn = 1),
w AS (SELECT *, (trust + 1) * coalesce(pow(2.0, -((SELECT floor(epoch(max(made))) FROM c) - floor(epoch(made))) / 86400.0 / 365.0), 0.0) AS weight,
    regexp_replace(lower(strip_accents(value)), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS nv FROM o),
s AS (SELECT lk, nk, group_id, field_name, nv, round(sum(weight), 9) AS votes FROM w GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id, field_name ORDER BY votes DESC, nv) AS rn FROM s) WHERE rn = 1),
x AS (SELECT b.lk, b.nk, b.group_id, b.field_name, w.value, row_number() OVER (PARTITION BY b.group_id, b.field_name ORDER BY w.weight DESC, w.decision_id) AS k
  FROM b JOIN w ON w.group_id = b.group_id AND w.field_name = b.field_name AND w.nv = b.nv)
SELECT lk AS level_key, nk AS name_key, group_id, max(value) FILTER (field_name = 'replacement') AS replacement, max(value) FILTER (field_name = 'level0_prepped') AS level0_prepped,
  max(value) FILTER (field_name = 'level1_prepped') AS level1_prepped, max(value) FILTER (field_name = 'level2_prepped') AS level2_prepped FROM x WHERE k = 1 GROUP BY ALL""",
    }
