"""Names of columns and places: harmonising, matching, suggesting, deciding."""

from __future__ import annotations

import heapq
import math
import re
import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilark.functions.distance import distance_function, string_distance
from vigilark.plans.joins import join_dimension, row_id
from vigilark.session import list_dir, materialise, publish, read_small

LEVELS = tuple(f"level{i}" for i in range(5))


def match_names(ref: DataFrame, target: DataFrame) -> tuple[DataFrame, list[str]]:
    """target with its columns named as in ref where they differ only in case (and, if all names of ref are alphanumeric, in
    punctuation and spaces), and the target names that match nothing. If two target columns match one name the first is renamed."""
    plain = all(re.fullmatch(r"[A-Za-z0-9]+", c) for c in ref.columns)
    key = lambda c: (re.sub(r"[\W_]+", "", c) if plain else c).lower()
    wanted = {key(c): c for c in reversed(ref.columns)}
    taken, out, rest = set(), [], []
    for c in target.columns:
        name = wanted.get(key(c))
        if name and name not in taken:
            taken.add(name)
            out.append(name)
        else:
            out.append(c)
            rest.append(c) if not name else None
    return target.toDF(*out), rest


def _as_boolean(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isin("T", "TRUE", "true", "True"), True).when(s.isin("F", "FALSE", "false", "False"), False)


def match_datatypes(ref: DataFrame, target: DataFrame) -> DataFrame:
    """target with the columns it shares with ref cast to ref's type: INT and LONG (decimals cut), STRING, DOUBLE, BOOLEAN (T, TRUE, true, True and
    the like), DATE. What cannot be read is null; other types are left as they are."""
    types = dict(ref.dtypes)
    out = []
    for c in target.columns:
        col, t = F.col(f"`{c}`"), types.get(c)
        if t in ("int", "bigint"):
            col = col.try_cast("double").try_cast(t)
        elif t in ("string", "double"):
            col = col.try_cast(t)
        elif t == "boolean":
            col = _as_boolean(col)
        elif t == "date":
            s = col.cast("string")
            col = F.coalesce(F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"), F.try_to_date(F.substring(s, 1, 10), "yyyy/MM/dd"))
        out.append(col.alias(c))
    return target.select(*out)


def long_name(*levels: str) -> Column:
    """The levels that are there, joined by _."""
    return F.concat_ws("_", *[F.col(f"`{c}`") for c in levels])


def match_stats(data: DataFrame, lookup: DataFrame, levels: Sequence[str]) -> DataFrame:
    """(level, matched, total): distinct values of each level in data, null counting as one, and how many of them lookup has."""
    def side(df: DataFrame) -> DataFrame:
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("level"), F.col(f"`{c}`").cast("string").alias("value")) for c in levels]))
        return df.select(cells.alias("c")).select("c.level", "c.value").distinct()

    a, b = side(data).alias("a"), side(lookup).withColumn("hit", F.lit(True)).alias("b")
    j = a.join(b, (F.col("a.level") == F.col("b.level")) & F.col("a.value").eqNullSafe(F.col("b.value")), "left")
    return j.groupBy(F.col("a.level").alias("level")).agg(F.count_if("hit").alias("matched"), F.count("*").alias("total"))


#: Names to match, and reference names, that one task ranks without a parent to block on.
NAMES_PER_TASK, REFERENCE_PER_TASK = 500, 50_000


def rank_matches(names: DataFrame, lookup: DataFrame, name: str, candidate: str, parent: Sequence[str] = (), method: str = "jw", top: int | None = None) -> DataFrame:
    """(parents..., algorithm_name, name_to_match, matched_names, distance, match_rank): reference names ranked by distance for
    every distinct name to match, ties by name; the first `top` of them, or all.

    With parents only names under the same parents meet (an equi-join, salted by the name). Without, and with `top`, the names are a
    stated set of queries against the reference names in blocks: a task holds some hundred names and one block, keeps the best of
    each name and never gives out all pairs; blocks are merged by rank. Any number of reference names. Without both, all pairs are the
    result. Null names and null candidates are left out.
    """
    a = names.select(*parent, F.col(name).alias("name_to_match")).where("name_to_match is not null").distinct()
    b = lookup.select(*parent, F.col(candidate).alias("matched_names")).where("matched_names is not null").distinct()
    if not parent and top:
        d = _nearest_in_blocks(a, b, method, top)
    else:
        keys = list(parent) or ["__all"]
        if not parent:
            a, b = a.withColumn("__all", F.lit(0)), b.withColumn("__all", F.lit(0))
        d = join_dimension(a, b, keys, "inner", spread=F.col("name_to_match"))
        d = d.withColumn("distance", string_distance(F.col("name_to_match"), F.col("matched_names"), method))
    w = Window.partitionBy(*parent, "name_to_match").orderBy(F.round("distance", 9).asc_nulls_last(), "matched_names")
    r = d.withColumn("match_rank", F.row_number().over(w)).withColumn("algorithm_name", F.lit(method))
    r = r.where(F.col("match_rank") <= top) if top else r
    return r.select(*parent, "algorithm_name", "name_to_match", "matched_names", "distance", "match_rank")


def _nearest_in_blocks(a: DataFrame, b: DataFrame, method: str, top: int) -> DataFrame:
    """(name_to_match, matched_names, distance): of every name the `top` nearest of each block of reference names."""
    b = materialise(b, "reference-names")
    parts = max(1, math.ceil(a.count() / NAMES_PER_TASK)), max(1, math.ceil(b.count() / REFERENCE_PER_TASK))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = a.withColumns({"p": part("name_to_match", parts[0]), "q": every(parts[1])})
    right = b.withColumns({"q": part("matched_names", parts[1]), "p": every(parts[0])})
    one = distance_function(method)

    def rank(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        candidates, rows = sorted(y["matched_names"]), []
        for n in x["name_to_match"]:
            # sorted by name, and stable, so ties keep the smaller name
            best = heapq.nsmallest(top, ((round(one(n, c), 9), i) for i, c in enumerate(candidates)))
            rows += [(n, candidates[i], one(n, candidates[i])) for _, i in best]
        return pd.DataFrame(rows, columns=["name_to_match", "matched_names", "distance"])

    return left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(rank, "name_to_match string, matched_names string, distance double")


def suggest_geonames(target: DataFrame, lookup: DataFrame, levels: Sequence[str], method: str = "jw", stratify: bool = True, top: int = 5) -> DataFrame:
    """Ranked candidates for every name that lookup does not have under the same parent: (level, parent, algorithm_name, name_to_match,
    matched_names, distance, match_rank). Names whose parent is itself unknown are left for a later pass, once it is decided."""
    out = None
    for i, c in enumerate(levels):
        up = [levels[i - 1]] if stratify and i else []
        todo = target.select(*up, c).distinct().join(lookup.select(*up, c).distinct(), [*up, c], "left_anti").where(F.col(c).isNotNull())
        r = rank_matches(todo, lookup, c, c, up, method, top)
        r = r.select(F.lit(f"level{i}").alias("level"), (F.col(up[0]) if up else F.lit(None).cast("string")).alias("parent"), "algorithm_name", "name_to_match", "matched_names", "distance", "match_rank")
        out = r if out is None else out.unionByName(r)
    return out


def upper_levels(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.upper(F.col(f"`{c}`")) for c in levels})


def apply_decisions(df: DataFrame, decisions: DataFrame, levels: Sequence[str]) -> DataFrame:
    """df with names replaced level by level; each level is looked up under its already corrected parents.

    decisions: (level, name_to_match, replacement, level0_prepped ...); a decision for level k holds under the parents level0_prepped ..
    level(k-1)_prepped. Of several decisions for one place the latest created_time holds, then the smaller replacement. A null
    name, and one without a decision, stays.
    """
    out = df
    for i, c in enumerate(levels):
        up = list(levels[:i])
        d = decisions.where((F.lower(F.trim("level")) == f"level{i}") & F.col("name_to_match").isNotNull() & F.col("replacement").isNotNull())
        keys = {c: F.upper("name_to_match")} | {p: F.upper(f"level{k}_prepped") for k, p in enumerate(up)}
        d = d.select(*[v.alias(k) for k, v in keys.items()], F.upper("replacement").alias("__new"), "created_time")
        best = F.max_by("__new", F.struct(F.coalesce("created_time", F.lit("")), F.col("__new"))).alias("__new")
        d = d.groupBy(*keys).agg(best)
        j = join_dimension(out, d, list(keys), "left", spread=row_id(out))
        out = j.withColumn(c, F.coalesce("__new", f"`{c}`")).drop("__new")
    return out.select(*df.columns)


def split_matched(df: DataFrame, lookup: DataFrame, levels: Sequence[str]) -> DataFrame:
    """df with `matched`: whether lookup has the whole path of names."""
    have = lookup.select(long_name(*levels).alias("long_geo")).distinct().withColumn("__hit", F.lit(True))
    j = join_dimension(df.withColumn("long_geo", long_name(*levels)), have, ["long_geo"], "left", spread=row_id(df))
    return j.withColumn("matched", F.coalesce("__hit", F.lit(False))).drop("__hit")


def prep_geonames(
    target: DataFrame, lookup: DataFrame, levels: Sequence[str], decisions: DataFrame | None = None, method: str = "jw", top: int = 5,
    who_region: str | None = None, region_column: str = "WHO_REGION",
) -> tuple[DataFrame, DataFrame]:
    """(rows with corrected names and `matched`, suggestions for what is still unmatched): upper case, decisions, matching, suggestions, for
    one to five levels from the country down. who_region keeps the part of lookup of one region. Deciding is left to people: they fill
    a table of decisions (DecisionStore keeps it), and this runs again."""
    if not 1 <= len(levels) <= len(LEVELS):
        raise ValueError(f"one to {len(LEVELS)} levels")
    for df, where in ((target, "target"), (lookup, "lookup")):
        for c in levels:
            if c not in df.columns:
                raise ValueError(f"The column '{c}' is not present in the {where} dataframe.")
    if who_region is not None:
        lookup = lookup.where(F.upper(F.trim(F.col(region_column))) == who_region.strip().upper())
    t, ref = upper_levels(target, levels), upper_levels(lookup, levels)
    if decisions is not None:
        t = apply_decisions(t, decisions, levels)
    done = split_matched(t, ref, levels)
    return done, suggest_geonames(done.where(~F.col("matched")).select(*levels), ref, levels, method, True, top)


class DecisionStore:
    """Decisions kept in numbered versions under a folder. save() merges new decisions into the newest version and publishes the
    result atomically; if another writer was first, it merges again, so nobody's decisions are lost."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _head(self) -> tuple[int, str | None]:
        names = sorted(n for n in list_dir(self.spark, f"{self.path}/log") if n.endswith(".txt"))
        return (int(names[-1][:-4]), read_small(self.spark, f"{self.path}/log/{names[-1]}")) if names else (0, None)

    def read(self) -> DataFrame | None:
        """The newest version, None before the first."""
        name = self._head()[1]
        return self.spark.read.parquet(f"{self.path}/data/{name}") if name else None

    def save(self, new: DataFrame) -> int:
        """The number of the version that holds the new decisions."""
        while True:
            version, name = self._head()
            old = self.spark.read.parquet(f"{self.path}/data/{name}") if name else new.limit(0)
            fresh = uuid.uuid4().hex
            merge_decisions(old, new).write.parquet(f"{self.path}/data/{fresh}")
            if publish(self.spark, fresh, f"{self.path}/log/{version + 1:012d}.txt"):
                return version + 1


def split_long_name(df: DataFrame, column: str, into: Sequence[str], sep: str = "_") -> DataFrame:
    """df with a long name taken apart into columns: further parts are dropped, missing ones null."""
    parts = F.split(F.col(f"`{column}`"), re.escape(sep))
    return df.withColumns({c: F.get(parts, F.lit(i)) for i, c in enumerate(into)})


def merge_decisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables, of each level, name and corrected path the latest decision; ties go to the smaller replacement."""
    both = old.unionByName(new, allowMissingColumns=True)
    path = [c for c in (f"level{i}_prepped" for i in range(5)) if c in both.columns]
    w = Window.partitionBy("level", "name_to_match", *path).orderBy(F.col("created_time").desc_nulls_last(), F.col("replacement"))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
