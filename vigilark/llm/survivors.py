"""One surviving record per group of duplicates, chosen field by field.

The fields of every record become long rows (group, field, value, vote). A vote is the trust in the record's source times a
decay with its age. Votes for the same normalised value add up, the value with the most votes wins the field, and the
winners are pivoted back to one row per group.

Where a rule asks for the single best record (highest trust, then latest, then smallest id), votes="ranked" scales them: within a
field of a group every vote below the best in trust, in time or in id is divided by more than twice the number of votes, so that all
lesser votes together weigh less than the best one, and the same sums express the rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilark.functions.text import name_key
from vigilark.plans.joins import HOT_ROWS, fits, join_dimension
from vigilark.session import bounded_by, materialise

# Texts that stand for no value, in capitals.
NO_VALUE = ("", "NA", "N/A", "NULL", "UNKNOWN", "-", "?")


def has_value(c: Column) -> Column:
    return c.isNotNull() & ~F.upper(F.regexp_replace(c, r"^\s+|\s+$", "")).isin(*NO_VALUE)


def utc_time(c: Column) -> Column:
    """Texts of creation times as TIMESTAMP: seconds or milliseconds since 1970, or ISO dates and times; without a zone UTC. Null if
    the text is none of these."""
    t = F.trim(c)
    zoned = F.when(t.rlike(r"(?i)([zZ]|[+-]\d{2}:?\d{2}|[+-]\d{2}|UTC|GMT)$") & t.rlike(r"\d:\d"), t).otherwise(F.concat(F.regexp_replace(t, r"^(\d{4}-\d{2}-\d{2})$", "$1 00:00:00"), F.lit("Z")))
    return (
        F.when(t.rlike(r"^\d{9,10}$"), F.timestamp_seconds(t.try_cast("long")))
        .when(t.rlike(r"^\d{12,13}$"), F.timestamp_millis(t.try_cast("long")))
        .otherwise(zoned.try_cast("timestamp"))
    )


def field_votes(df: DataFrame, group: Sequence[str], id_col: str, fields: Sequence[str], trust: str, time: str) -> DataFrame:
    """(group..., field_name, value, id, trust, at): one long row per field with a value."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields]))
    rows = df.select(*group, F.col(id_col).alias("id"), F.coalesce(F.col(trust), F.lit(0)).alias("trust"), F.col(time).alias("at"), cells.alias("c"))
    return rows.select(*group, "c.field_name", "c.value", "id", "trust", "at").where(has_value(F.col("value")))


def survivors(
    df: DataFrame, group: Sequence[str], id_col: str, fields: Sequence[str], trust: str, time: str,
    votes: str = "sum", half_life_days: float = 365.0,
) -> DataFrame:
    """(group..., group_id, field_name, value, id): the winner of every field of every group of two or more records.

    group_id is the smallest id of the group; id is the record that gives the value. Rows whose group columns or id are null
    belong to no group. Rows with the same id are one record, which has the value of its greatest (trust, time, value). A missing time is
    older than any other. Each record votes once for its normalised value (case, accents, spaces and punctuation ignored):

    - votes="sum": with (trust + 1) * 2^(-age / half life), age counted from the newest record of the table;
    - votes="ranked": with 1, divided by 2 (n + 1), n the votes of the field, for each of: less trust than the best vote, an older time
      than the best one's, another id than the best one's.

    Of the records with the winning value the one with the largest vote, then the smallest id gives its spelling; equal sums go to the
    smaller value. A field without any value gives no row.

    The keys of the groups are made once and written. While the groups fit a broadcast, a group is its group_id, which is short, and groups
    of one record are gone; all steps are map-side aggregations on (group, field[, value]), so a group that holds a third of all rows
    is reduced before it is shuffled, and best votes go to the rows by a join that is broadcast or salted. Beyond a broadcast only groups
    of more than HOT_ROWS rows are done so. The rows of all others are shuffled once, on the columns of their group, and stay there for
    all steps.
    """
    keys = ["group_id", "field_name"]
    if votes == "sum":
        newest = df.agg(F.max(time).alias("t")).first()["t"]
    elif votes != "ranked":
        raise ValueError("votes is 'sum' or 'ranked'")

    def weight() -> Column:
        if votes == "ranked":
            less = lambda worse: F.when(worse, 1 / (2 * (F.col("n") + 1.0))).otherwise(1.0)
            return less(F.col("trust") < F.col("b.trust")) * less(~F.col("at").eqNullSafe(F.col("b.at"))) * less(-F.col("id") != F.col("b.first"))
        age = (F.unix_seconds(F.lit(newest).cast("timestamp")) - F.unix_seconds("at")) / 86400.0 if newest is not None else F.lit(None).cast("double")
        return (F.col("trust") + 1) * F.coalesce(F.pow(F.lit(2.0), -age / half_life_days), F.lit(0.0))

    best = F.max(F.struct(F.col("trust"), F.col("at"), (-F.col("id")).alias("first")))

    def one_vote(v: DataFrame, by: list[str]) -> DataFrame:
        return v.groupBy(*by, "id").agg(F.max(F.struct("trust", "at", "value")).alias("x")).select(*by, "id", "x.*")

    def most_votes(one: DataFrame, by: list[str]) -> DataFrame:
        same = one.withColumn("weight", weight()).groupBy(*by, name_key(F.col("value")).alias("nv")).agg(
            F.sum("weight").alias("votes"), F.max_by(F.struct("value", "id"), F.struct(F.col("weight"), (-F.col("id")).alias("first"))).alias("w")
        )
        # sums of doubles depend on their order in the last digits; rounding keeps ties ties
        won = same.groupBy(*by).agg(F.min_by("w", F.struct(-F.round("votes", 9), F.col("nv"))).alias("w"))
        return won.select(*by, F.col("w.value").alias("value"), F.col("w.id").alias("id"))

    def by_number(groups: DataFrame) -> DataFrame:
        rows = join_dimension(known, groups, list(group), "inner", spread=F.col(id_col))
        v = field_votes(rows, ["group_id"], id_col, fields, trust, time)
        one = one_vote(v, keys)
        if votes == "ranked":
            tops = v.groupBy(*keys).agg(best.alias("b"), F.count("*").alias("n")).select(*keys, "b.*", "n")
            tops = materialise(tops.withColumnsRenamed({c: f"b_{c}" for c in ("trust", "at", "first")}), "best-votes")
            one = join_dimension(one, tops, keys, "inner", spread=F.col("id"))
            one = one.withColumn("b", F.struct(*[F.col(f"b_{c}").alias(c) for c in ("trust", "at", "first")]))
        return join_dimension(most_votes(one, keys), groups, ["group_id"], "inner").select(*group, *keys, "value", "id")

    def in_place(rows: DataFrame, groups: DataFrame) -> DataFrame:
        mine = {g: f"__g{i}" for i, g in enumerate(group)}
        by = [*mine.values(), *keys]
        rows = rows.join(groups.hint("merge"), list(group)).withColumnsRenamed(mine)
        one = one_vote(field_votes(rows, [*mine.values(), "group_id"], id_col, fields, trust, time), by)
        if votes == "ranked":
            w = Window.partitionBy(*by)  # of at most HOT_ROWS rows
            one = one.withColumns({"b": best.over(w), "n": F.count("*").over(w)})
        return most_votes(one, by).select(*[F.col(k).alias(g) for g, k in mine.items()], *keys, "value", "id")

    known = df.where(" and ".join(f"`{g}` is not null" for g in (*group, id_col)))
    known = materialise(known.select(*group, id_col, trust, time, *[f for f in fields if f not in (*group, id_col, trust, time)]), "decisions")
    counted = known.groupBy(*group).agg(F.min(id_col).alias("group_id"), F.max(id_col).alias("__last"), (F.count("*") > HOT_ROWS).alias("__hot"))
    counted = materialise(counted.where("group_id <> __last or __hot"), "groups")
    groups = counted.where("group_id <> __last").drop("__last", "__hot")
    if fits(counted):
        return by_number(bounded_by(groups, counted))
    hot = materialise(counted.where("__hot"), "hot-groups")
    rest = join_dimension(known, hot.select(*group), list(group), "left_anti", spread=F.col(id_col))
    of_many = bounded_by(hot.where("group_id <> __last").drop("__last", "__hot"), hot)
    return by_number(of_many).unionByName(in_place(rest, counted.where("group_id <> __last and not __hot").drop("__last", "__hot")))


def surviving_records(winners: DataFrame, group: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The winners pivoted back: one row per group with the chosen value of every field, null where there was none."""
    pick = [F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in fields]
    return winners.groupBy(*group, "group_id").agg(*pick)
