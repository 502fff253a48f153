"""Merging deliveries into kept tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_latest(state: DataFrame | None, delta: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """state and delta together, of each key the row with the latest `order`; nulls are oldest, ties go to the row with the greatest hash. Rows
    with a null key are compared as if null were a value. Columns that one side lacks are null there."""
    both = delta if state is None else state.unionByName(delta, allowMissingColumns=True)
    cols = both.columns
    rest = [c for c in cols if c not in keys]
    if not rest:
        return both.distinct()
    pick = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(F.col(f"`{order}`").isNotNull(), F.col(f"`{order}`"), F.xxhash64(*[F.col(f"`{c}`") for c in cols])))
    g = both.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(pick.alias("__r"))
    return g.select(*[F.col(f"`{c}`") if c in keys else F.col(f"__r.`{c}`").alias(c) for c in cols])


def append_since(state: DataFrame, source: DataFrame, date_column: str, until: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """state and the rows of source later than the latest date of state (all of them if state has none), up to `until`. With keys the newer row
    replaces the older; without, rows are appended."""
    mark = state.agg(F.max(F.to_date(date_column)).alias("m")).first()["m"]
    new = source.where(F.to_date(date_column) > F.lit(mark)) if mark is not None else source
    if until is not None:
        new = new.where(F.to_date(date_column) <= F.lit(until).cast("date"))
    return merge_latest(state, new, keys, date_column) if keys else state.unionByName(new, allowMissingColumns=True)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """df without the columns that hold nothing but nulls; an empty table keeps its columns. One aggregation."""
    row = df.agg(F.count("*").alias("__n"), *[F.count(f"`{c}`").alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df if not row["__n"] else df.select(*[f"`{c}`" for i, c in enumerate(df.columns) if row[str(i)]])


def union_tagged(tables: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """All tables one above the other with the name of each in `tag`; columns are matched by name, missing ones are null."""
    out = None
    for name, df in tables.items():
        one = df.withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables")
    return out


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One row of each group: the first by `order`. The order should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def load_log(before: DataFrame, after: DataFrame, group: str) -> DataFrame:
    """(group, total_rows, new_rows, n_columns, new_columns, note) of a load: rows and columns now and what was added; a group seen for the first
    time has the note ' Initial Download'."""
    a = after.groupBy(group).agg(F.count("*").alias("total_rows"))
    b = before.groupBy(group).agg(F.count("*").alias("__old"))
    j = a.join(b, group, "left")
    cols = len(set(after.columns) - set(before.columns))
    return j.select(
        group, "total_rows", (F.col("total_rows") - F.coalesce("__old", F.lit(0))).alias("new_rows"), F.lit(len(after.columns)).alias("n_columns"),
        F.lit(cols).alias("new_columns"), F.when(F.col("__old").isNull(), " Initial Download").otherwise("").alias("note"),
    )


def append_log(log: DataFrame | None, line: DataFrame, identity: Sequence[str], time: str) -> DataFrame:
    """log with a line added, lines equal in `identity` kept once with their earliest time."""
    both = line if log is None else log.unionByName(line, allowMissingColumns=True)
    return first_per_group(both, identity, [F.col(time).asc_nulls_last()])
