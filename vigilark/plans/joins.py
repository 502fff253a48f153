"""Joins whose strategy follows a measured size."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilark.session import known_size, materialise, row_bytes

#: Rows and bytes up to which a side may be broadcast after both have been counted.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
#: Rows of one key that a task may well get.
HOT_ROWS = 10_000


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most max_rows rows and max_bytes bytes. A materialised table knows, and so does what is bounded_by one; else no
    more than max_rows + 1 rows are looked at."""
    if known := known_size(df):
        return known[0] <= max_rows and known[1] <= max_bytes
    n, size = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    return n <= max_rows and size <= max_bytes


def join_dimension(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    spread: Column | None = None,
    salts: int = 16,
    hot: Callable[[], DataFrame] | None = None,
) -> DataFrame:
    """Equi-join of a large, possibly skewed left side with a dimension.

    The right side is counted: within max_rows and BROADCAST_BYTES it is broadcast, so that no row of the left side moves. Beyond, both
    sides are shuffled on the keys plus a salt: left rows take one of `salts` values from `spread` (a column that differs
    within a hot key), right rows are repeated once per salt. Only for inner, left, left_semi and left_anti, where
    repeating right rows under distinct salts cannot repeat a result row. Null keys match nothing. max_rows=0: the right
    side is known to be too large and not counted.

    A merge is asked for, as Spark would judge the right side by its compressed files, without the repeats, and broadcast through the
    driver what was found too large for it. hot gives a table of the keys with many rows on the left: only these are
    repeated, all others have one salt. It is asked for beyond a broadcast only; if it is too large itself, all keys are salted.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join_dimension does not do {how!r} joins")
    if max_rows > 0 and fits(right, max_rows):
        return left.join(F.broadcast(right), list(on), how)
    if spread is None:
        return left.join(right.hint("merge"), list(on), how)
    salt, is_hot = "__salt", "__hot"
    last, mine = F.lit(salts - 1), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    if hot is not None and fits(keys := materialise(hot().select(*on).distinct(), "hot")):
        keys = F.broadcast(keys.withColumn(is_hot, F.lit(True)))
        left, right = left.join(keys, list(on), "left"), right.join(keys, list(on), "left")
        last, mine = F.when(F.col(is_hot), last).otherwise(0), F.when(F.col(is_hot), mine).otherwise(0)
    many = right.withColumn(salt, F.explode(F.sequence(F.lit(0), last))).drop(is_hot)
    one = left.withColumn(salt, mine).drop(is_hot)
    return one.join(many.hint("merge"), [*on, salt], how).drop(salt)


def hot_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """(on...): the keys of more than HOT_ROWS rows."""
    return df.groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") > HOT_ROWS).select(*on)


def row_id(df: DataFrame) -> Column:
    """A hash of the whole row: a spread for tables without a unique column."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, on: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Rows of left with the rows of right whose interval [low, high) holds `point`, and equal values in `on`; inner or left.

    Points and bounds are numbers, dates or timestamps. An interval is repeated once for each bin of `width` (days for dates, seconds
    for timestamps) it touches, a point lies in one bin, so the join is an equi-join on the bin and `on`, under join_dimension's checked
    broadcast or salts. Choose a width near the usual length of an interval: shorter ones repeat long intervals, longer ones let
    points meet intervals beside them. Null points and bounds, and empty intervals, match nothing. `low` and `high` must not be
    columns of left.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is 'inner' or 'left'")
    kinds = dict(left.dtypes) | dict(right.dtypes)

    def number(c: str) -> Column:
        if kinds[c] == "date":
            return F.unix_date(F.col(f"`{c}`")).cast("double")
        if kinds[c].startswith("timestamp"):
            return F.unix_micros(F.col(f"`{c}`").cast("timestamp")) / 1e6
        return F.col(f"`{c}`").cast("double")

    at = lambda x: F.floor(x / width)
    bins = F.sequence(at(number(low)), at(number(high)))
    b = right.where(F.col(f"`{low}`") < F.col(f"`{high}`")).withColumn("__bin", F.explode(bins))
    a = left.withColumns({"__bin": at(number(point)), "__row": row_id(left)})
    if how == "inner":
        j = join_dimension(a, b, [*on, "__bin"], "inner", spread=F.col("__row"))
        return j.where((F.col(f"`{point}`") >= F.col(f"`{low}`")) & (F.col(f"`{point}`") < F.col(f"`{high}`"))).drop("__bin", "__row")
    # rows that meet nothing are found again by what they are; repeated rows stay apart by their number
    a = materialise(left.withColumn("__id", F.monotonically_increasing_id()), "points")
    hits = range_join(a, right, point, low, high, width, on)
    rest = a.join(hits.select("__id").distinct(), "__id", "left_anti")
    return hits.unionByName(rest, allowMissingColumns=True).drop("__id")


def latest_before(left: DataFrame, right: DataFrame, at: str, time: str, on: Sequence[str], unit: str = "day") -> DataFrame:
    """left with the latest `time` of right that is not after `at`, under equal values in `on`; null without one.

    Both sides form one stream ordered by time within (on, unit of time), so no left row meets more than the row before it, and the last
    time of earlier units is carried over by a small table. A key that holds a third of all rows is spread over its units. Null keys
    and times match nothing; ties take the right row. `time` must not be a column of left.
    """
    keys = [f"`{k}`" for k in on]
    slot = lambda c: F.date_trunc(unit, F.col(f"`{c}`")).cast("timestamp_ntz").alias("__s")
    kept = left.columns
    marks = right.where(" and ".join(f"{k} is not null" for k in [*keys, f"`{time}`"])).select(*on, F.col(f"`{time}`").alias("__t"), slot(time)).distinct()
    a = left.select("*", slot(at), F.col(f"`{at}`").alias("__at"), F.lit(1).alias("__o"))
    b = marks.select(*on, "__s", F.col("__t").alias("__at"), F.lit(0).alias("__o"), "__t")
    w = Window.partitionBy(*on, "__s").orderBy("__at", "__o").rowsBetween(Window.unboundedPreceding, 0)
    inside = a.unionByName(b, allowMissingColumns=True).withColumn("__in", F.max("__t").over(w)).where("__o = 1").drop("__t")
    # the last mark of each unit, and for every unit of either side the last one before it
    last = marks.groupBy(*on, "__s").agg(F.max("__t").alias("__t"))
    units = a.select(*on, "__s").distinct().withColumn("__t", F.lit(None).cast(dict(last.dtypes)["__t"]))
    per = last.unionByName(units).groupBy(*on, "__s").agg(F.max("__t").alias("__t"))
    earlier = Window.partitionBy(*on).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(*on, "__s", F.max("__t").over(earlier).alias("__c"))
    j = join_dimension(inside, carried, [*on, "__s"], "left", spread=row_id(left))
    return j.select(*[F.col(f"`{c}`") for c in kept], F.coalesce("__in", "__c").alias(time))
