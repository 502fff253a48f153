"""Row numbers within groups of any size without a window over a whole group."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows a window partition should hold at most, on average.
ROWS_PER_BUCKET = 100_000
#: Counts per group and bucket up to which they are broadcast (24 bytes each).
MAX_PLANNED = 1_000_000


def ranked_in_groups(df: DataFrame, group: str, order: Sequence[str], name: str = "rank", rows: int | None = None) -> DataFrame:
    """df with `name` (LONG from 0): a gapless number of every row within its group.

    Rows are spread over buckets by the hash of the order columns, numbered within (group, bucket), and shifted by
    the number of rows in the buckets before. A group that holds a third of all rows is thus numbered by many tasks.
    The order columns must identify a row; the numbering is the same in every run. Groups and buckets are counted in
    one pass; the counts are broadcast while there are at most MAX_PLANNED of them. Rows with a null group form one group.
    """
    n = df.count() if rows is None else rows
    buckets = max(1, math.ceil(n / ROWS_PER_BUCKET))
    b = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = b.groupBy(F.col(group).alias("__g"), F.col("__b").alias("__gb")).agg(F.count("*").alias("n"))
    few = counts.limit(MAX_PLANNED + 1).count() <= MAX_PLANNED
    w = Window.partitionBy("__g").orderBy("__gb").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("__g", "__gb", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("__before"))
    # beyond the bound the same join is shuffled; its keys hold at most a bucket each
    j = b.join(F.broadcast(shift) if few else shift, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__gb")))
    own = F.row_number().over(Window.partitionBy(group, "__b").orderBy(*order)).cast("long")
    return j.withColumn(name, own - 1 + F.col("__before")).drop("__b", "__g", "__gb", "__before")
