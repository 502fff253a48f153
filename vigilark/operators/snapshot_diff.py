"""Changes between consecutive full deliveries of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark.plans.rows import row_hash
from vigilark.session import collect_bounded, materialise

#: More deliveries than this would not be planned on the driver (a daily delivery reaches it after 273 years).
MAX_DELIVERIES = 100_000


def deliveries(df: DataFrame, delivery: str) -> list[str]:
    """The deliveries present, in order. One value per delivery, so bounded by the calendar; checked."""
    rows = df.select(F.col(delivery).cast("string").alias("w")).where("w is not null").distinct()
    return sorted(r.w for r in collect_bounded(rows, MAX_DELIVERIES, "deliveries"))


def snapshot_diff(
    df: DataFrame,
    delivery: str,
    keys: Sequence[str],
    version: str,
    ignore: Sequence[str] = (),
) -> DataFrame:
    """Records added, removed or changed between consecutive deliveries.

    df holds all deliveries one above the other. Of several rows of one record in one delivery the one with the latest
    `version` holds (null is oldest; of rows with the same version the one with the greatest hash, so that the result
    does not depend on the order of rows). Rows are compared by the hash of all columns but the keys, `delivery`,
    `version` and `ignore`; null is a value of its own.

    Returns the keys, `from_delivery`, `to_delivery`, `change_kind` ('added', 'removed', 'changed'). The first delivery
    adds nothing, rows with a null delivery or a null key have no identity and are left out, an empty table or a single
    delivery gives no rows.

    Plan: one partial aggregation per (delivery, key), written once, then one full outer join on (later delivery, key); both sides of
    the join are hashed on the same keys. No key holds more than one row per delivery at the join, so a hot record
    or a large delivery cannot skew it.
    """
    order = deliveries(df, delivery)
    skip = {delivery, version, *keys, *ignore}
    compared = [c for c in df.columns if c not in skip]
    rows = df.where(" and ".join(f"`{c}` is not null" for c in (delivery, *keys)))
    h = row_hash(compared)
    state = rows.groupBy(F.col(delivery).cast("string").alias("__w"), *keys).agg(
        F.max_by(h, F.struct(F.col(version).isNotNull(), F.col(version), h)).alias("__h")
    )
    state = materialise(state, "states")  # both sides of the join are read from it
    # each state is the later side of its own delivery and the earlier side of the next; one row per delivery goes to all executors
    pairs = df.sparkSession.createDataFrame(list(zip(order, [None, *order], [*order[1:], None])), "__w string, __prev string, __next string")
    state = state.join(F.broadcast(pairs), "__w")
    old = state.where("__next is not null").select(F.col("__next").alias("to_delivery"), *keys, F.col("__w").alias("__from"), F.col("__h").alias("__old"))
    new = state.where("__prev is not null").select(F.col("__w").alias("to_delivery"), *keys, "__prev", F.col("__h").alias("__new"))
    both = old.join(new, ["to_delivery", *keys], "full_outer").where(~F.col("__old").eqNullSafe(F.col("__new")))
    kind = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").otherwise("changed")
    return both.select(*keys, F.coalesce("__from", "__prev").alias("from_delivery"), "to_delivery", kind.alias("change_kind"))


def latest_state(df: DataFrame, delivery: str, keys: Sequence[str], version: str) -> DataFrame:
    """The rows that hold: one per delivery and key, chosen as in snapshot_diff."""
    cols = [c for c in df.columns]
    rows = df.where(" and ".join(f"`{c}` is not null" for c in (delivery, *keys)))
    rest = [c for c in cols if c not in (delivery, *keys)]
    pick = F.max_by(F.struct(*rest), F.struct(F.col(version).isNotNull(), F.col(version), row_hash(cols)))
    return rows.groupBy(delivery, *keys).agg(pick.alias("__r")).select(delivery, *keys, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*cols)
