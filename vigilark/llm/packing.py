"""Items of varying length in containers of one capacity: linear grouping, configurations, best fit.

1. Items longer than the capacity are cut into full parts and a rest; nothing else is cut.
2. Large items: their lengths are cut into groups of about equal cardinality and rounded up to the largest of the group.
   With so few sizes the best mix of configurations (how many of each size share a container) is a small linear
   program, solved by column generation; its solution is rounded down and the few items left over are placed greedily.
3. The real items take the places of the rounded ones.
4. Small items go, longest first, into the container with the least space that still holds them; new
   containers are opened only when none does.

The driver sees histograms of lengths and of free spaces (at most capacity + 1 numbers each), never items; items find their
container by their rank within their length, computed without a window over a whole group.
"""

from __future__ import annotations

import bisect
import math
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark.plans.ranks import ranked_in_groups
from vigilark.session import materialise

#: Items up to this share of the capacity are small.
SMALL_SHARE = 1 / 8
#: Groups of the linear grouping.
GROUPS = 96


# ------------------------------------------------------------------ planning on histograms


def linear_groups(hist: dict[int, int], groups: int) -> list[tuple[int, int, int]]:
    """(lowest size, highest size, items) of each group, largest sizes first; equal sizes stay together."""
    total, out, cur = sum(hist.values()), [], []
    want = max(1, math.ceil(total / groups))
    for s in sorted(hist, reverse=True):
        if cur and sum(hist[x] for x in cur) + hist[s] / 2 > want:
            out.append((cur[-1], cur[0], sum(hist[x] for x in cur)))
            cur = []
        cur.append(s)
    if cur:
        out.append((cur[-1], cur[0], sum(hist[x] for x in cur)))
    return out


def _best_config(sizes: np.ndarray, value: np.ndarray, most: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest value: a bounded knapsack over the capacity."""
    best = np.zeros(capacity + 1)
    took = np.zeros((len(sizes), capacity + 1), np.int16)
    for g, w in enumerate(sizes):
        if value[g] <= 0:
            continue
        base, top = best, best.copy()
        for k in range(1, int(min(most[g], capacity // w)) + 1):
            cand = base[: capacity + 1 - k * w] + k * value[g]
            better = cand > top[k * w :] + 1e-12
            top[k * w :][better] = cand[better]
            took[g, k * w :][better] = k
        best = top
    c, config = int(np.argmax(best)), np.zeros(len(sizes), int)
    for g in range(len(sizes) - 1, -1, -1):
        k = int(took[g, c])
        config[g] = k
        c -= k * int(sizes[g])
    return float(best.max()), config


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 3000) -> list[tuple[list[int], int]]:
    """(configuration, times) that together hold the demand, close to the fewest containers.

    The linear program is solved by column generation: start with one size per container, price new configurations
    with a knapsack over the dual values, stop when none is worth more than a container. Times are rounded down; what is then
    missing is filled by configurations of the greatest total size among the items left. If `rounds` end before the program is
    solved a warning says so: the result holds the demand all the same, perhaps in more containers.
    """
    if not sizes:
        return []
    s, d = np.array(sizes), np.array(demand, float)
    n = len(s)
    cols = np.diag([capacity // x for x in sizes]).astype(float)
    binv = np.diag(1 / np.diag(cols))
    x = binv @ d
    for _ in range(rounds):
        y = binv.sum(0)
        value, config = _best_config(s, y, np.full(n, capacity), capacity)
        if value <= 1 + 1e-9:
            break
        direction = binv @ config
        pos = direction > 1e-10
        ratio = np.full(n, np.inf)
        ratio[pos] = x[pos] / direction[pos]
        out = int(np.argmin(ratio))
        step = ratio[out]
        x -= step * direction
        x[out] = step
        cols[:, out] = config
        pivot = binv[out] / direction[out]
        binv -= np.outer(direction, pivot)
        binv[out] = pivot
        x = np.maximum(x, 0)
    else:
        warnings.warn(f"configurations are not optimal after {rounds} rounds", RuntimeWarning, stacklevel=2)
    result, left = [], np.array(demand)
    for j in np.argsort(-x):
        times = int(math.floor(x[j] + 1e-9))
        config = cols[:, j].astype(int)
        if times:
            result.append((config.tolist(), times))
            left = np.maximum(left - times * config, 0)
    while left.any():
        _, config = _best_config(s, np.where(left > 0, s, 0).astype(float), left, capacity)
        on = config > 0
        times = int((left[on] // config[on]).min())
        result.append((config.tolist(), times))
        left = left - times * config
    return result


def slot_table(configs: list[tuple[list[int], int]], n_groups: int) -> tuple[pd.DataFrame, int]:
    """(group, start, per, base): the slots of a group from number start on lie `per` to a container, from container `base` on."""
    rows, base, used = [], 0, [0] * n_groups
    for config, times in configs:
        for g, per in enumerate(config):
            if per:
                rows.append((g, used[g], per, base))
                used[g] += per * times
        base += times
    return pd.DataFrame(rows, columns=["group", "start", "per", "base"]), base


def best_fit(items: dict[int, int], spaces: dict[int, int], capacity: int) -> tuple[pd.DataFrame, int]:
    """(size, start, space, at, n): of the small items of this size, those numbered start .. start + n - 1 go to the containers
    numbered at .. at + n - 1 among those that had this free space at first; space = -1 are new containers. Also the number of new ones.

    Works on runs of equal containers: the run with the least space that holds the size takes one item per
    container and becomes a run with less space.
    """
    free: dict[int, list[tuple[int, int, int]]] = {r: [(r, 0, n)] for r, n in spaces.items() if r > 0 and n > 0}
    order = sorted(free)
    volume = sum(s * n for s, n in items.items())
    rows, opened = [], 0
    for s in sorted(items, reverse=True):
        todo, start = items[s], 0
        while todo:
            k = bisect.bisect_left(order, s)
            if k == len(order):
                m = max(1, min(todo, volume // capacity))
                run = (-1, opened, opened + m)
                opened += m
                r = capacity
            else:
                r = order[k]
                run = free[r].pop()
                if not free[r]:
                    del free[r]
                    order.pop(k)
            origin, a, b = run
            n = min(todo, b - a)
            rows.append((s, start, origin, a, n))
            start, todo, volume = start + n, todo - n, volume - n * s
            for space, piece in ((r - s, (origin, a, a + n)), (r, (origin, a + n, b))):
                if space > 0 and piece[2] > piece[1]:
                    if space not in free:
                        free[space] = []
                        bisect.insort(order, space)
                    free[space].append(piece)
    return pd.DataFrame(rows, columns=["size", "start", "space", "at", "n"]), opened


# ------------------------------------------------------------------ operator


def pack(sizes: DataFrame, id_col: str, size_col: str, capacity: int, groups: int = GROUPS, small_share: float = SMALL_SHARE) -> DataFrame:
    """(id, part_no INT, start LONG, size LONG, container_id LONG): every item in a container.

    The sizes in a container add up to at most `capacity`. An item longer than the capacity is cut into parts of exactly the
    capacity and a rest (part_no 0, 1, ...; start is the offset in the item); all others have one part. Items without length
    (null, zero or negative size) are spread over the containers and take no space; if there are no containers they get container 0.
    ids must be unique; a null id is an id of its own. An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = sizes.sparkSession
    small = int(capacity * small_share)
    n = F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0))
    parts = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / F.lit(capacity)) - 1, F.lit(0)).cast("int")))
    items = sizes.select(F.col(id_col).alias("id"), n.alias("n"), parts.alias("part_no"))
    items = items.select("id", "part_no", (F.col("part_no").cast("long") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("part_no").cast("long") * capacity).alias("size"))
    items = materialise(items, "items")
    hist = {int(r["size"]): int(r["c"]) for r in items.groupBy("size").agg(F.count("*").alias("c")).collect()}  # at most capacity + 1 rows

    large = {s: c for s, c in hist.items() if s > small}
    grouped = linear_groups(large, groups)
    table, n_large = slot_table(configurations([g[1] for g in grouped], [g[2] for g in grouped], capacity), len(grouped))
    tops = np.array(sorted(g[1] for g in grouped))
    slots = {g: t.sort_values("start") for g, t in table.groupby("group")}
    plan = {g: tuple(t[c].to_numpy() for c in ("start", "per", "base")) for g, t in slots.items()}
    sent = spark.sparkContext.broadcast((tops, plan))
    n_groups = len(grouped)

    def to_group(batches):
        for b in batches:
            k = np.searchsorted(sent.value[0], b["size"].to_numpy())
            yield b.assign(grp=(n_groups - 1 - k).astype("int32"))

    def to_container(batches):
        for b in batches:
            grp, rank = b["grp"].to_numpy(), b["rank"].to_numpy()
            box = np.zeros(len(b), np.int64)
            for g in np.unique(grp):
                on = grp == g
                start, per, base = sent.value[1][int(g)]
                k = np.searchsorted(start, rank[on], side="right") - 1
                box[on] = base[k] + (rank[on] - start[k]) // per[k]
            yield b.drop(columns=["grp", "rank"]).assign(container_id=box)

    cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)
    big = items.where(F.col("size") > small).mapInPandas(to_group, f"{cols}, grp int")
    big = ranked_in_groups(big, "grp", ["id", "part_no"], rows=sum(large.values()))
    big = materialise(big.mapInPandas(to_container, f"{cols}, container_id long"), "large-items")

    fill = big.groupBy("container_id").agg((F.lit(capacity) - F.sum("size")).alias("space"))
    fill = materialise(fill, "free-space")
    spaces = {int(r["space"]): int(r["c"]) for r in fill.groupBy("space").agg(F.count("*").alias("c")).collect()}  # at most capacity + 1 rows
    few = {s: c for s, c in hist.items() if 0 < s <= small}
    moves, opened = best_fit(few, spaces, capacity)
    by_size = {s: tuple(t[c].to_numpy() for c in ("start", "space", "at")) for s, t in moves.groupby("size")}
    sent_moves = spark.sparkContext.broadcast(by_size)

    def to_place(batches):
        for b in batches:
            size, rank = b["size"].to_numpy(), b["rank"].to_numpy()
            space, at = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for s in np.unique(size):
                on = size == s
                start, sp, first = sent_moves.value[int(s)]
                k = np.searchsorted(start, rank[on], side="right") - 1
                space[on], at[on] = sp[k], first[k] + rank[on] - start[k]
            yield b.drop(columns=["rank"]).assign(space=space, at=at)

    out = ["id", "part_no", "start", "size", "container_id"]
    tiny = ranked_in_groups(items.where(f"size > 0 and size <= {small}"), "size", ["id", "part_no"], rows=sum(few.values()))
    tiny = tiny.mapInPandas(to_place, f"{cols}, space long, at long")
    used = ranked_in_groups(fill.where("space > 0"), "space", ["container_id"], "at", rows=sum(spaces.values()))
    placed = tiny.where("space >= 0").join(used, ["space", "at"]).select(out)
    fresh = tiny.where("space < 0").withColumn("container_id", F.col("at") + n_large).select(out)
    boxes = max(1, n_large + opened)
    none = items.where("size = 0").withColumn("container_id", F.pmod(F.xxhash64("id"), F.lit(boxes).cast("long")))
    result = big.select(out).unionByName(placed).unionByName(fresh).unionByName(none.select(out))
    return result.withColumnRenamed("id", id_col)
