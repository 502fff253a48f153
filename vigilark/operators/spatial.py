"""Points near points and points in regions: ear-clipped triangles in a bounding-volume hierarchy.

Regions are polygons in degrees; a search radius around a centre becomes a polygon that encloses the circle. Polygons are cut
into triangles by ear clipping, the triangles are put into a hierarchy of boxes, every point walks down the hierarchy
and is tested exactly against the triangles it reaches. What is found is then checked once more by the question's own
measure (great-circle distance, or nothing for containment) and every point and region is reported once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark.session import materialise

#: Mean earth radius in km.
EARTH_KM = 6371.0088
#: Triangles up to which one hierarchy is built on the driver and sent to every executor: 56 bytes each, 12 MB in all.
BROADCAST_TRIANGLES = 200_000
#: Triangles of the sample from which the upper hierarchy is cut when there are more.
SAMPLE_TRIANGLES = 100_000
LEAF = 8


# ---------------------------------------------------------------- ear clipping


def _cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


class BadRing(ValueError):
    """A ring that crosses itself, or a hole that is not inside its ring."""


def _area2(pts) -> float:
    """Twice the signed area, around the first point so that small rings far from the origin keep their digits."""
    x0, y0 = pts[0]
    return sum((a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0) for a, b in zip(pts, pts[1:] + pts[:1]))


def _clean(ring: Sequence[tuple[float, float]], left: bool) -> list[tuple[float, float]]:
    """The ring without repeated neighbours and closing vertex, turning left or right; empty if it has no area."""
    pts = [tuple(map(float, p)) for i, p in enumerate(ring) if i == 0 or tuple(p) != tuple(ring[i - 1])]
    if len(pts) > 1 and pts[0] == pts[-1]:
        pts.pop()
    if len(pts) < 3 or not any(_cross(pts[0], pts[1], p) for p in pts[2:]):
        return []
    return pts if (_area2(pts) > 0) == left else pts[::-1]


def _inside(p, pts) -> bool:
    odd = False
    for a, b in zip(pts, pts[1:] + pts[:1]):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            odd = not odd
    return odd


def _bridged(pts: list, hole: list) -> list:
    """One ring of both: from the hole's rightmost vertex to the nearest vertex of the ring it can see to its right."""
    k = max(range(len(hole)), key=lambda i: hole[i])
    m = hole[k]
    if not _inside(m, pts):
        raise BadRing("a hole is not inside its ring")
    # the first edge a ray to the right meets, then the vertex nearest in angle within the triangle of ray and edge
    at, best = None, math.inf
    for i, (a, b) in enumerate(zip(pts, pts[1:] + pts[:1])):
        if (a[1] <= m[1] <= b[1] or b[1] <= m[1] <= a[1]) and a[1] != b[1]:
            x = a[0] + (m[1] - a[1]) / (b[1] - a[1]) * (b[0] - a[0])
            if m[0] <= x < best:
                best, at = x, i if a[0] > b[0] else (i + 1) % len(pts)
    if at is None:
        raise BadRing("a hole is not inside its ring")
    p, hit = pts[at], (best, m[1])
    tri = (m, hit, p) if _cross(m, hit, p) >= 0 else (m, p, hit)
    inside = [i for i, q in enumerate(pts) if q != p and all(_cross(u, v, q) >= 0 for u, v in zip(tri, tri[1:] + tri[:1]))]
    if inside:
        at = min([*inside, at], key=lambda i: (abs(math.atan2(pts[i][1] - m[1], pts[i][0] - m[0])), math.dist(pts[i], m)))
    # where bridges met before, a vertex occurs several times: the bridge belongs to the corner it lies in
    def faces(i: int) -> bool:
        a, v, c = pts[i - 1], pts[i], pts[(i + 1) % len(pts)]
        sides = _cross(a, v, m) >= 0, _cross(v, c, m) >= 0
        return all(sides) if _cross(a, v, c) > 0 else any(sides)

    at = next((i for i, q in enumerate(pts) if q == pts[at] and faces(i)), at)
    return pts[: at + 1] + hole[k:] + hole[: k + 1] + pts[at:]


def ear_clip(ring: Sequence[tuple[float, float]], holes: Sequence[Sequence[tuple[float, float]]] = ()) -> list[tuple[tuple[float, float], ...]]:
    """Triangles of a simple polygon, perhaps with holes; a repeated closing vertex is dropped. Collinear vertices make no
    triangle. Fewer than three distinct vertices, or a ring without area, give none; a hole without area is no hole.

    Holes are joined to the ring by bridges. Only reflex vertices can spoil an ear; they are tested together. A ring that leaves no
    ear, or whose triangles don't have its area, crosses itself: BadRing. O(n r) for r reflex vertices.
    """
    pts = _clean(ring, True)
    if not pts:
        return []
    want = _area2(pts)
    inner = [h for h in (_clean(h, False) for h in holes) if h]
    for h in sorted(inner, key=max, reverse=True):
        want += _area2(h)
        pts = _bridged(pts, h)
    n = len(pts)
    xy = np.array(pts)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    before[0], after[-1] = n - 1, 0
    reflex = np.array([_cross(pts[i - 1], pts[i], pts[(i + 1) % n]) < 0 for i in range(n)])
    out, i, misses, left, loose = [], 0, 0, n, False
    while left > 3:
        a, b, c = pts[before[i]], pts[i], pts[after[i]]
        turn = _cross(a, b, c)
        ear = turn > 0
        if ear and reflex.any():
            q = xy[reflex]
            q = q[(q[:, 0] >= min(a[0], b[0], c[0])) & (q[:, 0] <= max(a[0], b[0], c[0])) & (q[:, 1] >= min(a[1], b[1], c[1])) & (q[:, 1] <= max(a[1], b[1], c[1]))]
            for p in map(tuple, q):
                if p not in (a, b, c):
                    sides = _cross(a, b, p), _cross(b, c, p), _cross(c, a, p)
                    # where nothing else is left, a vertex may touch the two edges that are cut off, but not the new one
                    if min(sides) >= 0 and not (loose and (sides[0] == 0 or sides[1] == 0) and sides[2] > 0):
                        ear = False
                        break
        if ear or turn == 0:  # a straight corner carries no area
            if ear:
                out.append((a, b, c))
            p, s = before[i], after[i]
            after[p], before[s], reflex[i] = s, p, False
            left -= 1
            for k in (p, s):
                reflex[k] = reflex[k] and _cross(pts[before[k]], pts[k], pts[after[k]]) < 0
            i, misses, loose = s, 0, False
        else:
            i, misses = after[i], misses + 1
            if misses > left:
                if loose:
                    raise BadRing("the ring crosses itself")
                loose, misses = True, 0
    last = (pts[before[i]], pts[i], pts[after[i]])
    if _cross(*last) > 0:
        out.append(last)
    got = sum(_cross(*t) for t in out)
    if not math.isclose(got, want, rel_tol=1e-7):
        raise BadRing("the ring crosses itself")
    return out


def circle_ring(lon: float, lat: float, km: float, corners: int = 12) -> list[list[tuple[float, float]]]:
    """Rings that enclose the circle of km around a point; two or three where it crosses the date line, a band where it holds a pole."""
    reach = math.degrees(km / EARTH_KM) * 1.02 / math.cos(math.pi / corners)
    if abs(lat) + reach >= 89.0:
        lo, hi = (max(-90.0, lat - reach), 90.0) if lat > 0 else (-90.0, min(90.0, lat + reach))
        return [[(-180.0, lo), (180.0, lo), (180.0, hi), (-180.0, hi)]]
    # the widest parallel the circle reaches keeps the polygon outside of it
    wide = 1 / math.cos(math.radians(min(89.5, abs(lat) + reach)))
    ring = []
    for k in range(corners):
        t = 2 * math.pi * k / corners
        ring.append((lon + reach * wide * math.cos(t), lat + reach * math.sin(t)))
    rings = [ring]
    if min(x for x, _ in ring) < -180:
        rings.append([(x + 360, y) for x, y in ring])
    if max(x for x, _ in ring) > 180:
        rings.append([(x - 360, y) for x, y in ring])
    return rings


# ---------------------------------------------------------------- hierarchy


class Boxes:
    """A hierarchy over boxes, as arrays: the leaves hold runs of boxes. The boxes are halved at the median of the longest side of
    their centres until LEAF or fewer remain. Any number of dimensions."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        """low, high: (n, dimensions)."""
        order, centre = np.arange(len(low)), (low + high) / 2
        lo, hi, kids, runs = [], [], [], []
        todo = [(0, len(low), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            k, sel = len(lo), order[a:b]
            lo.append(low[sel].min(0) if b > a else np.full(low.shape[1], np.inf))
            hi.append(high[sel].max(0) if b > a else np.full(low.shape[1], -np.inf))
            kids.append([-1, -1])
            runs.append((a, b))
            if parent >= 0:
                kids[parent][side] = k
            if b - a > LEAF:
                key = centre[sel][:, np.argmax(np.ptp(centre[sel], axis=0))]
                order[a:b] = sel[np.argsort(key, kind="stable")]
                mid = (a + b) // 2
                todo += [(a, mid, k, 0), (mid, b, k, 1)]
        self.lo, self.hi, self.kids, self.runs, self.order = np.array(lo), np.array(hi), np.array(kids), np.array(runs), order

    def walk(self, keep: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates (query, box) of n queries: from the root down, a query goes on below the nodes for which keep(query, node) holds."""
        query, node = np.arange(n), np.zeros(n, int)
        while len(query):
            on = keep(query, node)
            query, node = query[on], node[on]
            leaf = self.kids[node, 0] < 0
            if leaf.any():
                q, m = query[leaf], node[leaf]
                for k in range(LEAF):
                    t = self.runs[m, 0] + k
                    there = t < self.runs[m, 1]
                    if there.any():
                        yield q[there], self.order[t[there]]
            query, node = np.concatenate([query[~leaf], query[~leaf]]), np.concatenate([self.kids[node[~leaf], 0], self.kids[node[~leaf], 1]])

    def holding(self, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates (point, box) for points (n, dimensions) in leaves whose box holds them; the single boxes are not tested."""
        return self.walk(lambda q, m: ((at[q] >= self.lo[m]) & (at[q] <= self.hi[m])).all(1), len(at))

    def within(self, at: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates (point, box) in leaves no farther from a point than its reach."""
        return self.walk(lambda q, m: box_distance(at[q], self.lo[m], self.hi[m]) <= reach[q], len(at))


def box_distance(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return np.sqrt((np.maximum(0, np.maximum(lo - at, at - hi)) ** 2).sum(1))


def _joined(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not pairs:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([p for p, _ in pairs]), np.concatenate([o for _, o in pairs])


class Hierarchy:
    """Triangles in a hierarchy of their boxes."""

    def __init__(self, tri: np.ndarray, owner: np.ndarray):
        """tri: (n, 6) lon/lat of three corners; owner: (n,) index of the region."""
        xs, ys = tri[:, 0::2], tri[:, 1::2]
        self.boxes = Boxes(np.c_[xs.min(1), ys.min(1)], np.c_[xs.max(1), ys.max(1)]) if len(tri) else None
        self.tri, self.owner = tri, owner

    def find(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point index, owner) of all triangles that hold a point, borders included; a pair can occur twice."""
        got = []
        for p, t in self.boxes.holding(np.c_[x, y]) if self.boxes else ():
            hit = self._holds(self.tri[t], x[p], y[p])
            got.append((p[hit], self.owner[t[hit]]))
        return _joined(got)

    @staticmethod
    def _holds(t: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Exact sign tests on the three edges; the corners turn left, as ear_clip gives them."""
        side = lambda i, j: (t[:, j] - t[:, i]) * (y - t[:, i + 1]) - (t[:, j + 1] - t[:, i + 1]) * (x - t[:, i])
        return (side(0, 2) >= 0) & (side(2, 4) >= 0) & (side(4, 0) >= 0)


# ---------------------------------------------------------------- triangles of a table of regions


def triangulate(regions: DataFrame, region_id: str, make_rings: Callable[[pd.DataFrame], Iterator[tuple[object, list]]], id_type: str, bad: str = "raise") -> DataFrame:
    """(region, x1, y1, x2, y2, x3, y3): the triangles of every region. make_rings turns a batch into (region, polygons), a polygon being a
    ring and its holes. A bad ring raises BadRing, or with bad="skip" gives no triangles (see ring_problems)."""

    def run(batches):
        for b in batches:
            rows = []
            for r, polygons in make_rings(b):
                for ring, holes in polygons:
                    try:
                        rows += [(r, *[v for p in t for v in p]) for t in ear_clip(ring, holes)]
                    except BadRing as e:
                        if bad == "raise":
                            raise BadRing(f"region {r}: {e}") from e
            yield pd.DataFrame(rows, columns=["region", "x1", "y1", "x2", "y2", "x3", "y3"])

    return regions.mapInPandas(run, f"region {id_type}, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")


CORNERS = ["x1", "y1", "x2", "y2", "x3", "y3"]
#: Points one task of a cell takes, on average.
POINTS_PER_TASK = 200_000
#: Cells of an upper hierarchy; their boxes are held by the driver and every executor.
MAX_CELLS = 100_000


def _match(points: DataFrame, triangles: DataFrame, id_type: str, region_type: str, max_triangles: int) -> DataFrame:
    """(point_id, x, y, region): all pairs of a point and a region one of whose triangles holds it; pairs may repeat.

    Up to max_triangles (counted) one hierarchy goes to all executors and no point moves. Beyond, the triangles are written once with
    the cell of their centre; the cells are cut at the medians of a bounded sample, and a cell's box is the exact box of its triangles.
    Points walk a hierarchy over these boxes and are written once per cell they fall into; _in_cells joins them.
    """
    spark = points.sparkSession
    out = f"point_id {id_type}, x double, y double, region {region_type}"
    head = triangles.limit(max_triangles + 1).toPandas()
    if len(head) <= max_triangles:
        owner, names = pd.factorize(head["region"].to_numpy(object))
        sent = spark.sparkContext.broadcast((Hierarchy(head[CORNERS].to_numpy(float), owner), names))

        def run(batches):
            tree, ids = sent.value
            for b in batches:
                x, y = b["x"].to_numpy(float), b["y"].to_numpy(float)
                p, o = tree.find(x, y)
                yield pd.DataFrame({"point_id": b["point_id"].to_numpy()[p], "x": x[p], "y": y[p], "region": pd.Series(ids[o], dtype=object)})

        return points.mapInPandas(run, out)
    triangles = materialise(triangles, "triangles")
    mid = lambda t: np.c_[t[:, 0::2].mean(1), t[:, 1::2].mean(1)]
    placed = _placed(triangles, lambda b: mid(b[CORNERS].to_numpy(float)), max_triangles)
    lo, hi = ((F.least, F.min), (F.greatest, F.max))
    boxes = placed.groupBy("cell").agg(*[agg(pick(*[f"{v}{i}" for i in (1, 2, 3)])) for pick, agg in (lo, hi) for v in "xy"])
    routed = _route(points, boxes, 2, lambda b: b[["x", "y"]].to_numpy(float))

    def solve(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        tree = Hierarchy(t[CORNERS].to_numpy(float), np.arange(len(t)))
        x, y = p["x"].to_numpy(float), p["y"].to_numpy(float)
        i, o = tree.find(x, y)
        return pd.DataFrame({"point_id": p["point_id"].to_numpy()[i], "x": x[i], "y": y[i], "region": pd.Series(t["region"].to_numpy(object)[o], dtype=object)})

    return _in_cells(routed, placed, solve, out, max_triangles)


def _placed(items: DataFrame, centre: Callable[[pd.DataFrame], np.ndarray], most: int) -> DataFrame:
    """The items with the `cell` of their centre, written once: cells of about a quarter of `most` items each."""
    n = items.count()
    cells = min(MAX_CELLS, max(2, math.ceil(4 * n / most)))
    sample = items.sample(min(1.0, SAMPLE_TRIANGLES / max(n, 1)), seed=7).limit(2 * SAMPLE_TRIANGLES).toPandas()
    sent = items.sparkSession.sparkContext.broadcast(_kd_cuts(centre(sample), math.ceil(math.log2(cells))))

    def run(batches):
        for b in batches:
            yield b.assign(cell=_kd_cell(sent.value, centre(b)))

    return materialise(items.mapInPandas(run, _ddl(items) + ", cell int"), "placed")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _route(points: DataFrame, boxes: DataFrame, dimensions: int, at: Callable[[pd.DataFrame], np.ndarray], reach: str | None = None) -> DataFrame:
    """The points with each `cell` whose box (cell, lows, highs; one row per cell) holds them, or lies within their `reach`; written once."""
    b = boxes.toPandas().to_numpy(float)
    low, high = b[:, 1 : 1 + dimensions], b[:, 1 + dimensions :]
    sent = points.sparkSession.sparkContext.broadcast((b[:, 0].astype(int), low, high, Boxes(low, high) if len(b) else None))

    def run(batches):
        cells, lo, hi, tree = sent.value
        for p in batches:
            x = at(p)
            far = p[reach].to_numpy(float) if reach else None
            got = []
            for q, c in (tree.within(x, far) if reach else tree.holding(x)) if tree else ():
                on = box_distance(x[q], lo[c], hi[c]) <= far[q] if reach else ((x[q] >= lo[c]) & (x[q] <= hi[c])).all(1)
                got.append((q[on], c[on]))
            q, c = _joined(got)
            yield p.iloc[q].assign(cell=cells[c].astype("int32"))

    return materialise(points.mapInPandas(run, _ddl(points) + ", cell int"), "routed")


def _in_cells(routed: DataFrame, placed: DataFrame, solve: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], out: str, most: int) -> DataFrame:
    """solve(points, items) for the points and items of every cell. A cell with many points or many items is split both ways, so that no
    task holds more than about POINTS_PER_TASK points and `most` items: points are repeated per part of items and the other way
    round. The loads are a table of one row per cell."""
    np_, nt = (F.ceil(F.col(c) / k).cast("int") for c, k in (("n_points", POINTS_PER_TASK), ("n_items", most)))
    load = routed.groupBy("cell").agg(F.count("*").alias("n_points")).join(placed.groupBy("cell").agg(F.count("*").alias("n_items")), "cell")
    load = materialise(load.select("cell", np_.alias("p_parts"), nt.alias("t_parts")), "loads")  # at most 2 MAX_CELLS rows
    def parts(df: DataFrame, own: str, other: str) -> DataFrame:
        """df with its own part of the cell, by the hash of the row, once for each part of the other side."""
        n = load.select("cell", F.col(f"{own}_parts").alias("__own"), F.col(f"{other}_parts").alias("__other"))
        mine = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.col("__own").cast("long")).cast("int")
        return df.join(F.broadcast(n), "cell").withColumns({f"{own}_part": mine, f"{other}_part": F.explode(F.sequence(F.lit(0), F.col("__other") - 1))}).drop("__own", "__other")

    left, right = parts(routed, "p", "t"), parts(placed, "t", "p")
    keys = ["cell", "p_part", "t_part"]
    names = [x.split()[0] for x in out.split(", ")]

    def run(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        return solve(p, t) if len(p) and len(t) else pd.DataFrame({c: [] for c in names})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, out)


def _kd_cuts(centres: np.ndarray, depth: int) -> np.ndarray:
    """(2^depth - 1, 2): axis and place of every cut, in heap order, at the medians of the sample."""
    cuts = np.zeros((2**depth - 1, 2))
    sets = {0: centres}
    for k in range(len(cuts)):
        c = sets.pop(k)
        axis = int(np.argmax(np.ptp(c, axis=0))) if len(c) else 0
        at = float(np.median(c[:, axis])) if len(c) else 0.0
        cuts[k] = axis, at
        low = c[:, axis] <= at
        sets[2 * k + 1], sets[2 * k + 2] = c[low], c[~low]
    return cuts


def _kd_cell(cuts: np.ndarray, at: np.ndarray) -> np.ndarray:
    k = np.zeros(len(at), int)
    for _ in range(int(math.log2(len(cuts) + 1))):
        k = 2 * k + 1 + (at[np.arange(len(at)), cuts[k, 0].astype(int)] > cuts[k, 1])
    return (k - len(cuts)).astype("int32")


# ---------------------------------------------------------------- operators


def distance_km(lon1, lat1, lon2, lat2):
    """Great-circle distance as a column."""
    r = lambda c: F.radians(c)
    a = F.pow(F.sin((r(lat2) - r(lat1)) / 2), 2) + F.cos(r(lat1)) * F.cos(r(lat2)) * F.pow(F.sin((r(lon2) - r(lon1)) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def _valid(c_lon, c_lat):
    # NaN compares greater than everything, so it fails the upper bounds
    return c_lat.between(-90.0, 90.0) & c_lon.between(-180.0, 180.0)


def points_near_centres(
    points: DataFrame, point_id: str, lon: str, lat: str,
    centres: DataFrame, centre_id: str, centre_lon: str, centre_lat: str,
    km: float, max_triangles: int = BROADCAST_TRIANGLES,
) -> DataFrame:
    """(point_id, centre_id): every pair at most km apart on the sphere, each once.

    Points or centres with missing, NaN or out-of-range coordinates or without an id are near nothing. Repeated points and
    centres give the pair once. Empty tables give no rows. Further columns of either table are ignored.
    """
    id_type, c_type = dict(points.dtypes)[point_id], dict(centres.dtypes)[centre_id]
    p = points.select(F.col(point_id).alias("point_id"), F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y"))
    p = p.where(F.col("point_id").isNotNull() & _valid(F.col("x"), F.col("y")))
    c = centres.select(F.col(centre_id).alias("cid"), F.col(centre_lon).cast("double").alias("cx"), F.col(centre_lat).cast("double").alias("cy"))
    c = c.where(F.col("cid").isNotNull() & _valid(F.col("cx"), F.col("cy"))).distinct()
    # A region is one place of a centre; the exact check needs its coordinates, so they are part of the region's name.
    named = c.select("cid", "cx", "cy", F.concat_ws("|", F.hex(F.col("cx").cast("string")), F.hex(F.col("cy").cast("string")), F.col("cid").cast("string")).alias("region"))

    def rings(b: pd.DataFrame):
        for r, x, y in zip(b["region"], b["cx"], b["cy"]):
            yield r, [(ring, []) for ring in circle_ring(x, y, km)]

    tri = triangulate(named, "region", rings, "string")
    m = _match(p, tri, id_type, "string", max_triangles)
    part = F.split("region", r"\|", 3)
    num = lambda i: F.decode(F.unhex(part[i]), "UTF-8").cast("double")
    near = m.where(distance_km(F.col("x"), F.col("y"), num(0), num(1)) <= km)
    return near.select(F.col("point_id").alias(point_id), part[2].cast(c_type).alias(centre_id)).distinct()


def _polygon_rows(regions: DataFrame, region_id: str, ring: str, holes: str | None) -> DataFrame:
    """(region, xs, ys, hx, hy): coordinates as arrays; null rings left out, null holes none."""
    axis = lambda c, k: F.transform(c, lambda v: v[k])
    inner = lambda k: F.transform(F.coalesce(F.col(holes), F.array().cast(dict(regions.dtypes)[holes])), lambda h: axis(h, k)) if holes else F.array().cast("array<array<double>>")
    r = regions.where(F.col(region_id).isNotNull() & F.col(ring).isNotNull())
    return r.select(F.col(region_id).alias("region"), axis(F.col(ring), "lon").alias("xs"), axis(F.col(ring), "lat").alias("ys"), inner("lon").alias("hx"), inner("lat").alias("hy"))


def _polygons(b: pd.DataFrame) -> Iterator[tuple[object, list]]:
    for k, xs, ys, hx, hy in zip(b["region"], b["xs"], b["ys"], b["hx"], b["hy"]):
        yield k, [(list(zip(xs, ys)), [list(zip(u, v)) for u, v in zip(hx, hy)])]


def ring_problems(regions: DataFrame, region_id: str, ring: str, holes: str | None = None) -> DataFrame:
    """(region_id, problem): the rings that can't be cut into triangles: those that cross themselves and those with a hole outside. Rings
    without area are no problem, they hold nothing."""
    r_type = dict(regions.dtypes)[region_id]

    def run(batches):
        for b in batches:
            rows = []
            for k, polygons in _polygons(b):
                for outer, inner in polygons:
                    try:
                        ear_clip(outer, inner)
                    except BadRing as e:
                        rows.append((k, str(e)))
            yield pd.DataFrame(rows, columns=["region", "problem"])

    return _polygon_rows(regions, region_id, ring, holes).mapInPandas(run, f"region {r_type}, problem string").withColumnRenamed("region", region_id)


def regions_of_points(
    points: DataFrame, point_id: str, lon: str, lat: str,
    regions: DataFrame, region_id: str, ring: str, max_triangles: int = BROADCAST_TRIANGLES, holes: str | None = None, bad: str = "raise",
) -> DataFrame:
    """(point_id, region_id): the region that holds each point; a point on a shared border, or in overlapping
    regions, gets the smallest region id. Points outside all regions, with missing coordinates or without id give no row.

    `ring` is ARRAY<STRUCT<lon, lat>>, one simple ring per row; a region of several parts has several rows. `holes`, if given, is a
    column of an array of such rings; a point on the border of a hole is in the region. Null, short or flat rings hold nothing. A ring
    that crosses itself, or whose hole lies outside, raises BadRing; with bad="skip" it holds nothing and ring_problems tells of it.
    """
    id_type, r_type = dict(points.dtypes)[point_id], dict(regions.dtypes)[region_id]
    p = points.select(F.col(point_id).alias("point_id"), F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y"))
    p = p.where(F.col("point_id").isNotNull() & _valid(F.col("x"), F.col("y")))
    tri = triangulate(_polygon_rows(regions, region_id, ring, holes), "region", _polygons, r_type, bad)
    m = _match(p, tri, id_type, r_type, max_triangles)
    return m.groupBy(F.col("point_id").alias(point_id)).agg(F.min("region").alias(region_id))


#: Centres up to which one hierarchy is sent to every executor: 24 bytes each, and their names.
BROADCAST_CENTRES = 500_000


def _on_sphere(b: pd.DataFrame, lon: str, lat: str) -> np.ndarray:
    """Points of the unit sphere; their straight distance grows with the great-circle distance."""
    x, y = np.radians(b[lon].to_numpy(float)), np.radians(b[lat].to_numpy(float))
    return np.c_[np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)]


class Nearest:
    """Centres on the sphere in a hierarchy of boxes."""

    def __init__(self, at: np.ndarray):
        self.at, self.boxes = at, Boxes(at, at) if len(at) else None

    def find(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, centre, best): the nearest centres of every point no farther than its reach, ties and near ties all, and the distance of
        the nearest, else the reach."""
        best, slack = reach.astype(float), 1e-9
        if self.boxes is None:
            return np.zeros(0, int), np.zeros(0, int), best
        # a first bound: the leaf whose boxes are nearest on the way down
        node = np.zeros(len(x), int)
        while (inner := self.boxes.kids[node, 0] >= 0).any():
            k = self.boxes.kids[node]
            d = [box_distance(x, self.boxes.lo[k[:, s]], self.boxes.hi[k[:, s]]) for s in (0, 1)]
            node = np.where(inner, np.where(d[0] <= d[1], k[:, 0], k[:, 1]), node)
        for j in range(LEAF):
            t = self.boxes.runs[node, 0] + j
            on = t < self.boxes.runs[node, 1]
            best[on] = np.minimum(best[on], np.sqrt(((x[on] - self.at[self.boxes.order[t[on]]]) ** 2).sum(1)))
        got, far = [], best * (1 + slack) + slack
        for q, c in self.boxes.within(x, far):
            d = np.sqrt(((x[q] - self.at[c]) ** 2).sum(1))
            on = d <= far[q]
            np.minimum.at(best, q[on], d[on])
            got.append((q[on], c[on]))
        q, c = _joined(got)
        on = np.sqrt(((x[q] - self.at[c]) ** 2).sum(1)) <= best[q] * (1 + slack) + slack
        return q[on], c[on], best


def nearest_centres(
    points: DataFrame, point_id: str, lon: str, lat: str, centres: DataFrame, name: str, centre_lon: str, centre_lat: str, max_centres: int = BROADCAST_CENTRES,
) -> DataFrame:
    """(point_id, name, km): the centre nearest on the sphere to each point; of equally near ones the smaller name.

    Points or centres with missing, NaN or out-of-range coordinates, centres without a name and points without an id give no row; no centres give
    no rows. Up to max_centres (counted) one hierarchy goes to all executors. Beyond, centres lie in cells; a point first asks its own
    cell, then all cells that reach nearer than what it found there.
    """
    id_type = dict(points.dtypes)[point_id]
    p = points.select(F.col(point_id).alias("point_id"), F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y"))
    p = p.where(F.col("point_id").isNotNull() & _valid(F.col("x"), F.col("y")))
    c = centres.select(F.col(name).cast("string").alias("name"), F.col(centre_lon).cast("double").alias("cx"), F.col(centre_lat).cast("double").alias("cy"))
    c = c.where(F.col("name").isNotNull() & _valid(F.col("cx"), F.col("cy"))).distinct()
    out = f"point_id {id_type}, x double, y double, name string, cx double, cy double, reach double"
    fields = ["name", "cx", "cy"]

    def answer(b: pd.DataFrame, near: Nearest, t: pd.DataFrame) -> pd.DataFrame:
        reach = b["reach"].to_numpy(float) if "reach" in b else np.full(len(b), 2.1)
        q, k, best = near.find(_on_sphere(b, "x", "y"), reach)
        return pd.concat([b[["point_id", "x", "y"]].iloc[q].reset_index(drop=True), t[fields].iloc[k].reset_index(drop=True)], axis=1).assign(reach=best[q])

    head = c.limit(max_centres + 1).toPandas()
    if len(head) <= max_centres:
        sent = points.sparkSession.sparkContext.broadcast((Nearest(_on_sphere(head, "cx", "cy")), head))

        def run(batches):
            for b in batches:
                yield answer(b, *sent.value)

        found = p.mapInPandas(run, out)
    else:
        placed = _placed(c, lambda b: _on_sphere(b, "cx", "cy"), max_centres)
        rad = lambda k: F.radians(F.col(k))
        axes = (F.cos(rad("cy")) * F.cos(rad("cx")), F.cos(rad("cy")) * F.sin(rad("cx")), F.sin(rad("cy")))
        boxes = materialise(placed.groupBy("cell").agg(*[agg(a).alias(f"{n}{i}") for n, agg in (("lo", F.min), ("hi", F.max)) for i, a in enumerate(axes)]), "boxes")
        solve = lambda b, t: answer(b, Nearest(_on_sphere(t, "cx", "cy")), t)
        home = _home(p, boxes)
        first = materialise(_in_cells(home, placed, solve, out, max_centres), "nearest")
        # what the own cell, all of its parts, gave is the reach of the second question
        reach = first.groupBy("point_id", "x", "y").agg((F.min("reach") * (1 + 1e-9) + 1e-9).alias("reach"))
        found = _in_cells(_route(reach, boxes, 3, lambda b: _on_sphere(b, "x", "y"), "reach"), placed, solve, out, max_centres)
    km = distance_km(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"))
    best = F.min(F.struct(F.round(km, 9).alias("r"), F.col("name"), km.alias("km"))).alias("b")
    return found.groupBy("point_id", "x", "y").agg(best).select(F.col("point_id").alias(point_id), F.col("b.name").alias(name), F.col("b.km").alias("km"))


def _home(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """The points with the `cell` whose box is nearest."""
    b = boxes.toPandas().to_numpy(float)
    sent = points.sparkSession.sparkContext.broadcast((b[:, 0].astype(int), b[:, 1:4], b[:, 4:]))

    def run(batches):
        cells, lo, hi = sent.value
        tree = Boxes(lo, hi)
        for p in batches:
            x = _on_sphere(p, "x", "y")
            # the leaf of cells nearest on the way down, and the nearest of its cells
            node = np.zeros(len(x), int)
            while (inner := tree.kids[node, 0] >= 0).any():
                k = tree.kids[node]
                d = [box_distance(x, tree.lo[k[:, s]], tree.hi[k[:, s]]) for s in (0, 1)]
                node = np.where(inner, np.where(d[0] <= d[1], k[:, 0], k[:, 1]), node)
            best, cell = np.full(len(x), np.inf), np.zeros(len(x), int)
            for j in range(LEAF):
                t = tree.runs[node, 0] + j
                on = np.flatnonzero(t < tree.runs[node, 1])
                c = tree.order[t[on]]
                d = box_distance(x[on], lo[c], hi[c])
                nearer = d < best[on]
                best[on[nearer]], cell[on[nearer]] = d[nearer], c[nearer]
            yield p.assign(cell=cells[cell].astype("int32"))

    return materialise(points.mapInPandas(run, _ddl(points) + ", cell int"), "home")
