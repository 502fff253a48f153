"""Shapefiles: geometry from .shp, columns from the .dbf beside it.

Read by executors, one task per file (the format is one sequence of records); geometries become GeoJSON text, points also lon and lat.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator, Sequence
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark.session import list_dir

# Shape types of the format; 10 and 20 more for those with heights and measures, which are passed over.
POINT, LINE, POLYGON, MULTIPOINT = 1, 3, 5, 8
_SPARK_TYPES = {"C": "string", "N": "double", "F": "double", "L": "boolean", "D": "date"}


def _fields(head: bytes) -> list[tuple[str, str, int, int]]:
    """(name, type, length, decimals) of the columns of a .dbf header."""
    out, at = [], 32
    while at + 32 <= len(head) and head[at] != 0x0D:
        name = head[at : at + 11].split(b"\0")[0].decode("latin-1")
        out.append((name, chr(head[at + 11]), head[at + 16], head[at + 17]))
        at += 32
    return out


def _text(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _value(raw: bytes, kind: str):
    s = _text(raw).strip(" \0")
    if not s or set(s) == {"*"}:
        return None
    if kind in "NF":
        return float(s)
    if kind == "L":
        return {"T": True, "Y": True, "F": False, "N": False}.get(s.upper())
    if kind == "D":
        return date(int(s[:4]), int(s[4:6]), int(s[6:8])) if s.isdigit() and len(s) == 8 else None
    return s


def records(dbf: bytes) -> Iterator[tuple | None]:
    """Rows of a .dbf; None for a deleted one."""
    n, start, size = struct.unpack("<IHH", dbf[4:12])
    fields = _fields(dbf)
    for i in range(n):
        row = dbf[start + i * size : start + (i + 1) * size]
        at, out = 1, []
        for _, kind, length, _ in fields:
            out.append(_value(row[at : at + length], kind))
            at += length
        yield None if row[:1] == b"*" else tuple(out)


def _area2(ring: Sequence[Sequence[float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]]))


def _holds(ring: Sequence[Sequence[float]], p: Sequence[float]) -> bool:
    odd = False
    for a, b in zip(ring, [*ring[1:], ring[0]]):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            odd = not odd
    return odd


def _polygon(rings: list) -> dict:
    """Rings that turn right are outer ones; each other ring is a hole of the outer ring that holds it, else an outer one itself."""
    outer = [[r] for r in rings if _area2(r) <= 0]
    for r in rings:
        if _area2(r) > 0:
            home = next((o for o in outer if _holds(o[0], r[0])), None)
            home.append(r) if home else outer.append([r])
    return {"type": "Polygon", "coordinates": outer[0]} if len(outer) == 1 else {"type": "MultiPolygon", "coordinates": outer}


def geometries(shp: bytes) -> Iterator[dict | None]:
    """GeoJSON geometries of a .shp; None for null shapes."""
    at = 100
    while at + 8 <= len(shp):
        size = 2 * struct.unpack(">i", shp[at + 4 : at + 8])[0]
        c = shp[at + 8 : at + 8 + size]
        at += 8 + size
        kind = struct.unpack("<i", c[:4])[0] % 10
        if kind == POINT:
            yield {"type": "Point", "coordinates": list(struct.unpack("<2d", c[4:20]))}
        elif kind == MULTIPOINT:
            n = struct.unpack("<i", c[36:40])[0]
            xy = struct.unpack(f"<{2 * n}d", c[40 : 40 + 16 * n])
            yield {"type": "MultiPoint", "coordinates": [list(p) for p in zip(xy[::2], xy[1::2])]}
        elif kind in (LINE, POLYGON):
            parts, n = struct.unpack("<2i", c[36:44])
            starts = [*struct.unpack(f"<{parts}i", c[44 : 44 + 4 * parts]), n]
            xy = struct.unpack(f"<{2 * n}d", c[44 + 4 * parts : 44 + 4 * parts + 16 * n])
            points = [list(p) for p in zip(xy[::2], xy[1::2])]
            pieces = [points[a:b] for a, b in zip(starts, starts[1:]) if b > a]
            if kind == POLYGON:
                yield _polygon(pieces) if pieces else None
            else:
                yield {"type": "MultiLineString", "coordinates": pieces} if len(pieces) != 1 else {"type": "LineString", "coordinates": pieces[0]}
        else:
            yield None


def _head(spark: SparkSession, path: str, most: int = 1 << 16) -> bytes:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(conf).open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, most)))
    finally:
        stream.close()


def read_shp(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of a shapefile, or of all shapefiles of a folder with the columns of the first: the columns of the .dbf, geometry
    as GeoJSON text, and lon and lat of points. Deleted records are left out; a null shape has a null geometry."""
    path = path.rstrip("/")
    stems = [path[:-4]] if path.lower().endswith(".shp") else [f"{path}/{n[:-4]}" for n in list_dir(spark, path) if n.lower().endswith(".shp")]
    if not stems:
        raise ValueError(f"no shapefile under {path}")
    fields = [(n, _SPARK_TYPES.get(k, "string")) for n, k, _, _ in _fields(_head(spark, f"{stems[0]}.dbf"))]
    both = spark.read.format("binaryFile").load([f"{s}.{e}" for s in stems for e in ("shp", "dbf")])
    pairs = both.select(F.regexp_replace("path", r"\.(shp|dbf)$", "").alias("stem"), F.regexp_extract("path", r"\.(shp|dbf)$", 1).alias("kind"), "content")
    names = [n for n, _ in fields]

    def parse(pdf: pd.DataFrame) -> pd.DataFrame:
        content = dict(zip(pdf["kind"], pdf["content"]))
        own = [f[0] for f in _fields(content["dbf"])]
        rows = []
        for row, g in zip(records(content["dbf"]), geometries(content["shp"])):
            if row is not None:
                d = dict(zip(own, row))
                p = g["coordinates"] if g and g["type"] == "Point" else (None, None)
                rows.append([*[d.get(n) for n in names], json.dumps(g) if g else None, *p])
        return pd.DataFrame(rows, columns=[*names, "geometry", "lon", "lat"], dtype=object)

    schema = ", ".join([*[f"`{n}` {t}" for n, t in fields], "geometry string, lon double, lat double"])
    return pairs.groupBy("stem").applyInPandas(parse, schema)


def shapefile_bytes(rows: list[dict], columns: list[tuple[str, str]]) -> tuple[bytes, bytes, bytes]:
    """(.shp, .shx, .dbf) of rows with a GeoJSON `geometry` of one kind, points or polygons; columns are (name, Spark type), names cut to ten
    bytes as the format has it."""
    shapes, box = [], [float("inf"), float("inf"), float("-inf"), float("-inf")]
    kind = None
    for r in rows:
        g = json.loads(r["geometry"]) if r["geometry"] else None
        if g is None:
            shapes.append(struct.pack("<i", 0))
            continue
        if g["type"] not in ("Point", "Polygon", "MultiPolygon"):
            raise ValueError(f"shapefiles of {g['type']} are not written")
        own = POINT if g["type"] == "Point" else POLYGON
        if kind not in (None, own):
            raise ValueError("a shapefile holds geometries of one kind")
        kind = own
        polygons = [[[g["coordinates"]]]] if own == POINT else [g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"]
        rings = [ring if own == POINT or (_area2(ring) <= 0) == (i == 0) else ring[::-1] for p in polygons for i, ring in enumerate(p)]
        points = [p for ring in rings for p in ring]
        b = [min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points)]
        box = [min(box[0], b[0]), min(box[1], b[1]), max(box[2], b[2]), max(box[3], b[3])]
        if own == POINT:
            shapes.append(struct.pack("<i2d", POINT, *points[0]))
        else:
            starts, n = [], 0
            for ring in rings:
                starts.append(n)
                n += len(ring)
            shapes.append(struct.pack(f"<i4d2i{len(rings)}i", POLYGON, *b, len(rings), n, *starts) + b"".join(struct.pack("<2d", *p[:2]) for p in points))
    if kind is None:
        box = [0.0] * 4

    def headed(body: bytes) -> bytes:
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, kind or 0, *box, 0, 0, 0, 0) + body

    shp, shx, at = b"", [], 50
    out = []
    for i, s in enumerate(shapes):
        out.append(struct.pack(">2i", i + 1, len(s) // 2) + s)
        shx.append(struct.pack(">2i", at, len(s) // 2))
        at += 4 + len(s) // 2
    shp = headed(b"".join(out))
    cells, widths = [], []
    for name, t in columns:
        k = "L" if t == "boolean" else "D" if t == "date" else "N" if t in ("int", "bigint", "double", "float", "smallint", "tinyint") else "C"
        texts = []
        for r in rows:
            v = r[name]
            texts.append(b"" if v is None else ("T" if v else "F").encode() if k == "L" else v.strftime("%Y%m%d").encode() if k == "D" else str(v).encode()[:254])
        cells.append((k, texts))
        widths.append(1 if k == "L" else 8 if k == "D" else max([1, *map(len, texts)]))
    head = b"".join(n.encode()[:10].ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([w, 0]) + b"\0" * 14 for (n, _), (k, _), w in zip(columns, cells, widths))
    size = 1 + sum(widths)
    dbf = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 33 + len(head), size) + head + b"\r"
    dbf += b"".join(b" " + b"".join((x[i].rjust(w) if k == "N" else x[i].ljust(w)) for (k, x), w in zip(cells, widths)) for i in range(len(rows))) + b"\x1a"
    return shp, headed(b"".join(shx)), dbf
