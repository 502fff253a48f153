"""Reading and writing files by extension."""

from __future__ import annotations

import csv
import os
import re
import urllib.request

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilark.plans.joins import fits
from vigilark.session import list_dir, remove_path, scratch_path
from vigilark.sources.shapefile import read_shp, shapefile_bytes

READABLE = ("csv", "tsv", "txt", "csvy", "xlsx", "dta", "sas7bdat", "xpt", "sav", "parquet", "json", "geojson", "orc", "jsonl", "avro", "shp")
WRITABLE = ("csv", "tsv", "xlsx", "dta", "parquet", "json", "geojson", "orc", "jsonl", "shp")

# Type names in the header of csvy files.
_CSVY_TYPES = {"integer": T.LongType(), "number": T.DoubleType(), "numeric": T.DoubleType(), "string": T.StringType(), "character": T.StringType(), "boolean": T.BooleanType(), "logical": T.BooleanType(), "date": T.DateType(), "factor": T.StringType()}


def _extension(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()


def _first_lines(spark: SparkSession, path: str, n: int = 200) -> list[str]:
    return [r.value for r in spark.read.text(path).limit(n).collect()]


def sniff_separator(line: str) -> str:
    """The separator of a header line: tab, semicolon, comma, bar or space, whichever cuts it into most fields outside quotes."""
    counts = {s: len(next(csv.reader([line], delimiter=s, quotechar='"'))) for s in "\t;,| "}
    return max(counts, key=lambda s: (counts[s], "\t;,| ".index(s) * -1))


def _read_delimited(spark: SparkSession, path: str, sep: str, **options) -> DataFrame:
    opts = {"header": True, "inferSchema": True, "sep": sep, "quote": '"', "escape": '"', "nullValue": "", "multiLine": False, "ignoreTrailingWhiteSpace": False, "ignoreLeadingWhiteSpace": False} | options
    return spark.read.options(**opts).csv(path)


def _read_csvy(spark: SparkSession, path: str, **options) -> DataFrame:
    """CSV under a commented block that names fields and types. The block is read from the first lines, the data by Spark."""
    head = [x for x in _first_lines(spark, path) if x.startswith("#")]
    fields, name = [], None
    for line in head:
        if m := re.search(r"name:\s*['\"]?([^'\"]+?)['\"]?\s*$", line):
            name = m[1]
        elif (m := re.search(r"type:\s*['\"]?(\w+)", line)) and name:
            fields.append(T.StructField(name, _CSVY_TYPES.get(m[1].lower(), T.StringType())))
            name = None
    opts = {"header": True, "comment": "#", "sep": options.pop("sep", ",")} | options
    reader = spark.read.options(**opts)
    return reader.schema(T.StructType(fields)).csv(path) if fields else reader.option("inferSchema", True).csv(path)


def _read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature: its properties as columns and its geometry as GeoJSON text, points also as lon and lat."""
    parts = any(n.startswith("part-") for n in list_dir(spark, path))  # a folder of features, one in each line
    raw = spark.read.option("multiLine", not parts).json(path)
    if "features" in raw.columns:
        f = raw.select(F.explode("features").alias("f")).select("f.*")
    elif {"geometry", "properties"} <= set(raw.columns):
        f = raw
    else:
        return raw
    props = [F.col(f"properties.`{c.name}`").alias(c.name) for c in f.schema["properties"].dataType.fields] if "properties" in f.columns and isinstance(f.schema["properties"].dataType, T.StructType) else []
    out = f.select(*props, F.to_json("geometry").alias("geometry"), F.col("geometry.type").alias("__t"), F.col("geometry.coordinates").alias("__c"))
    if isinstance(out.schema["__c"].dataType, T.ArrayType) and isinstance(out.schema["__c"].dataType.elementType, T.NumericType):
        point = F.col("__t") == "Point"
        out = out.withColumns({"lon": F.when(point, F.col("__c")[0].cast("double")), "lat": F.when(point, F.col("__c")[1].cast("double"))})
    return out.drop("__t", "__c")


def _fetched(spark: SparkSession, url: str) -> str:
    """The file behind a URL, copied piece by piece into the shared folder, where executors can read it."""
    path = f"{scratch_path(spark, 'download')}/{os.path.basename(url.split('?')[0]) or 'download'}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(conf).create(p, True)
    try:
        with urllib.request.urlopen(url) as source:  # noqa: S310
            while piece := source.read(1 << 20):
                out.write(bytearray(piece))
    finally:
        out.close()
    return path


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file on any file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(conf).create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """A table from a file or folder, by extension; http(s) paths are copied to the shared folder first.

    csv, tsv, txt (separator found from the first line), csvy, json, geojson, jsonl, parquet, orc, avro by Spark, shp by sources.shapefile; dta, sas7bdat, xpt, xlsx and sav by pandas
    where its readers are installed. Types of delimited files are inferred unless a schema is given as an option.
    """
    if re.match(r"^https?://", path):
        path = _fetched(spark, path)
    ext = _extension(path)
    if ext == "csv":
        return _read_delimited(spark, path, options.pop("sep", ","), **options)
    if ext == "tsv":
        return _read_delimited(spark, path, "\t", **options)
    if ext == "txt":
        first = _first_lines(spark, path, 1)
        return _read_delimited(spark, path, options.pop("sep", None) or (sniff_separator(first[0]) if first else ","), **options)
    if ext == "csvy":
        return _read_csvy(spark, path, **options)
    if ext == "geojson":
        return _read_geojson(spark, path)
    if ext == "json":
        return _read_geojson(spark, path)
    if ext == "jsonl":
        return spark.read.json(path, **options)
    if ext in ("parquet", "orc"):
        return spark.read.format(ext).options(**options).load(path)
    if ext == "shp":
        return read_shp(spark, path)
    if ext == "avro":
        return spark.read.format("avro").options(**options).load(path)
    reader = {"dta": "read_stata", "sas7bdat": "read_sas", "xpt": "read_sas", "xlsx": "read_excel", "sav": "read_spss"}.get(ext)
    if reader:
        try:
            return spark.createDataFrame(getattr(pd, reader)(path, **options))
        except ImportError as e:
            raise ImportError(f"reading .{ext} files needs an extra package: {e}") from e
    raise ValueError(f"File format '{ext}' not supported. Please use one of: {', '.join(READABLE)}.")


#: Rows and bytes that may go into one file or through the driver.
SINGLE_ROWS, SINGLE_BYTES = 2_000_000, 256 << 20


def _small(df: DataFrame, path: str) -> DataFrame:
    """df, if it may become one file; it is counted."""
    if not fits(df, SINGLE_ROWS, SINGLE_BYTES):
        raise ValueError(f"too many rows for the single file {path}; save with single=False")
    return df


def _one_file(df: DataFrame, path: str, fmt: str, **options) -> None:
    """Writes through a folder beside the target and moves its one part there; only for results meant to be one file, which are counted."""
    spark = _small(df, path).sparkSession
    folder = f"{path}.parts"
    df.coalesce(1).write.mode("overwrite").format(fmt).options(**options).save(folder)
    part = next(n for n in list_dir(spark, folder) if n.startswith("part-"))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    src, dst = jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}"), jvm.org.apache.hadoop.fs.Path(path)
    fs = dst.getFileSystem(conf)
    fs.delete(dst, True)
    fs.rename(src, dst)
    remove_path(spark, folder)


def save(df: DataFrame, path: str, single: bool = False, **options) -> None:
    """Writes a table by extension. Delimited and JSON formats give a folder of parts written in parallel, or with single=True one file, which
    is refused beyond SINGLE_ROWS or SINGLE_BYTES; parquet and orc are always folders, dta and xlsx always single files. geojson needs lon and lat, or a geometry column of GeoJSON text. dta and xlsx go through pandas."""
    ext = _extension(path)
    if ext in ("csv", "tsv"):
        opts = {"header": True, "sep": "," if ext == "csv" else "\t", "escape": '"', "ignoreTrailingWhiteSpace": False, "ignoreLeadingWhiteSpace": False} | options
        return _one_file(df, path, "csv", **opts) if single else df.write.mode("overwrite").options(**opts).csv(path)
    if ext in ("parquet", "orc"):
        return df.write.mode("overwrite").format(ext).options(**({"compression": "zstd"} | options)).save(path)
    if ext == "jsonl":
        return _one_file(df, path, "json", **options) if single else df.write.mode("overwrite").json(path)
    if ext in ("geojson", "json"):
        if "geometry" in df.columns:
            geo, props = F.col("geometry"), [c for c in df.columns if c not in ("geometry", "lon", "lat")]
        elif {"lon", "lat"} <= set(df.columns):
            geo, props = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))), [c for c in df.columns if c not in ("lon", "lat")]
        else:
            raise ValueError("geojson needs a geometry column or lon and lat")
        feature = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*[F.col(f"`{c}`") for c in props]), {"ignoreNullFields": "false"}), F.lit(',"geometry":'), F.coalesce(geo, F.lit("null")), F.lit("}"))
        lines = df.select(feature.alias("value"))
        if not single:
            return lines.write.mode("overwrite").text(path)
        rows = [r.value for r in _small(lines, path).toLocalIterator()]
        with open(path, "w", encoding="utf-8") as f:
            f.write('{"type":"FeatureCollection","features":[' + ",".join(rows) + "]}")
        return None
    if ext == "shp":
        if "geometry" not in df.columns and {"lon", "lat"} <= set(df.columns):
            df = df.withColumn("geometry", F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))))).drop("lon", "lat")
        rows = [r.asDict() for r in _small(df, path).collect()]
        parts = shapefile_bytes(rows, [(c, t) for c, t in df.dtypes if c not in ("geometry", "lon", "lat")])
        for kind, content in zip(("shp", "shx", "dbf"), parts):
            write_bytes(df.sparkSession, f"{path[:-4]}.{kind}", content)
        return None
    if ext == "dta":
        return _small(df, path).toPandas().to_stata(path, write_index=False, **options)
    if ext == "xlsx":
        try:
            return _small(df, path).toPandas().to_excel(path, index=False, **options)
        except ImportError as e:
            raise ImportError(f"writing .xlsx files needs an extra package: {e}") from e
    raise ValueError(f"File format '{ext}' not supported. Please use one of: {', '.join(WRITABLE)}.")


def read_all(spark: SparkSession, folder: str, table: str, url: str | None = None, **options) -> DataFrame:
    """The same table from every database or sub-folder of a folder, rows tagged with `source`.

    With url, a JDBC URL with {file} in it, each .mdb or .accdb file is read by a JDBC driver on the class path; without, sub-folders hold <table>.parquet. Sources
    without the table are passed over.
    """
    out = None
    for name in list_dir(spark, folder):
        if url is not None:
            if _extension(name) not in ("mdb", "accdb"):
                continue
            df = spark.read.format("jdbc").options(url=url.format(file=f"{folder}/{name}"), dbtable=table, **options).load()
        else:
            if f"{table}.parquet" not in list_dir(spark, f"{folder}/{name}"):
                continue
            df = spark.read.parquet(f"{folder}/{name}/{table}.parquet")
        df = df.withColumn("source", F.lit(os.path.splitext(name)[0]))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no source in {folder} has the table {table}")
    return out
