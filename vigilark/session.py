"""Session helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target


def build_session(app: str = "vigilark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, adaptive execution, Arrow."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a fresh local folder only where it is unset and the
    master is a local one (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    where = os.path.join(tempfile.gettempdir(), f"vigilark-{uuid.uuid4().hex}")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def collect_bounded(df: DataFrame, most: int, what: str) -> list:
    """The rows of a table that must be small; more than `most` raise an error, none is left out."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


#: Scratch paths of this process with the file systems they are on.
_scratch: dict[str, tuple] = {}


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder. It is deleted by clear_scratch, at the latest when the process ends: until then results may
    be read from it."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not _scratch:
        atexit.register(_clear_at_exit)
    _scratch[path] = (p.getFileSystem(conf), p)
    return path


def clear_scratch(spark: SparkSession | None = None) -> None:
    """Deletes what this process wrote under the shared folder; results that were not written elsewhere can't be read after it."""
    while _scratch:
        fs, p = _scratch.popitem()[1]
        fs.delete(p, True)


def _clear_at_exit() -> None:
    try:
        clear_scratch()
    except Exception:  # noqa: BLE001 - the JVM is gone already: nothing can be done from here
        pass


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: 8 and the length of each text, 8 for each number, nested values by their JSON text."""
    total = F.lit(8)
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + 8 + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + 16 + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            total = total + 8
    return total


def materialise(df: DataFrame, what: str = "stage") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives the loss of executors. Rows and bytes of flat tables are counted on
    the way (tasks that ran twice count twice, so these are upper bounds)."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    seen = Observation()
    flat = not any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for f in df.schema)  # measuring nested values costs too much
    (df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(row_bytes(df)).alias("size")) if flat else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if not flat:
        return out
    try:
        got = seen._jo.getOrEmpty()  # never waits for a plan that was optimised away
        out._size = (got.apply("n"), got.apply("size") or 0) if got.size() else None
    except (AttributeError, Py4JError):
        out._size = None
    return out


def materialise_all(*tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """materialise for several tables that don't need each other, at once."""
    with ThreadPoolExecutor(len(tables)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(tables[0][0].sparkSession)(materialise), df, what) for df, what in tables]]


def known_size(df: DataFrame) -> tuple[int, int] | None:
    """Rows and bytes that df has at most, where they are known."""
    return getattr(df, "_size", None)


def bounded_by(df: DataFrame, other: DataFrame) -> DataFrame:
    """df, noted to have no more rows and bytes than `other`."""
    df._size = known_size(other)
    return df


def list_dir(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system Spark knows, sorted; none if it is missing."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def publish(spark: SparkSession, text: str, path: str) -> bool:
    """Makes a small file with the given text appear under path at once, or not at all; False if path exists. Of several that publish
    one path exactly one gets True: a link on local disks, a move that never overwrites elsewhere. The file system must move files
    atomically, as HDFS does; object stores that copy do not."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hidden, name = os.path.split(path)
    draft = f"{hidden}/_{name}-{uuid.uuid4().hex}"
    src, dst = jvm.org.apache.hadoop.fs.Path(draft), jvm.org.apache.hadoop.fs.Path(path)
    fs = src.getFileSystem(conf)
    out = fs.create(src, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(src.toUri().getPath(), dst.toUri().getPath())
        else:
            gateway = spark.sparkContext._gateway
            never = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(src, dst, never)
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception):
            raise
        return False
    finally:
        fs.delete(src, False)
    return True


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(conf).open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def remove_path(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def move_path(spark: SparkSession, source: str, target: str) -> None:
    """Moves a folder; what is at the target is replaced."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    src, dst = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = dst.getFileSystem(conf)
    fs.delete(dst, True)
    fs.mkdirs(dst.getParent())
    if not fs.rename(src, dst):
        raise OSError(f"cannot move {source} to {target}")


def touch(spark: SparkSession, path: str) -> None:
    """Makes an empty file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).create(p, True).close()
