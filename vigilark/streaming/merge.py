"""Streams into kept tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilark.operators.merge import merge_latest
from vigilark.session import list_dir, materialise, move_path, remove_path, scratch_path, touch


class VersionedTable:
    """A table of numbered versions under a path; a version counts once its _SUCCESS mark is there. The batch number of a stream is the
    version, so a batch that is repeated after a failure writes the same version again and is not applied twice."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 3):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def versions(self) -> list[int]:
        names = [n for n in list_dir(self.spark, self.path) if n.startswith("v=")]
        return sorted(int(n[2:]) for n in names if "_SUCCESS" in list_dir(self.spark, f"{self.path}/{n}"))

    def read(self, before: int | None = None) -> DataFrame | None:
        have = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.path}/v={have[-1]}") if have else None

    def next(self) -> int:
        """The number after the newest version."""
        return max(self.versions(), default=-1) + 1

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        self._prune()

    def finish(self, version: int) -> None:
        """Marks a version that was moved here as complete."""
        touch(self.spark, f"{self.path}/v={version}/_SUCCESS")
        self._prune()

    def _prune(self) -> None:
        for v in self.versions()[: -self.keep]:
            remove_path(self.spark, f"{self.path}/v={v}")


class BucketedTable:
    """A table of rows by key, in buckets by the hash of the key; each bucket has versions of its own under bucket=B/v=N. A write
    touches only the buckets it has rows for. A version counts once its _SUCCESS mark is there; the newest one before a number is
    read, so a batch that is repeated after a failure sees what its first try saw."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64, keep: int = 3):
        self.spark, self.path, self.keys, self.buckets, self.keep = spark, path.rstrip("/"), list(keys), buckets, keep

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _table(self, b: int) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.path}/bucket={b}", self.keep)

    def read(self, before: int | None = None, only: Sequence[int] | None = None) -> DataFrame | None:
        """The rows, or those of some buckets; None if there are none. Buckets may differ in their columns."""
        paths = []
        for b in range(self.buckets) if only is None else only:
            t = self._table(b)
            have = [v for v in t.versions() if before is None or v < before]
            paths += [f"{t.path}/v={have[-1]}"] if have else []
        return self.spark.read.option("mergeSchema", True).parquet(*paths) if paths else None

    def merge(self, batch: DataFrame, order: str, version: int) -> None:
        """Keeps of each key the row with the latest `order` of table and batch: one pass over the batch and the buckets it touches."""
        name = "__bucket"
        batch = materialise(batch.withColumn(name, self.bucket()), "batch")
        touched = sorted(r[0] for r in batch.select(name).distinct().collect())  # at most `buckets` numbers
        if not touched:
            return
        state = self.read(before=version, only=touched)
        state = state.withColumn(name, self.bucket()) if state is not None else None
        merged = merge_latest(state, batch, [name, *self.keys], order)
        draft = scratch_path(self.spark, "buckets")
        merged.write.partitionBy(name).parquet(draft)
        for b in touched:
            t = self._table(b)
            move_path(self.spark, f"{draft}/{name}={b}", f"{t.path}/v={version}")
            t.finish(version)
        remove_path(self.spark, draft)


def merge_stream(stream: DataFrame, table: VersionedTable | BucketedTable, keys: Sequence[str], order: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keeps of each key the row with the latest `order`, batch by batch. A BucketedTable is rewritten only where a batch has rows; a
    VersionedTable, for small states, as a whole."""

    def apply(batch: DataFrame, n: int) -> None:
        if isinstance(table, BucketedTable):
            table.merge(batch, order, n)
        else:
            table.write(merge_latest(table.read(before=n), batch, keys, order), n)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def dedup_pages(stream: DataFrame, keys: Sequence[str], time: str, delay: str = "1 day") -> DataFrame:
    """Rows delivered again within the delay are dropped; state is kept only that long."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(stream: DataFrame, time: str, window: str, by: Sequence[str] = (), delay: str | None = "1 day", slide: str | None = None) -> DataFrame:
    """Rows per window and group; rows later than the delay are left out. delay=None for a stream that has a watermark already."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    g = (stream.withWatermark(time, delay) if delay else stream).groupBy(w, *by).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n")


def gap_sessions(df: DataFrame, time: str, gap: str, by: Sequence[str] = ()) -> DataFrame:
    """Sessions of rows at most `gap` apart: a chain, unlike rounds, whose days all lie within the threshold of each other."""
    s = F.session_window(time, gap)
    src = df.withWatermark(time, gap) if df.isStreaming else df
    g = src.groupBy(s, *by).agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *by, "n")


def changed_rows(table: VersionedTable, since: int, keys: Sequence[str], on_change: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows of the newest version that are not in version `since`."""
    new, old = table.read(), table.read(before=since + 1)
    out = new if old is None else new.exceptAll(old.select(*new.columns))
    return on_change(out) if on_change else out
