"""Kept deliveries: weekly snapshots with retention, incremental state, project folders."""

from __future__ import annotations

import os
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark.session import list_dir, remove_path


def save_snapshot(df: DataFrame, root: str, name: str, on: date | None = None, keep: int = 5) -> str:
    """Writes df under root/name/iso_year=Y/iso_week=W, replacing an earlier write of the same week, and deletes all but the newest `keep` weeks."""
    year, week, _ = (on or date.today()).isocalendar()
    path = f"{root}/{name}/iso_year={year}/iso_week={week:02d}"
    df.write.mode("overwrite").parquet(path)
    prune_snapshots(df.sparkSession, root, name, keep)
    return path


def snapshot_weeks(spark: SparkSession, root: str, name: str) -> list[tuple[int, int]]:
    """(year, week) of the complete snapshots, oldest first."""
    out = []
    for y in list_dir(spark, f"{root}/{name}"):
        if y.startswith("iso_year="):
            for w in list_dir(spark, f"{root}/{name}/{y}"):
                if w.startswith("iso_week=") and "_SUCCESS" in list_dir(spark, f"{root}/{name}/{y}/{w}"):
                    out.append((int(y[9:]), int(w[9:])))
    return sorted(out)


def prune_snapshots(spark: SparkSession, root: str, name: str, keep: int) -> None:
    for y, w in snapshot_weeks(spark, root, name)[:-keep] if keep else []:
        remove_path(spark, f"{root}/{name}/iso_year={y}/iso_week={w:02d}")


def read_snapshots(spark: SparkSession, root: str, name: str, newest: int | None = None, weeks: list[tuple[int, int]] | None = None) -> DataFrame:
    """The newest snapshots, or those of the given weeks, one above the other with iso_year, iso_week and the tag "Y WW"; only their folders
    are read."""
    if weeks is None:
        weeks = snapshot_weeks(spark, root, name)
        weeks = weeks[-newest:] if newest else weeks
    paths = [f"{root}/{name}/iso_year={y}/iso_week={w:02d}" for y, w in weeks]
    df = spark.read.option("basePath", f"{root}/{name}").option("mergeSchema", True).parquet(*paths)
    return df.withColumn("snapshot", F.concat(F.col("iso_year").cast("string"), F.lit(" W"), F.lpad(F.col("iso_week").cast("string"), 2, "0")))


def retained(weeks: DataFrame, week: str, keep: int) -> DataFrame:
    """The newest `keep` distinct values of a delivery column: what retention leaves."""
    return weeks.select(week).where(F.col(week).isNotNull()).distinct().orderBy(F.desc(week)).limit(keep)


# The folders of a project.
PROJECT_FOLDERS = (
    "01_data/processed", "01_data/raw", "02_scripts", "03_outputs/3a_visualizations", "03_outputs/3b_tables",
    "03_outputs/3c_powerpoint_slides", "03_outputs/3d_model_outputs",
)


def init_folders(base: str) -> dict[str, str]:
    """Makes the folders of a project; says of each whether it was Created or Exists."""
    out = {}
    for f in PROJECT_FOLDERS:
        p = os.path.join(base, f)
        out[f] = "Exists" if os.path.isdir(p) else "Created"
        os.makedirs(p, exist_ok=True)
    return out
