"""Validation of tables of records with places, dates and coordinates: flags, scorecards, issues.

All checks of a table are columns of one projection; the dimension is attached by counted broadcast joins. Scorecard and
issue list are both read off these flags: one aggregation, one explode.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilark.functions.fmt import big_mark
from vigilark.operators.coords import FLAG, HEADING, Rings, check_coords
from vigilark.operators.dates import DATE_ORDERS, TIME_ORDERS, date_flags, iso_text, trained_orders, with_trained
from vigilark.plans.joins import join_dimension, row_id
from vigilark.plans.rows import canonical_text
from vigilark.session import bounded_by, materialise
from vigilark.sources.snapshots import read_snapshots, snapshot_weeks

# ------------------------------------------------------------------ single checks


def check_missing(df: DataFrame, columns: Sequence[str] | None = None, key_columns: Sequence[str] = (), group_by: Sequence[str] = (), types: bool = False) -> DataFrame:
    """(groups..., column_name, missing_count, missing_percent, priority, completely_null): one row per column and group, from one
    aggregation. priority is High for key columns, Standard for others, null if there are no key columns. An empty table
    without groups has counts of 0 and null percents. types=True adds data_type, the type of the column."""
    cols = [c for c in (columns or df.columns) if c not in group_by]
    unknown = [c for c in (*cols, *group_by) if c not in df.columns]
    if unknown:
        raise ValueError(f"The column '{unknown[0]}' is not present in the dataframe.")
    agg = [F.count("*").alias("__n")] + [F.count_if(F.col(f"`{c}`").isNull()).alias(f"__{i}") for i, c in enumerate(cols)]
    g = df.groupBy(*[F.col(f"`{c}`") for c in group_by]).agg(*agg)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"__{i}").alias("k"), F.lit(i).alias("o")) for i, c in enumerate(cols)])).alias("r")
    pct = F.round(F.try_divide(100.0 * F.col("r.k"), F.col("__n")), 2)
    priority = F.when(F.col("r.c").isin(list(key_columns)), "High").otherwise("Standard") if key_columns else F.lit(None).cast("string")
    return g.select(*[F.col(f"`{c}`") for c in group_by], "__n", rows).select(
        *[F.col(f"`{c}`") for c in group_by], F.col("r.c").alias("column_name"), F.col("r.k").alias("missing_count"), pct.alias("missing_percent"),
        priority.alias("priority"), (pct == 100).alias("completely_null"), *([_type_of(df, cols).alias("data_type")] if types else []),
    )


def _type_of(df: DataFrame, columns: Sequence[str]) -> Column:
    kinds = dict(df.dtypes)
    return F.element_at(F.array(*[F.lit(kinds[c]) for c in columns]), F.col("r.o") + 1)


def missing_ids(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """Ids of the rows where column is null."""
    for c in (id_col, column):
        if c not in df.columns:
            raise ValueError(f"The column '{c}' is not present in the dataframe.")
    return df.where(F.col(f"`{column}`").isNull()).select(F.col(f"`{id_col}`"))


def admin_hierarchy(df: DataFrame, combos: Sequence[Sequence[str]], true_hierarchy: bool = False) -> DataFrame:
    """(combination, total_rows, unique_rows, non_unique, proportion): per combination of columns the distinct rows.

    The reference counts after removing duplicates, so its non_unique is always 0 and its proportion 100; that is the default.
    true_hierarchy=True counts what is meant: lowest-level values found under more than one parent, and their share.
    """
    out = None
    for combo in combos:
        rows = df.select(*[F.col(f"`{c}`") for c in combo]).distinct()
        label = F.lit(" ~ ".join(combo)).alias("combination")
        if true_hierarchy:
            child, parents = combo[-1], [F.coalesce(F.col(f"`{c}`"), F.lit("\u0001")) for c in combo[:-1]]
            g = rows.where(F.col(f"`{child}`").isNotNull()).groupBy(F.col(f"`{child}`")).agg(F.count_distinct(F.struct(*parents)).alias("p"))
            one = g.agg(label, F.coalesce(F.sum("p"), F.lit(0)).alias("total_rows"), F.count("*").alias("unique_rows"), F.count_if(F.col("p") > 1).alias("non_unique"), F.round(F.try_divide(100.0 * F.count_if(F.col("p") == 1), F.count("*")), 2).alias("proportion"))
        else:
            one = rows.agg(label, F.count("*").alias("total_rows"), F.count("*").alias("unique_rows"), F.lit(0).cast("long").alias("non_unique"), F.when(F.count("*") > 0, 100.0).alias("proportion"))
        out = one if out is None else out.unionByName(one)
    return out


def non_unique_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of groups of more than one row with equal values in all given columns, null equal to null. Groups are counted map-side; the
    repeated ones meet their rows by a join, so that no task holds a whole group."""
    key = canonical_text(columns).alias("__k")
    many = df.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").select("__k")
    return join_dimension(df.withColumn("__k", canonical_text(columns)), many, ["__k"], "left_semi", spread=row_id(df)).drop("__k")


def mismatches(df: DataFrame, dim: DataFrame, id_col: str, pairs: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(summary, detail) of values that the dimension does not have.

    pairs: data column -> dimension column. Rows are first made distinct over id and all these columns. detail: (id, column_name,
    value); summary: (column_name, missing). Nulls are left out on both sides. Both sides become (column, value) rows and meet in one anti-join.
    """
    if len(set(pairs.values())) != len(pairs):
        raise ValueError("The number of name columns must match, and ID columns must match except for ADM0_GUID.")

    def long(d: DataFrame, cols: Sequence[tuple[str, str]], keep: Sequence[Column]) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(k).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for k, c in cols])
        return d.select(*keep, F.explode(cells).alias("x")).select(*[F.col(n) for n in ([id_col] if keep else [])], "x.column_name", "x.value").where("value is not null")

    rows = df.select(F.col(f"`{id_col}`"), *[F.col(f"`{c}`") for c in pairs]).distinct()
    left = long(rows, [(c, c) for c in pairs], [F.col(f"`{id_col}`")])
    right = long(dim, list(pairs.items()), []).distinct()
    detail = join_dimension(left, right, ["column_name", "value"], "left_anti", spread=F.col(f"`{id_col}`")).select(F.col(f"`{id_col}`"), "column_name", "value")
    every = df.sparkSession.createDataFrame([(c,) for c in pairs], "column_name string")
    counts = detail.groupBy("column_name").agg(F.count("*").alias("missing"))
    summary = every.join(counts, "column_name", "left").select("column_name", F.coalesce("missing", F.lit(0)).alias("missing"))
    return summary, detail


# ------------------------------------------------------------------ fused check


@dataclass(frozen=True)
class CheckSpec:
    """What to check. places: data column -> dimension column for names and ids; hierarchy: combinations of columns."""

    id_col: str
    places: dict[str, str] = field(default_factory=dict)
    hierarchy: tuple[tuple[str, ...], ...] = ()
    dates: tuple[str, ...] = ()
    date_pairs: tuple[tuple[str, str], ...] = ()
    lat: str | None = None
    lon: str | None = None
    key: str | None = None
    dim_key: str = "ADM2_GUID"
    dim_lat: str = "CENTER_LAT"
    dim_lon: str = "CENTER_LON"
    coordinate_checks: tuple[str, ...] = ("missing", "parse", "out_of_bounds", "precision", "null_coords", "flip", "on_water")
    min_year: int = 2000
    min_precision: int = 4
    detections: bool = False
    land: Rings | DataFrame | None = None
    lakes: Rings | DataFrame | None = None


#: The parts of a check, each of which can be left out.
PARTS = ("missing", "dates", "hierarchy", "mismatches", "coordinates", "detections")


_ADMIN = {
    "Admin0Name": "ADM0_NAME", "Admin1Name": "ADM1_NAME", "Admin2Name": "ADM2_NAME", "Admin0GUID": "ADM0_GUID", "Admin1GUID": "ADM1_GUID", "Admin2GUID": "ADM2_GUID",
}
_HIERARCHY = (("Admin0Name", "Admin1Name", "Admin2Name"), ("Admin0GUID", "Admin1GUID", "Admin2GUID"))

# Columns of the two kinds of records.
PRESETS = {
    "AFP": CheckSpec(
        "EPID", _ADMIN, _HIERARCHY, ("CaseDate", "InvestigationDate", "NotificationDate", "Stool1CollectionDate", "Stool2CollectionDate"),
        (("NotificationDate", "InvestigationDate"), ("NotificationDate", "Stool1CollectionDate"), ("Stool1CollectionDate", "Stool2CollectionDate")),
        "Latitude", "Longitude", "Admin2GUID",
    ),
    "ES": CheckSpec(
        "SampleId", _ADMIN, _HIERARCHY, ("CollectionDate", "DateShippedToRefLab", "DateReceivedInLab", "DateFinalCultureResult", "DateFinalResultsReported"),
        (("CollectionDate", "DateShippedToRefLab"), ("CollectionDate", "DateReceivedInLab"), ("CollectionDate", "DateFinalResultsReported")),
        "SiteYCoordinate", "SiteXCoordinate", "Admin2GUID",
    ),
}

# Kinds of date checks with their names in scorecard and issue list, {year} being the year of the check.
DATE_KINDS = (
    ("missing", "Missing", "Missing Value"), ("non_date", "Non-date", "is not a date"), ("invalid", "Invalid", "Invalid Date (Not Starting With '20')"),
    ("future", "Future", "Future Dates (Beyond {year})"), ("leap_issue", "Leap Issue", "has leap issue"), ("format_issue", "Format Issue", "has format issue"),
)
WRONG_ORDER = "Invalid Date Order (First Date Is After Second Date)"

# Labels of the scorecard and of the issue list.
LABELS = {
    "Total Duplicate": "Total Duplicate Rows", "Missing Coords": "Missing Coordinates", "Parse Failed": "Coordinates Failed to Parse",
    "Null Coords": "Null Coordinates (Latitude and Longitude are 0, 0)", "Out of Bounds": "Coordinates Out of Bounds (-90 to 90, -180 to 180)",
    "Low Precision": "Low Precision Coordinates (less than 5 decimal places)", "Potentially Flipped": "Flipped Coordinates (Latitude and Longitude are switched)",
    "On Water": "Coordinates On Water (Sea, Ocean, Lake or River)", "Missing": "Date is Missing", "Non-date": "Non-date Value (Cannot be converted to date format)",
    "Invalid": "Invalid Date (Not starting with '20')", "Leap Issue": "Leap date (Feb 29th) appearing in Non-leap Year",
    "Format Issue": "Date Format Issue (Not YYYY-MM-DD)", "Invalid Order": "Invalid Date Order (First date is after second date)",
}
ISSUE_LABELS = {
    "parse_failed": "Coordinates Failed to Parse", "missing_coords": "Missing Coordinate Values", "null_count": "Null Coordinates (Latitude And Longitude Are 0, 0)",
    "out_of_bounds": "Coordinates Out Of Bounds (Not Within -90 To 90, -180 To 180)", "low_precision": "Low Precision Coordinates (Less Than 5 Decimal Places)",
    "potentially_flipped": "Potentially Flipped Coordinates (Latitude And Longitude Switched)", "on_water": "Coordinates On Water Bodies (Sea, Ocean, Lake Or River)",
}

# Headers in their order.
HEADERS = ("Overall Data Summary", "Virus Detections", "Coordinate Checks", "Geographical Names & ID Missing", "Geographical Mismatches", "Geographical Hierarchy")


@dataclass(frozen=True)
class CheckBundle:
    """The lazy results of a check: flags has one row per record; summary (group, header, header_ord, column_name, count); issues
    (id, column_type, test)."""

    flags: DataFrame
    summary: DataFrame
    issues: DataFrame


def _flag_frame(df: DataFrame, spec: CheckSpec, dim: DataFrame | None, as_of: date, group: str | None, parts: Sequence[str] = PARTS) -> tuple[DataFrame, list[tuple]]:
    """Projection of group, id and one boolean per check, and what each boolean stands for:
    (flag, header, column name in the scorecard, type and text in the issue list or None)."""
    need = [spec.id_col, *([group] if group else []), *spec.places, *[c for p in spec.hierarchy for c in p], *spec.dates, *[c for p in spec.date_pairs for c in p]]
    need += [c for c in (spec.lat, spec.lon, spec.key) if c]
    gone = [c for c in dict.fromkeys(need) if c not in df.columns]
    if gone:
        raise ValueError(f"The following columns are missing in the data: {', '.join(gone)}")
    d, meta = df, []
    d = d.withColumns({"__id": F.col(f"`{spec.id_col}`"), "__group": F.col(f"`{group}`").cast("string") if group else F.lit("all")})
    new: dict[str, Column] = {}

    def add(flag: str, value: Column, header: str, column: str, kind: str | None, test: str | None) -> None:
        new[flag] = F.coalesce(value, F.lit(False))
        meta.append((flag, header, column, kind, test))

    for c in spec.places if "missing" in parts else ():
        add(f"__m_{c}", F.col(f"`{c}`").isNull(), HEADERS[3], c, "Geo", f"{c} Missing Value")
    if dim is not None and "mismatches" in parts:
        norm = lambda c, k: F.lower(F.regexp_replace(F.col(f"`{c}`").cast("string"), "[{}]", "")) if "GUID" in k else F.col(f"`{c}`").cast("string")
        checked = {c: k for c, k in spec.places.items() if c != "Admin0GUID"}
        cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), norm(k, k).alias("v")) for k in dict.fromkeys(checked.values())]))
        # the values of all columns of the dimension, made and counted once
        values = materialise(dim.select(cells.alias("x")).select("x.k", "x.v").where("v is not null").distinct(), "places")
        d = d.withColumn("__row", row_id(df))
        for c, k in checked.items():
            there = bounded_by(values.where(F.col("k") == k).select(F.col("v").alias(f"__v_{c}"), F.lit(True).alias(f"__in_{c}")), values)
            d = join_dimension(d.withColumn(f"__v_{c}", norm(c, k)), there, [f"__v_{c}"], "left", spread=F.col("__row"))
            add(f"__x_{c}", F.col(f"`{c}`").isNotNull() & F.col(f"__in_{c}").isNull(), HEADERS[4], c, "Geo", f"{c} not in Shapefile")
    pair_cols = {c for p in spec.date_pairs for c in p}
    best = trained_orders(df, list(dict.fromkeys((*spec.dates, *pair_cols))), (*DATE_ORDERS, *TIME_ORDERS)) if "dates" in parts and (spec.dates or pair_cols) else {}
    d = with_trained(d, {f"__i_{c}": c for c in best}, best)
    d = d.withColumns({f"__t_{c}": F.coalesce(iso_text(F.col(f"`__i_{c}`")), F.col(f"`{c}`").cast("string")) for c in best})
    for c in spec.dates if "dates" in parts else ():
        flags = date_flags(F.col(f"`__t_{c}`"), c, ("missing", "non_date", "sensible", "leap_year", "format"), spec.min_year, as_of)
        for kind, name, text in DATE_KINDS:
            add(f"__d_{c}_{kind}", flags[f"{c}_{kind}"], f"Date Check: {c}", name, "Date", f"{c} {text.format(year=as_of.year)}")
    for a, b in spec.date_pairs if "dates" in parts else ():
        x, y = (F.try_to_date(F.substring(F.col(f"`__t_{c}`"), 1, 10), "yyyy-MM-dd") for c in (a, b))
        add(f"__o_{a}_{b}", x > y, f"Date Pair Check: {a} ~ {b}", "Invalid Order", "Date", f"{a} ~ {b} {WRONG_ORDER}")
    if spec.lat and spec.lon and "coordinates" in parts:
        d = check_coords(
            d, spec.lat, spec.lon, spec.coordinate_checks, dim, spec.key, spec.dim_key, spec.dim_lat, spec.dim_lon, spec.land, spec.lakes, spec.min_precision
        )
        for k, f in FLAG.items():
            if f in d.columns and k in spec.coordinate_checks:
                v = F.col(f).isin("Ocean", "Inland water") if k == "on_water" else F.col(f)
                add(f"__c_{k}", v, HEADERS[2], HEADING[k], "Coordinate", ISSUE_LABELS[f])
    if spec.detections and "detections" in parts:
        wild, kind = F.col("WILD1"), F.col("VdpvClassifications") == "Circulating"
        for name, v in (("WPV1", wild), ("cVDPV1", F.col("VDPV1") & kind), ("cVDPV2", F.col("VDPV2") & kind)):
            add(f"__v_{name}", v, HEADERS[1], name, None, None)
    return d.withColumns(new).select("__group", "__id", *new), meta


def check_data(
    df: DataFrame, spec: CheckSpec, dim: DataFrame | None = None, as_of: date | None = None, group: str | None = None, n_groups: int | None = None,
    parts: Sequence[str] = PARTS, shared: bool = False,
) -> CheckBundle:
    """All checks of spec over df, per value of `group` (null groups left out; the last n_groups in order) or over all rows.

    The scorecard also has the total of rows and of duplicates: rows whose id occurred already, per group; a null id is an id.
    Every header's checks are there for every group, with 0 where nothing was found. parts: what to check, some of PARTS. The
    scorecard's line for each combination of spec.hierarchy has the reference's count, distinct rows less distinct rows (see
    admin_hierarchy). shared: the flags are written once, for callers who use both scorecard and issues.
    """
    unknown = set(parts) - set(PARTS)
    if unknown:
        raise ValueError(f"unknown parts: {', '.join(sorted(unknown))}")
    as_of = as_of or date.today()
    flags, meta = _flag_frame(df, spec, dim, as_of, group, parts)
    flags = materialise(flags, "flags") if shared else flags
    if group:
        flags = flags.where("__group is not null")
        if n_groups is not None:
            last = df.select(F.col(f"`{group}`").alias("g")).where("g is not null").distinct().orderBy(F.desc("g")).limit(n_groups)
            flags = flags.join(F.broadcast(last.select(F.col("g").cast("string").alias("__group"))), "__group", "left_semi")
    total = flags.groupBy("__group").agg(
        F.count("*").alias("__rows"),
        (F.count("*") - F.count_distinct("__id") - F.max(F.col("__id").isNull().cast("int"))).alias("__dup"),
        *[F.count_if(F.col(f"`{m[0]}`")).alias(m[0]) for m in meta],
    )
    order = {h: i for i, h in enumerate(dict.fromkeys([*HEADERS, *[m[1] for m in meta]]))}
    lines = [("__rows", HEADERS[0], "Total Rows"), ("__dup", HEADERS[0], "Total Duplicate")] + [(m[0], m[1], m[2]) for m in meta]
    if "hierarchy" in parts:
        total = total.withColumn("__hier", F.lit(0))
        lines += [("__hier", HEADERS[5], " ~ ".join(p)) for p in spec.hierarchy]
    cells = F.array(*[F.struct(F.lit(h).alias("header"), F.lit(order[h]).alias("header_ord"), F.lit(_label(h, c, as_of)).alias("column_name"), F.col(f"`{f}`").cast("long").alias("count")) for f, h, c in lines])
    summary = total.select(F.col("__group").alias("group"), F.explode(cells).alias("c")).select("group", "c.*")
    tests = [F.when(F.col(f"`{m[0]}`"), F.struct(F.lit(m[3]).alias("column_type"), F.lit(m[4]).alias("test"))) for m in meta if m[3]]
    found = F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("i") if tests else None
    if found is None:
        issues = flags.select(F.col("__id").alias("id"), F.lit("").alias("column_type"), F.lit("").alias("test")).where("false")
    else:
        issues = flags.select(F.col("__id").alias("id"), found).select("id", "i.*").distinct()
    return CheckBundle(flags, summary, issues)


def _label(header: str, column: str, as_of: date) -> str:
    if header == "Geographical Mismatches":
        return f"{column} not in Shapefile"
    if header == "Geographical Hierarchy":
        return f"Non-unique {'GUID' if 'GUID' in column else 'name'} Hierarchy ({column})"
    return f"Date into the future (beyond {as_of.year})" if column == "Future" else LABELS.get(column, column)


def in_report_order(table: DataFrame) -> DataFrame:
    """A scorecard by header, names before ids, then by check, with `header_text`: the header on its first row, empty on the others."""
    order = ["header_ord", (~F.col("column_name").contains("Name")).alias("n"), "column_name"]
    first = F.row_number().over(Window.partitionBy("header_ord").orderBy(*order[1:])) == 1  # some dozen checks under a header
    return table.withColumn("header_text", F.when(first, F.col("header")).otherwise("")).orderBy(*order)


def summary_by_group(bundle: CheckBundle, groups: Sequence[str]) -> DataFrame:
    """(header_ord, header, column_name, one column per group): the scorecard with groups side by side; values as numbers, 0 where nothing
    was found. in_report_order sorts it."""
    p = bundle.summary.groupBy("header_ord", "header", "column_name").pivot("group", list(groups)).agg(F.sum("count"))
    return p.fillna(0, subset=list(groups))


def validate_data(
    df: DataFrame, spec: CheckSpec, dim: DataFrame | None, group: str, n_groups: int = 10, as_of: date | None = None, decreasing: bool = False, parts: Sequence[str] = PARTS,
) -> tuple[CheckBundle, DataFrame]:
    """The checks and the scorecard of the last n_groups groups side by side, in their order or backwards. The group values are one
    small query; at most n_groups come to the driver. The flags are written once."""
    bundle = check_data(df, spec, dim, as_of, group, n_groups, parts, shared=True)
    last = df.select(F.col(f"`{group}`").alias("g")).where("g is not null").distinct().orderBy(F.desc("g")).limit(n_groups).collect()
    return bundle, summary_by_group(bundle, [str(r.g) for r in (last if decreasing else reversed(last))])


def validate_polis(
    df: DataFrame, kind: str, dim: DataFrame | None, group: str, n_groups: int = 10, as_of: date | None = None, decreasing: bool = False, parts: Sequence[str] = PARTS, **changes,
) -> tuple[CheckBundle, DataFrame]:
    """validate_data of AFP or ES records by their preset, with changes of it; columns that are missing are named in the error."""
    return validate_data(df, preset(kind, **changes), dim, group, n_groups, as_of, decreasing, parts)


# The date that places a record in a year.
RECORD_DATE = {"AFP": "CaseDate", "ES": "CollectionDate"}


def validate_polis_snapshots(
    spark: SparkSession, root: str, name: str, kind: str, dim: DataFrame | None, year: int, snapshots: int = 6, as_of: date | None = None, **changes,
) -> tuple[CheckBundle, DataFrame]:
    """The checks and the scorecard of the newest weekly snapshots of a year (sources.snapshots) side by side, oldest first: the records of that
    year and the year before. Only the folders of these snapshots are read."""
    weeks = [w for y, w in snapshot_weeks(spark, root, name) if y == year][-snapshots:]
    if not weeks:
        raise ValueError(f"no snapshot of {year} under {root}/{name}")
    df = read_snapshots(spark, root, name, weeks=[(year, w) for w in weeks]).where(F.year(RECORD_DATE[kind]) >= year - 1)
    return validate_polis(df, kind, dim, "snapshot", len(weeks), as_of, **changes)


def preset(kind: str, **changes) -> CheckSpec:
    """The specification of AFP or ES records, with changes."""
    if kind not in PRESETS:
        raise ValueError(f"kind is one of {', '.join(PRESETS)}")
    return replace(PRESETS[kind], **changes)


def count_text(summary: DataFrame) -> DataFrame:
    """The scorecard with counts as text with separators."""
    return summary.withColumn("count", big_mark(F.col("count")))
