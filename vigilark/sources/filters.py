"""Filters and URLs of the two HTTP services, and the same filters as Spark predicates."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Per kind of data the endpoint, the date field of a first pull and that of an update.
ENDPOINTS = {
    "cases": ("Case", "CaseDate", "LastUpdateDate"), "virus": ("Virus", "VirusDate", "UpdatedDate"), "population": ("Population", "CreatedDate", "UpdatedDate"),
    "env": ("EnvSample", "CollectionDate", "LastUpdateDate"), "geo": ("Geography", "CreatedDate", "UpdatedDate"), "geo_synonym": ("Synonym", "UpdatedDate", "UpdatedDate"),
    "im": ("Im", "PublishDate", "PublishDate"), "activity": ("Activity", "ActivityDateFrom", "LastUpdateDate"), "lab_specimen_virus": ("HumanSpecimenViruses", "PublishDate", "PublishDate"),
    "lab_specimen": ("LabSpecimen", "CreatedDate", "LastUpdateDate"), "lab_env": ("EnvSample", "CollectionDate", "LastUpdateDate"),
    "sub_activ": ("SubActivity", "DateFrom", "UpdatedDate"), "lqas": ("Lqas", "Start", "Start"),
}

_OPS = {">": "$gt", ">=": "$gte", "<": "$lt", "<=": "$lte", "==": "$eq", "!=": "$ne"}
_CONDITION = re.compile(r"^\s*`?([A-Za-z_][\w.]*)`?\s*(>=|<=|==|!=|>|<)\s*(.+?)\s*$")


def endpoint(kind: str) -> tuple[str, str, str]:
    """(suffix, date field of a first pull, date field of an update)."""
    if kind not in ENDPOINTS:
        raise ValueError("Invalid data_type specified")
    return ENDPOINTS[kind]


def odata_url(
    base: str, suffix: str, min_date: str, max_date: str, date_field: str, country_code: str | None = None, region_field: str = "WHORegion",
    region: str | None = None, select: Sequence[str] = (),
) -> str:
    """URL with date, country and region filters and a selection; only spaces and the like are escaped. The endpoints without a region column get no
    region filter."""
    q = f"{date_field} ge DateTime'{min_date}' and {date_field} le DateTime'{max_date}'"
    if country_code:
        q += f" and CountryISO3Code eq '{country_code}'"
    if region and suffix not in ("HumanSpecimenViruses", "Im"):
        q += f" and {region_field} eq '{region}'"
    if select:
        q += "&$select=" + ",".join(select)
    return f"{base}{suffix}?$filter=" + quote(q, safe="!#$&'()*+,/:;=?@[]-._~")


def odata_filter(df: DataFrame, min_date: str, max_date: str, date_field: str, country_code: str | None = None, region_field: str = "WHORegion", region: str | None = None, select: Sequence[str] = ()) -> DataFrame:
    """What the service does with such a URL, on a table."""
    on = F.col(date_field).between(F.lit(min_date).cast("date"), F.lit(max_date).cast("date"))
    if country_code:
        on = on & (F.col("CountryISO3Code") == country_code)
    if region:
        on = on & (F.col(region_field) == region)
    out = df.where(on)
    return out.select(*select) if select else out


def base_url(url: str) -> str:
    """Scheme and host of a URL."""
    m = re.match(r"^(https?://[^/]+)", url)
    if not m:
        raise ValueError(f"not an http(s) URL: {url}")
    return m[1]


def _conditions(expr: str) -> list[tuple[str, str, str]]:
    out = []
    for part in re.split(r"\s*&&?\s*", expr.lstrip("~ ")):
        m = _CONDITION.match(part)
        if not m:
            raise ValueError(f"cannot read the condition {part!r}")
        out.append((m[1], m[2], m[3].strip("'\"")))
    return out


def comparison_query(*exprs: str) -> str:
    """Conditions such as "age >= 1 & age <= 5" as a JSON query: every condition under its own field."""
    q: dict[str, dict[str, str]] = {}
    for e in exprs:
        for name, op, value in _conditions(e):
            q.setdefault(name, {})[_OPS[op]] = value
    return json.dumps(q)


def comparison_filter(df: DataFrame, *exprs: str) -> DataFrame:
    """The rows that fulfil all conditions."""
    on: Column = F.lit(True)
    for e in exprs:
        for name, op, value in _conditions(e):
            c, v = F.col(f"`{name}`"), F.lit(value)
            v = v.cast(dict(df.dtypes)[name])
            on = on & {">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v, "==": c == v, "!=": c != v}[op]
    return df.where(on)


def logical_query(filters: dict, flat_or: bool = False) -> str:
    """Fields with one or several values as a JSON query: several values of a field are alternatives, fields must all hold. flat_or=True puts the
    alternatives of all fields into one list, as the reference does. A query that has logical operators is passed on."""
    if any(k in ("$and", "$or", "$nor", "$not") for k in filters):
        return json.dumps(filters)
    lists = {k: v if isinstance(v, (list, tuple)) else [v] for k, v in filters.items()}
    single = {k: v[0] for k, v in lists.items() if len(v) == 1}
    several = {k: v for k, v in lists.items() if len(v) > 1}
    ors = [{"$or": [{k: x} for k, v in several.items() for x in v]}] if flat_or and several else [{"$or": [{k: x} for x in v]} for k, v in several.items()]
    if not ors:
        return json.dumps(single)
    if not single and len(ors) == 1:
        return json.dumps(ors[0])
    return json.dumps({"$and": ([single] if single else []) + ors})


def logical_filter(df: DataFrame, filters: dict) -> DataFrame:
    """The rows whose fields each have one of the values given for them."""
    on: Column = F.lit(True)
    for k, v in filters.items():
        on = on & F.col(f"`{k}`").isin(list(v) if isinstance(v, (list, tuple)) else [v])
    return df.where(on)


def form_urls(state: DataFrame, base: str, form_ids: Sequence[int]) -> list[str]:
    """URL of each form for its next pull: from the date of the newest update kept of it on, or everything of a form not seen yet. One
    aggregation; a row per form comes to the driver."""
    ids = list(form_ids)
    marks = state.where(F.col("form_id_num").isin(ids)).groupBy("form_id_num").agg(F.max(F.to_date("date_last_updated")).alias("d")).collect()
    since = {str(r.form_id_num): r.d for r in marks if r.d is not None}
    root = base_url(base)
    return [f"{root}/api/v1/data/{i}" + (f"?last_edited__gte={since[str(i)].isoformat()}" if str(i) in since else "") for i in ids]
