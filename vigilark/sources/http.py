"""Paginated HTTP services as Spark data sources.

`ona` reads forms by page number, `odata` follows next links; both return rows as text, the reader's partitions are forms or date ranges, so that
executors pull in parallel and a lost executor repeats only its own partition.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import warnings
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vigilark.operators.merge import append_log, drop_empty_columns, load_log, merge_latest
from vigilark.session import collect_bounded, materialise
from vigilark.sources.filters import base_url, endpoint, form_urls, odata_url
from vigilark.streaming.merge import VersionedTable

PAGE_SIZE = 100_000
TRIES = 12
MAX_PAUSE = 180


def fetch(url: str, token: str | None = None, tries: int = TRIES, pause: float = 1.0, timeout: float = 600) -> bytes:
    """Body of a GET; errors of the network and of the server are tried again with growing pauses, other statuses are raised at once."""
    for k in range(tries):
        try:
            req = urllib.request.Request(url, headers={"Authorization": f"Token {token}"} if token else {})
            with urllib.request.urlopen(req, timeout=timeout) as r:  # noqa: S310
                return r.read()
        except urllib.error.HTTPError as e:
            if e.code < 500 and e.code != 429 or k == tries - 1:
                raise RuntimeError(f"request failed with status {e.code}") from e
        except (urllib.error.URLError, OSError) as e:
            if k == tries - 1:
                raise RuntimeError(f"request failed: {e}") from e
        time.sleep(min(MAX_PAUSE, pause * 2**k))
    raise RuntimeError("no try was made")


def pages(url: str, token: str | None, page_size: int = PAGE_SIZE, **kw) -> Iterator[dict]:
    """Rows of a form, page by page until a page is short."""
    n = 1
    while True:
        sep = "&" if "?" in url else "?"
        rows = json.loads(fetch(f"{url}{sep}page={n}&page_size={page_size}", token, **kw))
        yield from rows
        if len(rows) < page_size:
            return
        n += 1


def linked(url: str, token: str | None = None, **kw) -> Iterator[dict]:
    """Rows of an OData query, following next links."""
    while url:
        body = json.loads(fetch(url, token, **kw))
        yield from body.get("value", [])
        url = body.get("odata.nextLink") or body.get("@odata.nextLink")


def entity_sets(xml: bytes) -> list[tuple[str, str]]:
    """(name, entity type) from an OData $metadata document, the first name of each type."""
    out: dict[str, str] = {}
    for e in ET.fromstring(xml).iter():
        if e.tag.rsplit("}", 1)[-1] == "EntitySet":
            out.setdefault(e.attrib["EntityType"], e.attrib["Name"])
    return [(n, t) for t, n in out.items()]


@dataclass
class UrlPartition(InputPartition):
    url: str
    tag: str = ""


class _RowReader(DataSourceReader):
    """Rows as (tag, url, row as JSON text)."""

    rows = staticmethod(pages)

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        return [UrlPartition(u, t) for u, t in json.loads(self.options["urls"])]

    def read(self, partition: UrlPartition) -> Iterator[tuple]:
        kw = {"tries": int(self.options.get("tries", TRIES)), "pause": float(self.options.get("pause", 1.0))}
        if type(self).rows is pages:
            kw["page_size"] = int(self.options.get("page_size", PAGE_SIZE))
        for row in type(self).rows(partition.url, self.options.get("token"), **kw):
            yield partition.tag, partition.url, json.dumps(row)


class _LinkedReader(_RowReader):
    rows = staticmethod(linked)


class OnaSource(DataSource):
    """format("ona"): options urls (JSON list of [url, tag]), token, page_size, tries, pause."""

    @classmethod
    def name(cls) -> str:
        return "ona"

    def schema(self) -> str:
        return "tag string, url string, row string"

    def reader(self, schema) -> DataSourceReader:
        return _RowReader(self.options)


class ODataSource(OnaSource):
    """format("odata"): the same options; rows by next links."""

    @classmethod
    def name(cls) -> str:
        return "odata"

    def reader(self, schema) -> DataSourceReader:
        return _LinkedReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OnaSource)
    spark.dataSource.register(ODataSource)


#: Columns that the rows of a service may have in all.
MAX_KEYS = 10_000


def _flat(df: DataFrame, tag: str, empty: bool = True) -> DataFrame:
    """JSON rows as columns of text, `tag` in front. The pages are fetched once and written to the shared folder; names and values are read from
    there, nested values stay JSON. empty=False leaves out the columns that hold nothing."""
    landed = materialise(df, "pages")
    known = landed.select(F.explode(F.map_entries(F.from_json("row", "map<string,string>"))).alias("e")).groupBy(F.col("e.key").alias("k")).agg(F.max(F.col("e.value").isNotNull()).alias("used"))
    keys = sorted(r.k for r in collect_bounded(known, MAX_KEYS, "columns") if r.k != tag and (empty or r.used))
    parsed = landed.withColumn("m", F.from_json("row", "map<string,string>"))
    return parsed.select(F.col("tag").alias(tag), *[F.col("m")[k].alias(k) for k in keys])


def read_forms(spark: SparkSession, base: str, form_ids: Sequence[int], token: str | None = None, fields: Sequence[str] = (), query: str | None = None, **options) -> DataFrame:
    """Rows of several forms, form_id_num first, all columns text, equal rows once, columns without any value left out. fields and query are
    evaluated by the server. A page is requested once, whatever is done with the result."""
    register(spark)
    extra = []
    if fields:
        extra.append("fields=" + urllib.request.quote(json.dumps(list(fields))))
    if query:
        extra.append("query=" + urllib.request.quote(query))
    urls = [(f"{base_url(base)}/api/v1/data/{i}" + ("?" + "&".join(extra) if extra else ""), str(i)) for i in form_ids]
    opts = {k: str(v) for k, v in options.items()} | ({"token": token} if token else {})
    df = spark.read.format("ona").options(urls=json.dumps(urls), **opts).load()
    return _flat(df, "form_id_num", empty=False).distinct()


def read_multi_forms(*args, **kwargs) -> DataFrame:
    """The former name of read_forms."""
    warnings.warn("read_multi_forms is now read_forms", DeprecationWarning, stacklevel=2)
    return read_forms(*args, **kwargs)


def read_urls(spark: SparkSession, urls: Sequence[str], token: str | None = None, on: date | None = None, **options) -> DataFrame:
    """Rows behind several form URLs, with form_id_num from the URL and date_last_updated."""
    register(spark)
    tagged = [(u, u.split("?")[0].rstrip("/").rsplit("/", 1)[-1]) for u in urls]
    opts = {k: str(v) for k, v in options.items()} | ({"token": token} if token else {})
    df = spark.read.format("ona").options(urls=json.dumps(tagged), **opts).load()
    return _flat(df, "form_id_num").withColumn("date_last_updated", F.lit((on or date.today()).isoformat()))


def read_odata(
    spark: SparkSession, base: str, kind: str, min_date: date, max_date: date, token: str | None = None, updates: bool = False,
    region: str | None = None, country_code: str | None = None, select: Sequence[str] = (), days_per_partition: int = 90, **options,
) -> DataFrame:
    """Rows of a data type between two dates. A chain of next links cannot be split, so the range is cut into pieces that are read in parallel."""
    register(spark)
    suffix, first, later = endpoint(kind)
    field, urls, a = later if updates else first, [], min_date
    while a <= max_date:
        b = min(max_date, a + timedelta(days=days_per_partition - 1))
        urls.append((odata_url(base, suffix, a.isoformat(), b.isoformat(), field, country_code, "WHORegion", region, select), kind))
        a = b + timedelta(days=1)
    opts = {k: str(v) for k, v in options.items()} | ({"token": token} if token else {})
    df = spark.read.format("odata").options(urls=json.dumps(urls), **opts).load()
    return _flat(df, "data_type")


def catalogue(spark: SparkSession, base: str, token: str | None = None, **kw) -> DataFrame:
    """The forms the service offers, one row each."""
    rows = json.loads(fetch(f"{base_url(base)}/api/v1/data", token, **kw))
    return spark.createDataFrame([{k: None if v is None else str(v) for k, v in r.items()} for r in rows])


def tables_available(spark: SparkSession, base: str, names: Sequence[str], token: str | None = None) -> DataFrame:
    """(table, status): the answer of each table to a request for five rows."""
    out = []
    for n in names:
        try:
            fetch(f"{base}{n}?$top=5", token, tries=1, timeout=10)
            out.append((n, "200"))
        except RuntimeError as e:
            out.append((n, str(e).rsplit(" ", 1)[-1] if "status" in str(e) else "unreachable"))
    return spark.createDataFrame(out, "table string, status string")


# ------------------------------------------------------------------ incremental pulls


def update_forms(spark: SparkSession, path: str, base: str, form_ids: Sequence[int], token: str | None = None, on: date | None = None, key: str = "_id", **options) -> tuple[DataFrame, DataFrame]:
    """(rows, log): brings the kept rows of some forms up to date.

    path holds the rows (data) and the log of loads (log) as numbered versions. Of a form not seen yet everything is pulled, of the
    others what was edited since the newest date_last_updated kept; each URL is read once. Newer rows replace older ones of the same key
    and form; columns without any value are left out. The log gets a line per form that was pulled: rows and columns now and new.
    A run that fails before the new version is complete changes nothing, and the next asks for the same again.
    """
    data, log = VersionedTable(spark, f"{path}/data"), VersionedTable(spark, f"{path}/log")
    before = data.read()
    urls = form_urls(before, base, form_ids) if before is not None else [f"{base_url(base)}/api/v1/data/{i}" for i in form_ids]
    new = materialise(read_urls(spark, urls, token, on, **options), "pulled")
    if before is None and key not in new.columns:
        return new, load_log(new.limit(0), new, "form_id_num")  # nothing was ever there
    now = merge_latest(before, new, ["form_id_num", key], "date_last_updated") if key in new.columns else before
    data.write(drop_empty_columns(materialise(now, "merged")), data.next())
    rows = data.read()
    line = load_log(before if before is not None else rows.limit(0), rows, "form_id_num").withColumn("update_time", F.lit((on or date.today()).isoformat()))
    line = line.join(F.broadcast(new.select("form_id_num").distinct()), "form_id_num", "left_semi")  # a row per form
    old = log.read()
    log.write(line if old is None else old.unionByName(line, allowMissingColumns=True), log.next())
    return rows, log.read()


def update_odata(
    spark: SparkSession, path: str, base: str, kind: str, start: date, until: date, token: str | None = None, keys: Sequence[str] = (), **options,
) -> tuple[DataFrame, DataFrame]:
    """(rows, log): brings the kept rows of a data type up to date.

    The first run asks for everything from `start` by the field of first pulls, later runs for what was updated from the newest update
    date kept on. With keys the newer row replaces the older, else rows that are not there yet are added. The log has a line per run,
    equal runs once. Each page is read once; a run that fails changes nothing.
    """
    data, log = VersionedTable(spark, f"{path}/data"), VersionedTable(spark, f"{path}/log")
    field = endpoint(kind)[2]
    before = data.read()
    mark = before.agg(F.max(F.to_date(F.substring(F.col(field), 1, 10))).alias("m")).first()["m"] if before is not None and field in before.columns else None
    since = mark or start
    new = materialise(read_odata(spark, base, kind, since, until, token, updates=mark is not None, **options), "pulled")
    if before is None:
        now = merge_latest(None, new, list(keys), field) if keys and field in new.columns else new.distinct()
    elif keys and field in new.columns:
        now = merge_latest(before, new, list(keys), field)
    else:  # what was asked for again from the last day on is there already
        now = before.unionByName(new, allowMissingColumns=True).distinct()
    data.write(materialise(now, "merged"), data.next())
    rows = data.read()
    had = before.count() if before is not None else 0
    line = [(kind, since.isoformat(), until.isoformat(), rows.count() - had, datetime.now(timezone.utc).replace(tzinfo=None))]
    log.write(append_log(log.read(), spark.createDataFrame(line, "data_type string, query_start string, query_end string, new_rows long, update_time timestamp_ntz"), ["data_type", "query_start", "query_end", "new_rows"], "update_time"), log.next())
    return rows, log.read()
