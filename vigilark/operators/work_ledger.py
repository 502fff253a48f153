"""A ledger of work items: pending, leased, done.

Every run takes items under a lease, does its work and commits under its fencing token. The state of an item follows from the
claims on it alone, so it can be derived at any time by aggregations and nothing has to be kept in the
memory of a scheduler:

- `done` once a claim with a valid commit covers it; the first valid commit is final,
- `leased` while an open claim's lease has not run out,
- `pending` otherwise; a lease that ran out, a failed run and a refused commit leave the item pending.

Fencing: tokens grow from lease to lease. A commit counts only if its lease had not run out at the time of the commit and no
lease with a higher token had been given out for the item by then; a writer that was paused past its lease is refused. Files are
written to a path that follows from the token, so a retry of the same attempt overwrites itself and a retry after a crash
cannot leave a second copy.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilark.plans.joins import join_dimension
from vigilark.session import list_dir, publish, read_small

CLAIMS = T.StructType(
    [
        T.StructField("item", T.StringType()),
        T.StructField("token", T.LongType()),
        T.StructField("event", T.StringType()),  # lease, done, failed
        T.StructField("at", T.TimestampNTZType()),
        T.StructField("lease_until", T.TimestampNTZType()),
    ]
)


def ledger_state(committed: Column, leased: Column) -> Column:
    """The state of an item from its two facts: a valid commit, an open lease. Null facts count as false."""
    return F.when(F.coalesce(committed, F.lit(False)), "done").when(F.coalesce(leased, F.lit(False)), "leased").otherwise("pending")


def item_states(items: DataFrame, claims: DataFrame, now: Column, keys: Sequence[str] = ("item",)) -> DataFrame:
    """State of every item: items with `state`, `token` (the highest lease's) and `committed` (the token of its valid commit); both null
    without one.

    items: one row per item, identified by `keys`; its own columns of these names are replaced. claims: keys, token, event, at, lease_until as in CLAIMS. A commit is valid if its
    token was leased at or before its time, that lease had not run out, and no higher token had been leased by then; of several
    the earliest holds. Events with a null key, token or time say nothing and are left out; repeated events change nothing.

    Plan: events meet by (keys, token) in one aggregation, attempts are ordered within an item by a window that can spill, and
    meet again by keys: all three on the partitioning of the keys.
    """
    c = claims.where(" and ".join(f"{k} is not null" for k in (*keys, "token", "at", "event")))
    on = lambda e: F.col("event") == e
    tries = c.groupBy(*keys, "token").agg(
        F.min(F.when(on("lease"), F.col("at"))).alias("leased_at"),
        F.max(F.when(on("lease"), F.col("lease_until"))).alias("until"),
        F.min(F.when(on("done"), F.col("at"))).alias("done_at"),
        F.max(on("failed")).alias("failed"),
    )
    higher = Window.partitionBy(*keys).orderBy(F.desc("token")).rowsBetween(Window.unboundedPreceding, -1)
    tries = tries.withColumn("outranked_at", F.min("leased_at").over(higher))
    valid = (F.col("leased_at") <= F.col("done_at")) & (F.col("done_at") <= F.col("until")) & ~F.coalesce(F.col("outranked_at") <= F.col("done_at"), F.lit(False))
    st = tries.groupBy(*keys).agg(
        F.max(F.when(F.col("leased_at").isNotNull(), F.col("token"))).alias("token"),
        F.min_by("token", F.when(valid, F.struct("done_at", "token"))).alias("committed"),
        # the highest lease decides whether somebody holds the item
        F.max_by(F.col("until") > now, F.when(F.col("leased_at").isNotNull() & ~F.col("failed"), F.col("token"))).alias("__open"),
    )
    state = ledger_state(F.col("committed").isNotNull(), F.col("__open")).alias("state")
    items = items.drop(*{"state", "token", "committed"} - set(keys))
    return items.join(st, list(keys), "left").select(*[F.col(f"`{c}`") for c in items.columns], state, "token", "committed")


class StaleLease(RuntimeError):
    """A commit was refused: its lease ran out, or its items went to a higher token."""


def _utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class WorkLedger:
    """The durable form, under a folder shared by all executors and drivers.

    `log/` holds numbered entries, one per lease, commit or failure. An entry is published by an atomic move that fails if its number is
    taken; whoever loses reads the log again and decides anew. So leases and commits of concurrent runs have one order, no token is
    given twice and no item is held by two open leases. A lease's number is its token. Its items lie in items/lease=<id>, written before
    the entry is published; folders that no entry names don't count. An entry is read by the driver: one small file per run.
    """

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], datetime] = _utc_now):
        self.spark, self.path, self.clock = spark, path.rstrip("/"), clock

    def entries(self) -> list[dict]:
        """The log in order."""
        names = sorted(n for n in list_dir(self.spark, f"{self.path}/log") if n.endswith(".json"))
        return [json.loads(read_small(self.spark, f"{self.path}/log/{n}")) for n in names]

    def _publish(self, number: int, **entry) -> bool:
        """Adds an entry; False if its number is taken."""
        text = json.dumps({"number": number} | {k: v.isoformat() if isinstance(v, datetime) else v for k, v in entry.items()})
        return publish(self.spark, text, f"{self.path}/log/{number:012d}.json")

    def claims(self, entries: list[dict] | None = None) -> DataFrame:
        """CLAIMS of all items: the items of every lease with the lease's own and its closing entry."""
        log = self.entries() if entries is None else entries
        leases = {e["token"]: e for e in log if e["event"] == "lease"}
        if not leases:
            return self.spark.createDataFrame([], CLAIMS)
        rows = [(leases[e["token"]]["lease"], e["token"], e["event"], datetime.fromisoformat(e["at"]), datetime.fromisoformat(e["lease_until"]) if e.get("lease_until") else None) for e in log]
        events = self.spark.createDataFrame(rows, "lease string, token long, event string, at timestamp_ntz, lease_until timestamp_ntz")
        return self._items([e["lease"] for e in leases.values()]).join(F.broadcast(events), "lease").select(*CLAIMS.names)  # two entries per run

    def _items(self, leases: Sequence[str]) -> DataFrame:
        paths = [f"{self.path}/items/lease={k}" for k in leases]
        return self.spark.read.schema("item string, lease string").option("basePath", f"{self.path}/items").parquet(*paths)

    def lease(self, items: DataFrame, now: datetime, until: datetime) -> tuple[int, DataFrame]:
        """Leases every pending item; returns the token and the items taken, perhaps none."""
        while True:
            log = self.entries()
            states = item_states(items.select("item"), self.claims(log), F.lit(now).cast("timestamp_ntz"))
            key = uuid.uuid4().hex
            states.where("state = 'pending' and item is not null").select("item").distinct().write.parquet(f"{self.path}/items/lease={key}")
            token = len(log) + 1
            if self._publish(token, token=token, event="lease", at=now, lease_until=until, lease=key):
                return token, items.join(self._items([key]).select("item"), "item", "left_semi")

    def end(self, token: int, event: str, at: datetime) -> None:
        """Ends a lease as 'done' or 'failed'. Ending it again the same way changes nothing. A commit is refused with StaleLease if the
        lease ended otherwise, ran out before `at`, or one of its items has been leased under a higher token."""
        while True:
            log = self.entries()
            own = [e for e in log if e["token"] == token]
            if not own:
                raise StaleLease(f"token {token} was never leased")
            closed = [e["event"] for e in own if e["event"] != "lease"]
            if closed:
                if closed[0] == event:
                    return
                raise StaleLease(f"token {token} has ended as {closed[0]}")
            if event == "done":
                if at > datetime.fromisoformat(own[0]["lease_until"]):
                    raise StaleLease(f"the lease of token {token} ran out at {own[0]['lease_until']}")
                above = [e["lease"] for e in log if e["event"] == "lease" and e["token"] > token]
                if above and self._items([own[0]["lease"]]).join(self._items(above), "item", "left_semi").limit(1).count():
                    raise StaleLease(f"items of token {token} were leased again")
            if self._publish(len(log) + 1, token=token, event=event, at=at):
                return

    def output_path(self, token: int) -> str:
        return f"{self.path}/out/token={token}"

    def process(self, items: DataFrame, work: Callable[[DataFrame], DataFrame], now: datetime, until: datetime) -> int:
        """One run: lease, work, write to the token's own path (overwriting an earlier try of this token), commit. The commit bears the time
        of the ledger's clock when the work is written; a late one raises StaleLease and its output is never read."""
        token, mine = self.lease(items, now, until)
        try:
            work(mine).write.mode("overwrite").parquet(self.output_path(token))
        except Exception:
            self.end(token, "failed", self.clock())
            raise
        self.end(token, "done", self.clock())
        return token

    def results(self, schema: T.StructType) -> DataFrame:
        """Output of the committed runs, with their `token`: what a refused or failed writer left behind is not read."""
        paths = [self.output_path(e["token"]) for e in self.entries() if e["event"] == "done"]
        full = T.StructType([*[f for f in schema if f.name != "token"], T.StructField("token", T.LongType())])
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.path}/out").parquet(*paths)


def covered_days(log: DataFrame, first: Column, last: Column, group: Column, at: Column, low: str, high: str) -> DataFrame:
    """(group, day, seen_until): for every group and day the latest time of a claim whose interval holds the day.

    Turns the interval join of items and claims into an equi-join: an item of that group and day is covered if it was there by
    seen_until. Intervals are cut to [low, high] (ISO dates), the days of the items, so the result has at most groups x days rows
    whatever the number of claims.
    """
    a, b = F.greatest(first, F.lit(low).cast("date")), F.least(last, F.lit(high).cast("date"))
    days = log.select(group.alias("group"), a.alias("a"), b.alias("b"), at.alias("at")).where("a <= b and at is not null and group is not null")
    # equal and nested claims of one interval meet before they are spread over days
    days = days.groupBy("group", "a", "b").agg(F.max("at").alias("at"))
    return days.select("group", F.explode(F.sequence("a", "b")).alias("day"), "at").groupBy("group", "day").agg(F.max("at").alias("seen_until"))


def run_claims(items: DataFrame, log: DataFrame, data_type: str, lease_hours: int, low: str, high: str) -> DataFrame:
    """Claims (CaseId, token, event, at, lease_until) of the lines of a run log on items (CaseId, first_seen, region, day).

    Every line leases the items of its region and update days that had been delivered when it started; a successful line also commits
    them. Its token is its start in microseconds. Of the lines over one region and day the latest lease and the latest commit say
    all: an item was there for an earlier line only if it was there for the latest. So each item meets at most four claims,
    by equi-joins on (region, day) and on the day of lines of region 'global'.
    """
    norm = lambda c: F.lower(F.trim(c))
    dated = ("QueryStartDate", "QueryEndDate", "DataEndDate", "RunStartedAt")
    lines = log.where((F.col("PolisDataType") == data_type) & F.expr(" and ".join(f"{c} is not null" for c in dated)))
    args = (F.col("QueryStartDate"), F.least("QueryEndDate", "DataEndDate"), norm(F.col("Region")), F.col("RunStartedAt"), low, high)
    success = F.coalesce(F.col("RunStatus") == "success", F.lit(False))
    leases = covered_days(lines, *args).withColumnRenamed("seen_until", "leased")
    commits = covered_days(lines.where(success), *args).withColumnRenamed("seen_until", "done")
    cells = leases.join(commits, ["group", "day"], "left")
    here = cells.where("group <> 'global'").select(F.col("group").alias("region"), "day", F.col("leased").alias("l0"), F.col("done").alias("d0"))
    everywhere = cells.where("group = 'global'").select("day", F.col("leased").alias("l1"), F.col("done").alias("d1"))
    j = join_dimension(items, here, ["region", "day"], "left", spread=F.col("CaseId"))
    j = join_dimension(j, everywhere, ["day"], "left", spread=F.col("CaseId"))
    kinds = [F.struct(F.lit(e).alias("event"), F.col(c).alias("at")) for c, e in (("l0", "lease"), ("l1", "lease"), ("d0", "lease"), ("d0", "done"), ("d1", "lease"), ("d1", "done"))]
    seen = F.filter(F.array(*kinds), lambda k: k["at"] >= F.col("first_seen"))
    c = j.select("CaseId", F.explode(seen).alias("k")).select("CaseId", "k.event", "k.at")
    until = F.when(F.col("event") == "lease", F.col("at") + F.expr(f"interval {int(lease_hours)} hours"))
    return c.select("CaseId", F.expr("timestampdiff(microsecond, timestamp_ntz'1970-01-01', at)").alias("token"), "event", "at", until.alias("lease_until"))


def outstanding_versions(cases: DataFrame, log: DataFrame, data_type: str = "Case", now: datetime | None = None, lease_hours: int = 24) -> DataFrame:
    """(case_id, version_no, state): the newest version of every record with its ledger state.

    Items are record versions; the lines of the run log are claims on them (run_claims), and item_states decides: a successful line
    commits its items; any other line (failed, running, without status) is a lease that runs out lease_hours after its start
    and then leaves its items pending. now: the time of the question, by default after every lease has run out. The fencing
    token of a line is its start: what was delivered after it cannot have been read by it. A region is compared in lower case
    without outer spaces; 'global' stands for every region. Records without id or version, and log lines without region, start or
    dates, match nothing; a version whose update date is missing is covered by nothing, one whose region is missing by global lines
    only. Empty tables give no rows.
    """
    items = cases.where("CaseId is not null and VersionNo is not null").groupBy("CaseId", "VersionNo").agg(
        F.min("ReceivedAt").alias("first_seen"),
        F.max(F.lower(F.trim("WHORegion"))).alias("region"),
        F.max(F.to_date("LastUpdateDate")).alias("day"),
    )
    newest = items.groupBy("CaseId").agg(F.max_by(F.struct("VersionNo", "first_seen", "region", "day"), "VersionNo").alias("v")).select("CaseId", "v.*")
    span = cases.agg(F.min(F.to_date("LastUpdateDate")), F.max(F.to_date("LastUpdateDate"))).first()
    low, high = (str(x) if x else "1970-01-01" for x in span)
    asked = F.lit(now or datetime(9999, 12, 31)).cast("timestamp_ntz")
    states = item_states(newest, run_claims(newest, log, data_type, lease_hours, low, high), asked, ["CaseId"])
    return states.select(F.col("CaseId").alias("case_id"), F.col("VersionNo").alias("version_no"), "state")
