"""Date columns: parsing by trained formats, checks, half-years, rounds."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark.functions.dates import half_year_label, half_year_start, iso_prefix_date, leap_issue
from vigilark.plans.joins import join_dimension, row_id

# The orders a date text may have. Y year of four digits, y of two, B month by name, HMS and HM the time.
DATE_ORDERS = ("dmY", "mdY", "Ymd", "Ydm", "dmy", "mdy", "ymd", "ydm")
NAME_ORDERS = ("dBY", "BdY", "YBd", "dBy", "Bdy", "yBd")
TIME_ORDERS = tuple(f"{o} HMS" for o in DATE_ORDERS)
ALL_ORDERS = (*DATE_ORDERS, *TIME_ORDERS, *(f"{o} HM" for o in DATE_ORDERS), *NAME_ORDERS)
# Month names by number.
MONTH_NAMES = "jan feb mar apr may jun jul aug sep oct nov dec".split()

# The formats tried when a format is to be detected.
COMMON_FORMATS = (
    "%d-%m-%Y", "%m-%d-%Y", "%Y-%m-%d", "%Y-%d-%m", "%d/%m/%Y", "%m/%d/%Y", "%Y/%m/%d", "%Y/%d/%m", "%d.%m.%Y", "%m.%d.%Y",
    "%Y.%m.%d", "%Y.%d.%m", "%d %B %Y", "%B %d, %Y", "%d %b %Y", "%b %d, %Y", "%Y%m%d",
)


_NUMERIC = r"^\s*(\d{1,4})([-/., ]+)(\d{1,2})([-/., ]+)(\d{1,4})(?:[ T](\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?)?\s*$"
_NAMED = {
    "n": r"^\s*(\d{1,4})[-/., ]+([A-Za-z]{3,9})\.?[-/., ]+(\d{1,4})\s*$", "B": r"^\s*([A-Za-z]{3,9})\.?[-/., ]+(\d{1,2})[-/., ]+(\d{1,4})\s*$",
}


def date_parts(c: Column) -> Column:
    """What a date text is made of, or null: ARRAY of first, separator, second, separator, third, hour, minute, second; for digits without
    separators the array has the digits only, for a month by name n or B (what comes first) and the three parts."""
    numeric = F.split(F.regexp_replace(c, _NUMERIC, "$1|$2|$3|$4|$5|$6|$7|$8"), r"\|", -1)
    named = F.lit(None).cast("array<string>")
    for k, r in _NAMED.items():
        named = F.when(c.rlike(r), F.split(F.regexp_replace(c, r, f"{k}|$1|$2|$3"), r"\|", -1)).otherwise(named)
    return F.when(c.rlike(_NUMERIC), numeric).when(c.rlike(r"^\s*(\d{6}|\d{8})\s*$"), F.array(F.trim(c))).when(c.rlike("[A-Za-z]{3}"), named)


def date_numbers(p: Column, prefix: str) -> dict[str, Column]:
    """date_parts as columns of numbers under a prefix: kind (s with separators, t tight, n or B by name), the three parts x1 to x3 with their lengths,
    separators, clock (null where absent), month by name, digits. Orders only compare them. Columns, not a struct: fields of a struct made in the plan
    are replaced by their expressions, once for each use."""
    get = lambda i: F.get(p, F.lit(i))
    kind = F.when(F.size(p) == 8, "s").when(F.size(p) == 1, "t").when(F.size(p) == 4, get(0))
    part = lambda i: F.when(F.size(p) == 8, get(2 * (i - 1))).when(F.size(p) == 4, get(i))
    word = F.when(get(0) == "n", get(2)).when(get(0) == "B", get(1))
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    clock = lambda i: F.when((F.size(p) == 8) & (get(i) != ""), get(i).cast("int"))
    word_at = {1: get(0) != "B", 2: get(0) != "n", 3: F.lit(True)}  # a failed cast costs an exception, so words are not cast
    number = lambda i: F.when((F.size(p) == 8) | word_at[i], part(i).cast("int"))
    out = {"kind": kind} | {f"x{i}": number(i) for i in (1, 2, 3)} | {f"l{i}": F.length(part(i)) for i in (1, 2, 3)}
    out |= {"s1": get(1), "s2": get(3), "h": clock(5), "mi": clock(6), "s": clock(7), "digits": get(0)}
    out["name"] = F.array_position(names, F.lower(F.substring(word, 1, 3))).cast("int")
    return {f"{prefix}{k}": v for k, v in out.items()}


def _valid(year: Column, month: Column, day: Column) -> Column:
    """Whether there is such a day."""
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    long = (day <= 30) | month.isin(1, 3, 5, 7, 8, 10, 12)
    return month.between(1, 12) & (day >= 1) & (year >= 1) & ((day <= 28) | ((day <= 31) & ((month != 2) & long | (day == 29) & leap)))


def _make(year: Column, month: Column, day: Column, clock: tuple[Column, ...] = ()) -> Column:
    """TIMESTAMP_NTZ of integers, null where there is no such day or time."""
    ok = _valid(year, month, day)
    if not clock:
        return F.when(ok, F.make_date(year, month, day)).cast("timestamp_ntz")
    h, mi, sec = clock
    return F.when(ok & (h <= 23) & (mi <= 59) & (sec <= 59), F.make_timestamp_ntz(year, month, day, h, mi, sec))


def _full_year(n: Column, wide: bool) -> Column:
    return n if wide else F.when(n < 69, n + 2000).otherwise(n + 1900)


def order_date(n: str, order: str, separator: str | None = None) -> Column:
    """TIMESTAMP_NTZ of date_numbers (by their prefix) read in one order; null where they do not fit. separator: the one that must stand between the parts. Two-digit years
    below 69 are 20yy, others 19yy."""
    body, _, time = order.partition(" ")
    wide = "Y" in body
    at = {x.lower(): i + 1 for i, x in enumerate(body)}
    f = lambda k: F.col(f"`{n}{k}`")
    x = lambda k: f(f"x{at[k]}")
    sized = (f(f"l{at['y']}") == (4 if wide else 2)) & (f(f"l{at['d']}") <= 2)
    if "B" in body:
        fits = (f("kind") == ("B" if body[0] == "B" else "n")) & sized
        return F.when(fits, _make(_full_year(x("y"), wide), f("name"), x("d")))
    fits = (f("kind") == "s") & sized & (f(f"l{at['m']}") <= 2)
    if separator is not None:
        fits = fits & (f("s1") == separator) & (f("s2") == separator)
    number = (_full_year(x("y"), wide), x("m"), x("d"))
    if time == "HMS":
        return F.when(fits & f("s").isNotNull(), _make(*number, (f("h"), f("mi"), f("s"))))
    if time == "HM":
        return F.when(fits & f("h").isNotNull() & f("s").isNull(), _make(*number, (f("h"), f("mi"), F.lit(0))))
    loose = F.when(fits & f("h").isNull(), _make(*number))
    if separator is not None:
        return loose
    start, cut = 1, {}
    for k in body:
        cut[k.lower()] = (start, 4 if k == "Y" else 2)
        start += cut[k.lower()][1]
    get = lambda k: F.nullif(F.substring(f("digits"), *cut[k]), F.lit("")).cast("int")
    tight = F.when((f("kind") == "t") & (F.length(f("digits")) == start - 1), _make(_full_year(get("y"), wide), get("m"), get("d")))
    return F.when(f("kind") == "s", loose).otherwise(tight)


def _is_date(df: DataFrame, column: str) -> bool:
    return dict(df.dtypes)[column] in ("date", "timestamp", "timestamp_ntz")


def trained_orders(df: DataFrame, columns: Sequence[str], orders: Sequence[str]) -> dict[str, list[str]]:
    """Per column the orders that parse any of its texts, best first: longer orders, then four-digit years, then the
    number of texts parsed, then the place in the list. One aggregation for all columns; its result is one number per
    column and order. Columns of dates need no order and take no part."""
    texts = [c for c in columns if not _is_date(df, c)]
    out: dict[str, list[str]] = {c: [] for c in columns}
    if not texts:
        return out
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("t")) for i, c in enumerate(texts)])
    parts = df.select(F.explode(cells).alias("c")).select("c.i", date_parts(F.col("c.t")).alias("p")).where("p is not null")
    numbers = parts.select("i", *[v.alias(k) for k, v in date_numbers(F.col("p"), "n_").items()])
    # orders as rows, not as code: sixteen orders written out make a method too large for the JVM to compile
    tried = numbers.withColumn("o", F.explode(F.array(*[_order_row(j, o) for j, o in enumerate(orders)])))
    found = tried.where(_fits(F.col("o"))).groupBy("i", F.col("o.j").alias("j")).agg(F.count("*").alias("k")).collect()
    count = {(r.i, r.j): r.k for r in found}
    for i, c in enumerate(texts):
        n = [(o, count.get((i, j), 0), j) for j, o in enumerate(orders)]
        out[c] = [o for o, k, j in sorted((x for x in n if x[1]), key=lambda x: (-len(x[0]), "Y" not in x[0], -x[1], x[2]))]
    return out


def _order_row(j: int, order: str) -> Column:
    """An order as data: where year, month and day stand, how long the year is, which clock it has, what kind of text it reads."""
    body, _, time = order.partition(" ")
    at = {x.lower(): i for i, x in enumerate(body)}
    start, cut = 1, {}
    for x in body:
        cut[x.lower()] = start
        start += 4 if x == "Y" else 2
    named = "b" in at
    fields = {
        "j": j, "y": at["y"], "m": at.get("m", -1), "d": at["d"], "wide": 4 if "Y" in body else 2, "clock": {"": 0, "HM": 1, "HMS": 2}[time], "kind": ("B" if body[0] == "B" else "n") if named else "s",
        "cy": cut["y"], "cm": cut.get("m", 1), "cd": cut["d"], "full": start - 1, "tight": not named and not time,
    }
    return F.struct(*[F.lit(v).alias(k) for k, v in fields.items()])


def _fits(o: Column) -> Column:
    """Whether date_numbers (prefix n_) are a date in the order o; the same rule as order_date."""
    f = lambda k: F.col(f"n_{k}")
    xs, ls = F.array(f("x1"), f("x2"), f("x3")), F.array(f("l1"), f("l2"), f("l3"))
    tight = f("kind") == "t"
    cut = lambda a, n: F.nullif(F.substring(f("digits"), a, n), F.lit("")).cast("int")
    y = F.when(tight, cut(o["cy"], o["wide"])).otherwise(F.get(xs, o["y"]))
    m = F.when(tight, cut(o["cm"], F.lit(2))).when(o["m"] < 0, f("name")).otherwise(F.get(xs, F.greatest(o["m"], F.lit(0))))
    d = F.when(tight, cut(o["cd"], F.lit(2))).otherwise(F.get(xs, o["d"]))
    year = F.when(o["wide"] == 4, y).otherwise(F.when(y < 69, y + 2000).otherwise(y + 1900))
    shape = F.when(tight, o["tight"] & (F.length(f("digits")) == o["full"])).otherwise(
        (f("kind") == o["kind"]) & (F.get(ls, o["y"]) == o["wide"]) & (F.get(ls, o["d"]) <= 2) & ((o["m"] < 0) | (F.get(ls, F.greatest(o["m"], F.lit(0))) <= 2))
    )
    clock = F.when(o["clock"] == 0, f("h").isNull()).when(o["clock"] == 1, f("h").isNotNull() & f("s").isNull() & (f("h") <= 23) & (f("mi") <= 59))
    clock = clock.otherwise(f("s").isNotNull() & (f("h") <= 23) & (f("mi") <= 59) & (f("s") <= 59))
    return shape & clock & _valid(year, m, d)


def with_trained(df: DataFrame, columns: dict[str, str], best: dict[str, list[str]]) -> DataFrame:
    """df with one TIMESTAMP_NTZ column per entry of columns (name -> source column), read by the orders trained for the source."""
    parts, numbers, new = {}, {}, {}
    for k, c in columns.items():
        if _is_date(df, c):
            new[k] = F.col(f"`{c}`").cast("timestamp_ntz")
        elif best.get(c):
            parts[f"__p_{k}"] = date_parts(F.col(f"`{c}`").cast("string"))
            numbers |= date_numbers(F.col(f"`__p_{k}`"), f"__n_{k}_")
            new[k] = F.coalesce(*[order_date(f"__n_{k}_", o) for o in best[c]])
        else:
            new[k] = F.lit(None).cast("timestamp_ntz")
    staged = df.withColumns(parts).withColumns(numbers) if parts else df
    return staged.withColumns(new).drop(*parts, *numbers)


def _iso_instant(c: Column) -> Column:
    """Texts with a T in them as ISO date and time; an offset is applied, the result is UTC."""
    return F.when(c.contains("T"), F.try_to_timestamp(c).cast("timestamp_ntz"))


def autoparse_dates(df: DataFrame, columns: Sequence[str], output_format: str | None = None, extra_orders: Sequence[str] = (), local_date: bool = False) -> DataFrame:
    """df with the columns parsed: DATE, or text in output_format (a Spark pattern).

    Texts that denote no date become null. Texts with T are ISO instants in UTC; local_date keeps the written date instead. What
    d-m and m-d mean is decided per column by the number of texts each can read.
    """
    orders = (*ALL_ORDERS, *extra_orders)
    best = trained_orders(df, columns, orders)
    parsed = with_trained(df, {f"__t_{c}": c for c in columns}, best)
    new = {}
    for c in columns:
        t, s = F.col(f"`__t_{c}`"), F.col(f"`{c}`").cast("string")
        if not _is_date(df, c):
            iso = iso_prefix_date(s).cast("timestamp_ntz") if local_date else _iso_instant(s)
            t = F.when(s.contains("T"), F.coalesce(iso, t)).otherwise(t)
        new[c] = t.cast("date") if output_format is None else F.date_format(t, output_format)
    return parsed.withColumns(new).drop(*[f"__t_{c}" for c in columns])


ONE_TESTS = ("missing", "non_date", "sensible", "leap_year", "format")
TWO_TESTS = (*ONE_TESTS, "similarity", "order")


def iso_text(ts: Column) -> Column:
    """A point in time as ISO text, without the time at midnight."""
    midnight = F.date_format(ts, "HH:mm:ss") == "00:00:00"
    return F.when(midnight, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))


def date_flags(text: Column, name: str, tests: Sequence[str], min_year: int, as_of: date) -> dict[str, Column]:
    """The checks of one normalised date text, as columns by name."""
    d = iso_prefix_date(text)
    bad = d.isNull() & text.isNotNull()
    leap = leap_issue(text)
    out = {}
    if "missing" in tests:
        out[f"{name}_missing"] = text.isNull()
    if "non_date" in tests:
        out[f"{name}_non_date"] = bad
    if "sensible" in tests:
        out[f"{name}_invalid"] = ~F.startswith(text, F.lit(str(min_year)[:2]))
        out[f"{name}_future"] = F.year(d) > as_of.year
    if "leap_year" in tests:
        out[f"{name}_leap_issue"] = leap
    if "format" in tests:
        out[f"{name}_format_issue"] = bad & ~leap
    return out


def validate_date(df: DataFrame, column: str, tests: Sequence[str] = ONE_TESTS, min_year: int = 2000, as_of: date | None = None) -> DataFrame:
    """df with the column rewritten as ISO text where any of 16 orders reads it, and one boolean column per check.

    <c>_missing, _non_date (no ISO date), _invalid (does not begin with the century of min_year), _future (year after as_of), _leap_issue,
    _format_issue (no ISO date, leap-day errors aside). Null dates are missing, their _invalid and _future are null.
    """
    as_of = as_of or date.today()
    best = trained_orders(df, [column], (*DATE_ORDERS, *TIME_ORDERS))
    parsed = with_trained(df, {"__t": column}, best)
    parsed = parsed.withColumn(column, F.coalesce(iso_text(F.col("__t")), F.col(f"`{column}`").cast("string"))).drop("__t")
    return parsed.withColumns(date_flags(F.col(f"`{column}`"), column, tests, min_year, as_of))


def validate_dates(df: DataFrame, first: str, second: str, tests: Sequence[str] = TWO_TESTS, min_year: int = 2000, as_of: date | None = None) -> DataFrame:
    """df with the checks of two date columns; the columns themselves stay as they are.

    Only texts with a time are normalised first. _invalid means a year outside min_year .. as_of; _format_issue counts leap-day errors
    too; <first>_invalid_order means first after second; with "similarity" <first>_same says whether both dates are equal.
    """
    as_of = as_of or date.today()
    best = trained_orders(df, [first, second], TIME_ORDERS)
    out = with_trained(df, {"__t0": first, "__t1": second}, best)
    out = out.withColumns({f"__s{i}": F.coalesce(iso_text(F.col(f"__t{i}")), F.col(f"`{c}`").cast("string")) for i, c in enumerate((first, second))})
    out = out.withColumns({f"__d{i}": iso_prefix_date(F.col(f"__s{i}")) for i in range(2)})
    new, days = {}, {}
    for i, c in enumerate((first, second)):
        s = F.col(f"__s{i}")
        d = days[c] = F.col(f"__d{i}")
        bad = d.isNull() & s.isNotNull()
        if "missing" in tests:
            new[f"{c}_missing"] = s.isNull()
        if "non_date" in tests:
            new[f"{c}_non_date"] = bad
        if "sensible" in tests:
            new[f"{c}_invalid"] = ~F.year(d).between(min_year, as_of.year)
            new[f"{c}_future"] = F.year(d) > as_of.year
        if "leap_year" in tests:
            new[f"{c}_leap_issue"] = leap_issue(s)
        if "format" in tests:
            new[f"{c}_format_issue"] = bad
    if "similarity" in tests:
        new[f"{first}_same"] = days[first] == days[second]
    if "order" in tests:
        new[f"{first}_invalid_order"] = days[first] > days[second]
    return out.withColumns(new).drop("__t0", "__t1", "__s0", "__s1", "__d0", "__d1")


def format_date(n: str, fmt: str) -> Column:
    """TIMESTAMP_NTZ of date_numbers by a strptime-like format of d, m, Y, y, B and b: three of these with one separator, spaces and a comma round a
    month's name, or nothing between digits."""
    body = "".join(x for x in fmt.replace("%b", "%B") if x.isalpha())
    seps = [x for x in "".join(" " if y.isalpha() else y for y in fmt.replace("%", "")).split() if x]
    if "B" in body:
        return order_date(n, body)
    if not seps:
        return F.when(F.col(f"`{n}kind`") == "t", order_date(n, body))
    return order_date(n, body, seps[0])


def detect_date_format(df: DataFrame, column: str, formats: Sequence[str] = COMMON_FORMATS) -> DataFrame:
    """One row (format, parsed): the first format that reads the most texts; format is null if none reads any."""
    parts = df.select(date_parts(F.col(f"`{column}`").cast("string")).alias("p"))
    parts = parts.select(*[v.alias(k) for k, v in date_numbers(F.col("p"), "n_").items()])
    counts = parts.agg(*[F.count(format_date("n_", f)).alias(str(i)) for i, f in enumerate(formats)])
    rows = F.array(*[F.struct(F.col(str(i)).alias("parsed"), F.lit(-i).alias("place"), F.lit(f).alias("format")) for i, f in enumerate(formats)])
    best = counts.select(F.array_max(rows).alias("b"))
    return best.select(F.when(F.col("b.parsed") > 0, F.col("b.format")).alias("format"), F.col("b.parsed").alias("parsed"))


def categorize_biannual(df: DataFrame, column: str, name: str = "custom_biannual") -> DataFrame:
    """df with the label of the half-year and its first day as the order of the labels."""
    d = F.col(f"`{column}`").cast("date")
    return df.withColumns({name: half_year_label(d), f"{name}_ord": half_year_start(d)})


#: Distinct days of one group that clustering takes at once: all days of 270 years.
MAX_DAYS = 100_000


def complete_linkage(days: np.ndarray, threshold: float) -> np.ndarray:
    """Cluster numbers of sorted distinct days: complete linkage, cut at `threshold`.

    On a line only neighbours can merge, and the distance of two clusters is the span of both; of several nearest pairs the leftmost
    merges first.
    """
    import heapq

    n = len(days)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    lo, hi, alive, stamp = list(days), list(days), [True] * n, [0] * n
    heap = [(days[i + 1] - days[i], i, i + 1, 0, 0) for i in range(n - 1)]
    heapq.heapify(heap)
    parent = list(range(n))
    while heap:
        d, i, j, si, sj = heapq.heappop(heap)
        if d > threshold:
            break
        if not (alive[i] and alive[j]) or stamp[i] != si or stamp[j] != sj:
            continue
        hi[i], alive[j], parent[j] = hi[j], False, i
        stamp[i] += 1
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
            k = right[i]
            heapq.heappush(heap, (hi[k] - lo[i], i, k, stamp[i], stamp[k]))
        if left[i] >= 0:
            k = left[i]
            heapq.heappush(heap, (hi[i] - lo[k], k, i, stamp[k], stamp[i]))
    root = np.zeros(n, int)
    for i in range(n):
        root[i] = i if parent[i] == i else root[parent[i]]
    return np.unique(root, return_inverse=True)[1]


def assign_round_number(df: DataFrame, column: str = "today", grouping: Sequence[str] = (), threshold: int = 7, name: str = "round") -> DataFrame:
    """df with the round of every date: days at most `threshold` apart in all cluster together; the label is the month of the
    cluster's first day, <name>_start that day. Fewer than two distinct days in a group, and null dates, give null.

    Only the distinct days of a group are clustered, at most MAX_DAYS of them (checked), in one task per group.
    """
    days = df.select(*grouping, F.col(f"`{column}`").cast("date").alias("__day")).where("__day is not null").distinct()
    keys = list(grouping) or ["__all"]
    if not grouping:
        days = days.withColumn("__all", F.lit(0))
    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in days.schema if f.name in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__day")
        if len(pdf) > MAX_DAYS:
            raise ValueError(f"more than {MAX_DAYS} distinct days in a group")
        d = pd.to_datetime(pdf["__day"])
        start = [None] * len(pdf)
        if len(pdf) > 1:
            days_since = d.dt.normalize().sub(pd.Timestamp(0)).dt.days.to_numpy()
            c = complete_linkage(days_since, threshold)
            first = pd.Series(days_since).groupby(c).min()
            start = [(pd.Timestamp(0) + pd.Timedelta(days=int(first[k]))).date() for k in c]
        return pdf.assign(__start=start)[[*keys, "__day", "__start"]]

    found = days.groupBy(*keys).applyInPandas(run, f"{key_types}, __day date, __start date")
    if not grouping:
        found = found.drop("__all")
    d = df.withColumn("__day", F.col(f"`{column}`").cast("date"))
    j = join_dimension(d, found, [*grouping, "__day"], "left", spread=row_id(d))
    return j.withColumns({name: F.date_format("__start", "MMM yyyy"), f"{name}_start": F.col("__start")}).drop("__day", "__start")
