"""Column profiles by load: counts, induced expressions, rule findings.

Values are counted per load and column. All distinct values of a column together induce regular expressions by minimum description length;
every value is then matched against the expression of its kind, and rows are counted per load, column and expression. This small
table of coverage carries everything else: standard aggregates, rows that break a rule or no expression holds, and what changed between loads.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilark.plans.joins import join_dimension
from vigilark.session import bounded_by, collect_bounded, materialise, materialise_all

#: Kinds of runs with their expressions: upper-case letters, other letters and marks, digits, spaces, punctuation, anything else. In
#: signatures a run is one sign of the private use area; punctuation stands for itself.
CLASSES = {"A": r"\p{Lu}", "a": r"[\p{L}\p{M}&&[^\p{Lu}]]", "9": r"\p{N}", "s": r"\s", "x": r"[^\p{L}\p{M}\p{N}\s\p{P}\p{S}]"}
SIGNS = {k: chr(0xE001 + i) for i, k in enumerate(CLASSES)}
_RUN = "(" + "|".join(f"{c}+" for c in CLASSES.values()) + r"|[\p{P}\p{S}])"
#: Bits of one element of an expression: its kind, and whether its length varies.
ELEMENT_BITS = log2(len(CLASSES)) + 1
#: Texts an element may offer as alternatives, and values an expression may list. More are described by their kind.
MAX_ALTERNATIVES, MAX_LISTED = 16, 64
#: Columns of a table.
MAX_COLUMNS = 10_000


def value_counts(df: DataFrame, load: str, columns: Sequence[str]) -> DataFrame:
    """(load, column_name, value, n): how often each column holds each value in each load; value as text, null kept.

    One pass over the table; equal values meet in the map-side aggregation, so a value that fills a third of the rows
    costs no more than any other.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
    rows = df.where(F.col(load).isNotNull()).select(F.col(load).alias("load"), cells.alias("c"))
    return rows.groupBy("load", F.col("c.column_name").alias("column_name"), F.col("c.value").alias("value")).agg(F.count("*").alias("n"))


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.btrim(c, F.lit(" \t\n\x0b\f\r")) == "")


#: The same kinds of runs where all characters are ASCII, which is much faster to search.
_ASCII = {"A": "[A-Z]+", "a": "[a-z]+", "9": "[0-9]+", "s": r"[ \t-\r]+", "x": r"[\x00-\x08\x0e-\x1f\x7f]+"}


def signature(c: Column) -> Column:
    """The kinds of runs of a text in their order, punctuation as it is. Whole numbers, which fill most of large tables, need no search."""
    out = F.regexp_replace(c, "[" + "".join(SIGNS.values()) + "]", SIGNS["x"])
    for k in ("A", "a", "9", "s"):
        out = F.regexp_replace(out, CLASSES[k] + "+", SIGNS[k])
    out = F.regexp_replace(out, r"[^\p{P}\p{S}" + "".join(v for k, v in SIGNS.items() if k != "x") + "]+", SIGNS["x"])
    plain = c
    for k, run in _ASCII.items():
        plain = F.regexp_replace(plain, run, SIGNS[k])
    number = F.when(F.startswith(c, F.lit("-")), "-" + SIGNS["9"]).otherwise(SIGNS["9"])
    return F.when(c.rlike(r"^-?[0-9]+\z"), number).when(F.octet_length(c) == F.length(c), plain).otherwise(out)


def _quoted(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\^$.|?*+()\[\]{}&\-])", r"\\$1")


def _gamma(n: Column) -> Column:
    """Bits of a number from 0 on, in Elias' gamma code."""
    return 2 * F.length(F.bin(n + 1)) - 1


def _alphabets(values: DataFrame) -> DataFrame:
    """(column_name, all_rows, alphabet, of_0 ...): rows and distinct characters of each column, all of them and by kind; one row per column.
    A column with whole numbers has all ten digits."""
    digits = F.array(*[F.lit(str(i)) for i in range(10)])
    plain = values.where(F.col("sig") == SIGNS["9"]).select("column_name").distinct().select("column_name", F.explode(digits).alias("c"))
    chars = values.where(F.col("sig") != SIGNS["9"]).select("column_name", F.explode(F.array_distinct(F.split("value", ""))).alias("c"))
    chars = chars.unionByName(plain).distinct()
    per = chars.groupBy("column_name").agg(F.count("*").alias("alphabet"), *[F.count_if(F.col("c").rlike(f"^{e}")).alias(f"of_{i}") for i, e in enumerate(CLASSES.values())])
    return per.join(values.groupBy("column_name").agg(F.sum("n").alias("all_rows")), "column_name")


def induce_expressions(values: DataFrame) -> DataFrame:
    """(column_name, sig, expression, conforming): regular expressions per column by minimum description length over all values.

    values has (column_name, value, n) and perhaps `sig` (see signature), blank values left out, one row per distinct value. Values
    of one signature are one group; its expression is the cheapest of

    - a list of its values, at most MAX_LISTED, of which those are listed that cost less so than as exceptions;
    - its elements one after the other: a text that never varies, at most MAX_ALTERNATIVES alternatives, a kind of characters of one
      length or of a range of lengths. A tail that only some values have becomes optional where two groups agree in what is before it.

    Every row's value is written, so that a code list of few but frequent values is as regular as many different ones, either

    - by an expression: the log2 of one over the expression's share of the rows (its choice), then of each element what varies: which of
      the alternatives, the length, each character among those the column has of that kind. The expression itself costs its
      characters in the column's alphabet, its kinds and lengths, and its number of rows (the log2 of all rows); or
    - as an exception: the log2 of one over the share of all exceptions, then its characters in the column's own
      alphabet with a sign for the end.

    Groups are ordered by the bits a value saves, in quarters of a bit, and the beginning of this order with the least total length
    conforms. Where no expression pays, as in a column of very few rows, none does. The expression of a conforming group matches each of
    its values but those left off a list. Nothing is collected; a column has at most 513 steps of that order. No values give no rows.
    """
    if "sig" not in values.columns:
        values = values.withColumn("sig", signature(F.col("value")))
    values = values.select("column_name", "value", "n", "sig")
    runs = F.when(F.col("sig") == SIGNS["9"], F.array("value")).otherwise(F.regexp_extract_all("value", F.lit(_RUN), F.lit(1)))
    v = materialise(values.withColumn("runs", runs), "distinct-values")
    letter = F.log2(F.col("alphabet") + 1)  # bits of a character written out
    key = ["column_name", "sig"]

    # groups, and what they cost as exceptions
    groups = v.groupBy(*key).agg(F.count("*").alias("n_values"), F.sum("n").alias("n_rows"), F.sum(F.col("n") * (F.length("value") + 1)).alias("signs"))

    # elements: one row per group and place
    e = v.select(*key, "n", F.posexplode("runs").alias("place", "text"))
    e = e.groupBy(*key, "place").agg(
        F.min(F.length("text")).alias("low"), F.max(F.length("text")).alias("high"),
        F.sum(F.col("n") * F.length("text")).alias("chars"), F.sum("n").alias("rows"), F.approx_count_distinct("text", 0.1).alias("about"),
    )
    # one row per column of the table; per signature; per signature and place
    per_column, groups, e = materialise_all((_alphabets(v), "alphabets"), (groups, "signatures"), (e, "elements"))
    some = e.where(F.col("about") <= 2 * MAX_ALTERNATIVES).select(*key, "place")
    some = bounded_by(some, e)
    t = join_dimension(v.select(*key, "value", "n", F.posexplode("runs").alias("place", "text")), some, [*key, "place"], "left_semi", spread=F.col("value"))
    t = t.groupBy(*key, "place", "text").agg(F.sum("n").alias("n")).groupBy(*key, "place").agg(
        F.count("*").alias("k"), F.sum(F.length("text") + 1).alias("written"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"), F.array_sort(F.collect_list("text")).alias("texts"),
    )  # at most about 2 MAX_ALTERNATIVES texts each
    t = t.where(F.col("k") <= MAX_ALTERNATIVES)
    e = e.join(t, [*key, "place"], "left").join(F.broadcast(per_column), "column_name")  # both sides have one row per key
    kind = F.substring("sig", F.col("place") + 1, F.lit(1))
    size = F.lit(1.0)
    cls = F.lit("")
    for i, (k, x) in enumerate(CLASSES.items()):
        size, cls = F.when(kind == SIGNS[k], F.greatest(F.col(f"of_{i}"), F.lit(1)).cast("double")).otherwise(size), F.when(kind == SIGNS[k], x).otherwise(cls)
    number = lambda c: F.col(c).cast("string")
    span = F.when(F.col("low") == F.col("high"), F.when(F.col("low") == 1, "").otherwise(F.concat(F.lit("{"), number("low"), F.lit("}")))).otherwise(F.concat(F.lit("{"), number("low"), F.lit(","), number("high"), F.lit("}")))
    by_kind = ELEMENT_BITS + _gamma(F.col("low")) + _gamma(F.col("high") - F.col("low")) + F.col("rows") * F.log2(F.col("high") - F.col("low") + 1) + F.col("chars") * F.log2(size)
    by_text = F.when(F.col("texts").isNotNull(), 1 + F.col("written") * letter + F.col("rows") * F.log2("rows") - F.col("nlogn"))
    fixed = F.coalesce(F.col("k") == 1, F.lit(False))
    text = F.element_at("texts", 1)
    listed = F.concat(F.lit("(?:"), F.array_join(F.transform("texts", _quoted), "|"), F.lit(")"))
    e = e.withColumns({
        "bits": F.round(F.when(fixed, F.length(text) * letter + 1).otherwise(F.least(by_kind, by_text)), 6),
        "element": F.when(fixed, _quoted(text)).when(F.round(by_text, 6) <= F.round(by_kind, 6), listed).otherwise(F.concat(cls, span)),
    })
    # a group has as many elements as its signature is long
    e = e.groupBy(*key).agg(F.sum("bits").alias("e_bits"), F.array_sort(F.collect_list(F.struct("place", "element")))["element"].alias("elements"))

    # lists: the values of small groups, each listed if that is cheaper than n exceptions
    few = bounded_by(groups.where(F.col("n_values") <= MAX_LISTED).select(*key, F.col("n_rows").alias("g_rows")), groups)
    w = join_dimension(v.select(*key, "value", "n"), few, key, "inner", spread=F.col("value")).join(F.broadcast(per_column), "column_name")
    as_listed = (F.length("value") + 1) * letter + F.col("n") * F.log2(F.col("g_rows") / F.col("n"))
    w = w.where(as_listed < F.col("n") * (F.length("value") + 1) * letter)
    w = w.groupBy(*key).agg(F.sum(as_listed).alias("l_bits"), F.sum("n").alias("l_rows"), F.sum(F.col("n") * (F.length("value") + 1)).alias("l_signs"), F.array_sort(F.collect_list("value")).alias("listed"))

    g = groups.join(e, key).join(w, key, "left").join(F.broadcast(per_column), "column_name")
    choice = lambda rows: F.log2(F.col("all_rows") + 1) + rows * F.log2(F.col("all_rows") / rows)
    saved_e = F.col("e_bits") + choice(F.col("n_rows")) - F.col("signs") * letter
    saved_l = F.col("l_bits") + choice(F.col("l_rows")) - F.col("l_signs") * letter
    # rounded, as sums of doubles depend on their order
    g = g.withColumn("as_list", F.coalesce(F.round(saved_l, 6) <= F.round(saved_e, 6), F.lit(False)))
    g = g.withColumns({"more": F.when(F.col("as_list"), saved_l).otherwise(saved_e), "held": F.when(F.col("as_list"), F.col("l_rows")).otherwise(F.col("n_rows"))})
    g = g.withColumn("step", F.least(F.lit(256), F.greatest(F.lit(-256), F.ceil(F.round(4 * F.col("more") / F.col("held"), 6)))).cast("int"))
    g = materialise(g.select(*key, "as_list", "elements", "listed", "more", "held", "step", "all_rows"), "candidates")
    steps = g.groupBy("column_name", "step").agg(F.sum("more").alias("more"), F.sum("held").alias("r"), F.max("all_rows").alias("all_rows"))
    order = Window.partitionBy("column_name").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("all_rows") - F.sum("r").over(order)
    total = F.sum("more").over(order) + left * F.log2((F.col("all_rows") + 1) / (left + 1))
    cut = steps.select("column_name", "step", F.round(total, 6).alias("total")).where("total < 0")  # 0: everything is an exception
    cut = cut.groupBy("column_name").agg(F.min(F.struct("total", "step"))["step"].alias("cut"))  # at most one row per column
    g = g.join(F.broadcast(cut), "column_name", "left").withColumn("conforming", F.coalesce(F.col("step") <= F.col("cut"), F.lit(False)))
    return _with_optional_tails(g).select(*key, "expression", "conforming")


def _with_optional_tails(g: DataFrame) -> DataFrame:
    """g with `expression`. A group whose elements begin with all elements of another conforming group of its column, the longest such
    one, shares that group's expression with the rest as an optional tail, if no other group with more rows does: this saves writing
    the beginning twice. The pairs meet by equality of the beginning."""
    body = F.array_join("elements", "")
    plain = F.when(F.col("as_list"), F.concat(F.lit("(?:"), F.array_join(F.transform("listed", _quoted), "|"), F.lit(")"))).otherwise(body)
    g = g.withColumn("body", plain)
    free = g.where(F.col("conforming") & ~F.col("as_list"))
    short = free.select("column_name", "body", F.col("sig").alias("short_sig"), F.size("elements").alias("size"))
    cuts = F.explode(F.transform(F.sequence(F.lit(1), F.size("elements") - 1), lambda k: F.struct(F.array_join(F.slice("elements", 1, k), "").alias("body"), F.array_join(F.slice("elements", k + 1, F.size("elements")), "").alias("tail"))))
    long = free.where(F.size("elements") > 1).select("column_name", "sig", "held", cuts.alias("c")).select("column_name", "sig", "held", "c.body", "c.tail")
    pairs = long.join(short, ["column_name", "body"])
    pairs = pairs.groupBy("column_name", "sig").agg(F.max_by(F.struct("short_sig", "body", "tail", "held"), F.struct("size", "body")).alias("p")).select("column_name", "sig", "p.*")
    pairs = pairs.groupBy("column_name", "short_sig").agg(F.max_by(F.struct("sig", "body", "tail"), F.struct("held", "sig")).alias("p")).select("column_name", "short_sig", "p.*")
    # a group is the beginning of one pair or the longer one of one pair, not both
    chained = pairs.select("column_name", F.col("short_sig").alias("sig"))
    pairs = pairs.join(chained, ["column_name", "sig"], "left_anti")
    both = pairs.select("column_name", F.explode(F.array("sig", "short_sig")).alias("sig"), F.concat(F.lit("^"), "body", F.lit("(?:"), "tail", F.lit(")?$")).alias("joint"))
    return g.join(both, ["column_name", "sig"], "left").withColumn("expression", F.coalesce("joint", F.concat(F.lit("^"), "body", F.lit("$"))))


def kinds_of_values(counts: DataFrame) -> DataFrame:
    """value counts with `blank` and, of other values, `sig`. Written once."""
    c = counts.withColumn("blank", is_blank(F.col("value")))
    return materialise(c.withColumn("sig", F.when(~F.col("blank"), signature(F.col("value")))), "counts")


def matched_values(kinds: DataFrame) -> DataFrame:
    """kinds_of_values with the `expression` of the value's group and whether the value conforms: its group does, and the
    expression matches it. Blank values have none."""
    full = kinds.where(~F.col("blank")).groupBy("column_name", "sig", "value").agg(F.sum("n").alias("n"))
    induced = materialise(induce_expressions(full), "expressions")
    j = join_dimension(kinds, induced, ["column_name", "sig"], "left", spread=F.col("value"))
    # an expression is compiled once for the values beside each other
    j = j.sortWithinPartitions("column_name", "expression")
    return j.withColumn("conforming", F.coalesce(F.col("conforming") & F.expr("value rlike expression"), F.lit(False)))


def _number(c: Column) -> Column:
    """The number a text stands for; a failed cast costs an exception, so only what looks like a number is cast."""
    return F.when(c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), c.try_cast("double"))


def coverage(matched: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(load, column_name, expression, ...): rows, nulls, distinct values, numbers and broken rules per load, column and expression, from
    matched_values; the expression is null for rows that no expression holds. One aggregation; rules come to the driver, a row per column."""
    v, n = F.col("value"), F.col("n")
    rule = {}
    for r in collect_bounded(rules.dropDuplicates(["column_name"]), MAX_COLUMNS, "rules") if rules is not None else []:
        rule[r.column_name] = r

    def of(test) -> Column:
        """test(rule) of the value's own column; columns without a rule break none."""
        out = None
        for k, r in rule.items():
            t = test(r)
            if t is not None:
                out = F.when(F.col("column_name") == k, t) if out is None else out.when(F.col("column_name") == k, t)
        return F.coalesce(out, F.lit(False)) if out is not None else F.lit(False)

    live = ~F.col("blank")
    m = matched.withColumn("num", F.when(live, _number(v)))
    limit = lambda x: x is not None and x == x
    bad = {
        "n_nonmatching": live & of(lambda r: ~v.rlike(r.pattern) if r.pattern is not None else None),
        "n_below": of(lambda r: F.col("num") < r.min_value if limit(r.min_value) else None),
        "n_above": of(lambda r: F.col("num") > r.max_value if limit(r.max_value) else None),
        "n_nonconforming": live & ~F.col("conforming"),
    }
    zero = lambda c: F.coalesce(c, F.lit(0))
    return m.groupBy("load", "column_name", F.when(F.col("conforming"), F.col("expression")).alias("expression")).agg(
        F.sum(n).alias("n_rows"), zero(F.sum(F.when(~live, n))).alias("n_null"), F.count(F.when(live, 1)).alias("n_distinct"), F.min("num").alias("min_number"), F.max("num").alias("max_number"),
        *[zero(F.sum(F.when(t, n))).alias(k) for k, t in bad.items()],
    )


def _half_distance(units: DataFrame, totals: DataFrame, unit: str, name: str) -> DataFrame:
    """(load, column_name, name): half the sum of absolute differences of the shares of units (load, column_name, unit, n) between a load and
    the load before: 1 less what both have in common. A unit's loads meet in one group of at most as many rows as there are loads."""
    w = Window.partitionBy("column_name", unit).orderBy("load")
    prev = units.withColumns({"__l": F.lag("load").over(w), "__n": F.lag("n").over(w)}).where("__l = load - 1")
    now, before = totals.select("load", "column_name", F.col("live").alias("t1")), totals.select((F.col("load") + 1).alias("load"), "column_name", F.col("live").alias("t0"))
    both = bounded_by(now.join(before, ["load", "column_name"]), totals)
    common = join_dimension(prev, both, ["load", "column_name"], "inner", spread=F.col(unit))
    common = common.groupBy("load", "column_name").agg(F.sum(F.least(F.col("n") / F.col("t1"), F.col("__n") / F.col("t0"))).alias("__c"))
    return both.join(common, ["load", "column_name"], "left").select("load", "column_name", F.when((F.col("t0") > 0) & (F.col("t1") > 0), 1 - F.coalesce("__c", F.lit(0.0))).alias(name))


def column_profile(counts: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """One row per load and column from value_counts: standard aggregates, rule violations, coverage of the induced
    expressions and the shift against the load before.

    rules: (column_name, categorical, pattern, min_value, max_value, ...); a column without a rule has no pattern and no
    limits. Columns: n_rows, n_null (null or blank), n_distinct, min_number, max_number, n_nonmatching (of the
    rule's pattern), n_below, n_above, n_nonconforming (rows outside the induced expressions), distance (half the sum of absolute
    differences of value shares), coverage_distance (the same over induced expressions), prev_null_share,
    prev_distinct. The last four are null where load - 1 is absent; distances are null where either load has no values.
    A load or column without values has 0 counts and null ranges.
    """
    kinds = kinds_of_values(counts)
    cover = materialise(coverage(matched_values(kinds), rules), "coverage")
    sums = [F.sum(c).alias(c) for c in ("n_rows", "n_null", "n_distinct", "n_nonmatching", "n_below", "n_above", "n_nonconforming")]
    base = materialise(cover.groupBy("load", "column_name").agg(*sums, F.min("min_number").alias("min_number"), F.max("max_number").alias("max_number")), "profile")
    totals = bounded_by(base.select("load", "column_name", (F.col("n_rows") - F.col("n_null")).alias("live")), base)
    live = kinds.where(~F.col("blank")).select("load", "column_name", "value", "n")
    units = cover.select("load", "column_name", F.coalesce("expression", F.lit("")).alias("unit"), (F.col("n_rows") - F.col("n_null")).alias("n")).where("n > 0")
    prev = base.select((F.col("load") + 1).alias("load"), "column_name", (F.col("n_null") / F.col("n_rows")).alias("prev_null_share"), F.col("n_distinct").alias("prev_distinct"))
    on = ["load", "column_name"]
    return base.join(prev, on, "left").join(_half_distance(live, totals, "value", "distance"), on, "left").join(_half_distance(units, totals, "unit", "coverage_distance"), on, "left")


def profile_findings(profile: DataFrame, rules: DataFrame, max_nonconforming: float | None = None, max_coverage_distance: float | None = None) -> DataFrame:
    """(load, column_name, finding): the places where a load breaks a rule or departs from the load before.

    A null limit is no limit. Findings: 'pattern', 'range', 'null_step', 'distance' (categorical columns only),
    'distinct', each as described with column_rules. The rows counted for 'pattern' are those outside the rule's pattern; in a column whose
    rule has none, those outside the induced expressions. Given max_nonconforming, a column without a limit of its own is held to
    that share; given max_coverage_distance, 'coverage' says that a load is spread differently over the expressions. With either, columns
    without a rule count too.
    """
    every = max_nonconforming is not None or max_coverage_distance is not None
    p = join_dimension(profile, rules.dropDuplicates(["column_name"]), ["column_name"], "left" if every else "inner")
    live = F.col("n_rows") - F.col("n_null")
    null_share = F.col("n_null") / F.col("n_rows")
    wide, narrow = F.greatest("n_distinct", "prev_distinct"), F.least("n_distinct", "prev_distinct")
    no_nan = lambda c: F.when(~F.isnan(c), F.col(c))
    outside = F.when(F.col("pattern").isNotNull(), F.col("n_nonmatching")).otherwise(F.col("n_nonconforming"))
    tests = {
        "pattern": (live > 0) & (outside / live > F.coalesce(no_nan("max_bad_share"), F.lit(max_nonconforming).cast("double"))),
        "range": (F.col("n_below") + F.col("n_above")) > 0,
        "null_step": F.abs(null_share - F.col("prev_null_share")) > no_nan("max_null_step"),
        "distance": F.col("categorical") & (F.col("distance") > no_nan("max_distance")),
        "distinct": F.col("prev_distinct").isNotNull() & (wide > no_nan("max_distinct_ratio") * narrow),
        "coverage": F.col("coverage_distance") > F.lit(max_coverage_distance).cast("double"),
    }
    found = F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()])
    return p.select("load", "column_name", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("finding"))
