"""Similarity join of texts as sets of character pairs, by prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark.plans.joins import BROADCAST_BYTES, BROADCAST_ROWS, join_dimension
from vigilark.session import materialise

#: Bytes of a token in a set, with its place in the array.
TOKEN_BYTES = 16


def with_pairs(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with `out`, the set of padded character pairs of a text, a pair that occurs again numbered: ABAB -> ^A1 AB1 BA1 AB2 B$1.
    An empty text has the pair ^$."""
    d = df.withColumn("__t", F.concat(F.lit("^"), text, F.lit("$")))
    d = d.withColumn("__q", F.transform(F.sequence(F.lit(1), F.length("__t") - 1), lambda i: F.substring(F.col("__t"), i, F.lit(2))))
    nth = lambda p, i: F.size(F.filter(F.slice(F.col("__q"), F.lit(1), i + 1), lambda q: q == p))
    return d.withColumn(out, F.transform("__q", lambda p, i: F.concat(p, nth(p, i).cast("string")))).drop("__t", "__q")


def similarity_join(left: DataFrame, right: DataFrame, key: str, text: str, scope: str, threshold: float) -> DataFrame:
    """(lk, rk, jaccard): the keys of all pairs of one scope whose pair sets have at least this Jaccard similarity.

    Both sides have (key, scope, text); text is compared as it is, keys are unique on each side. Null and empty texts and null scopes
    match nothing.

    The tokens of every set are ordered by their rarity on the right side. Two sets that reach the threshold share a token among the
    first few of each, so only these prefixes are joined; what meets passes a length and a position filter, then the similarity is
    computed exactly. Sets are made and ordered in one pass and written once. A scope or token that most texts have cannot make a task
    of its own: the right side's rarities and prefixes are broadcast while they are small (their bound follows from the lengths of its
    texts), else joined under salts of the left keys.
    """
    n = F.length(text) + 1  # tokens of a text; its prefix has at most so many rows of all its tokens
    tokens, size = right.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.sum(n * (n * TOKEN_BYTES + F.octet_length(key))), F.lit(0))).first()
    small = tokens <= BROADCAST_ROWS and size <= BROADCAST_BYTES

    def side(df: DataFrame, k: str) -> DataFrame:
        d = df.select(F.lit(k).alias("side"), F.col(key).alias("key"), F.col(scope).alias("scope"), F.col(text).alias("text")).where("text <> '' and scope is not null")
        # explode_outer: a plain explode would evaluate the set a second time to test its size
        return with_pairs(d, "text", "set").select("side", "key", "scope", F.explode_outer("set").alias("token"))

    def join(a: DataFrame, b: DataFrame, on: list[str], how: str, spread: str) -> DataFrame:
        return a.join(F.broadcast(b), on, how) if small else join_dimension(a, b, on, how, max_rows=0, spread=F.col(spread))

    rarity = side(right, "r").groupBy("token").agg(F.count("*").alias("freq"))
    t = join(side(left, "l").unionByName(side(right, "r")), rarity, ["token"], "left", "key")
    # tokens the right side does not hold come first
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("f"), F.col("token").alias("t"))))
    ordered = materialise(t.groupBy("side", "key", "scope").agg(order.alias("s")).select("side", "key", "scope", F.col("s.t").alias("tokens")), "ordered")

    def prefixed(p: str) -> DataFrame:
        n = F.size("tokens")
        head = (n - F.ceil(F.lit(threshold) * n) + 1).cast("int")
        return ordered.where(F.col("side") == p).select(F.col("key").alias(f"{p}k"), "scope", F.col("tokens").alias(p), F.posexplode(F.slice("tokens", F.lit(1), head)).alias(f"{p}_pos", "token"))

    j = join(prefixed("l"), prefixed("r"), ["scope", "token"], "inner", "lk")
    nl, nr = F.size("l"), F.size("r")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (nl + nr) - F.lit(1e-9))
    j = j.where((nl >= F.lit(threshold) * nr) & (nr >= F.lit(threshold) * nl))
    # overlap still possible with this token as a common one: what lies before it, and what lies from it on
    j = j.where(F.least("l_pos", "r_pos") + F.least(nl - F.col("l_pos"), nr - F.col("r_pos")) >= need)
    common = F.size(F.array_intersect("l", "r"))
    j = j.withColumn("jaccard", common / (nl + nr - common)).where(F.col("jaccard") >= threshold)
    return j.groupBy("lk", "rk").agg(F.max("jaccard").alias("jaccard"))
