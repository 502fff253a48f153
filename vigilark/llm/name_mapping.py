"""Typed names mapped to the entries of a reference list by a prefix-filtered set-similarity join.

Names become sets of character pairs and meet in operators.set_similarity: tokens ordered by rarity in the reference list, prefixes
joined, length and position filters, exact Jaccard. The best entry is kept; a check by edit distance decides which entries are
close enough to be meant at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark.functions.text import fold_accents, fold_lookalikes
from vigilark.operators.set_similarity import similarity_join
from vigilark.plans.joins import hot_keys, join_dimension
from vigilark.session import bounded_by, materialise, materialise_all

#: Jaccard similarity of pairs from which a pair of names is a candidate. Two letters changed in a name of six leave 3 of 11 pairs to 5 of 9.
THRESHOLD = 0.3
#: Edits allowed: this share of the longer name, by edit distance on the folded letters.
MAX_EDIT_SHARE = 0.4

# Words that say what kind of place a name is.
GENERIC_WORDS = (
    "DISTRICT", "DISTRICTS", "DISTRITO", "DIST", "PROVINCE", "PROVINCIA", "PROV", "REGION", "REGIAO", "STATE", "STATES", "COUNTY", "DEPARTMENT",
    "DEPARTEMENT", "DEPT", "COMMUNE", "LGA", "ZS", "ZONE", "REPUBLIC", "REPUBLIQUE", "REP", "KINGDOM", "FEDERATION", "UNION",
    "OF", "THE", "DE", "DU", "LA", "LE",
)


def letters(c: Column) -> Column:
    """Upper-case words of letters and digits, one space between words: accents, lookalikes, hidden characters and punctuation folded."""
    plain = fold_lookalikes(fold_accents(F.regexp_replace(c, r"[\p{Cf}\p{M}'’`]+", "")))
    return F.trim(F.regexp_replace(F.upper(plain), r"[^\p{L}\p{N}]+", " "))


def without_digits(c: Column) -> Column:
    """Digits that scanning or typing puts for letters become these letters."""
    return F.translate(c, "0134589", "OIEASBG")


def skeleton(c: Column) -> Column:
    """Spelling as it sounds, spaces dropped: PH as F, QU, Q and C as K, Y and L's lookalike I kept apart, doubled letters once."""
    out = F.regexp_replace(without_digits(c), " ", "")
    out = F.regexp_replace(out, "PH", "F")
    out = F.regexp_replace(out, "QUE$", "K")
    out = F.regexp_replace(out, "QU|Q", "K")
    out = F.regexp_replace(out, "C(?!H)|CK", "K")
    out = F.regexp_replace(out, "Y|J(?=[IY])", "I")
    return F.regexp_replace(out, r"(.)\1+", "$1")


def _swapped(c: Column) -> Column:
    """Two words the other way round; null for any other number of words."""
    return F.when(c.rlike(r"^\S+ \S+$"), F.regexp_replace(c, r"^(\S+) (\S+)$", "$2 $1"))


def _less(c: Column, words: Column) -> Column:
    """c without the given run of words at its start or end; null if that leaves nothing or c does not hold it there."""
    at_end = F.endswith(c, F.concat(F.lit(" "), words))
    at_start = F.startswith(c, F.concat(words, F.lit(" ")))
    cut = F.when(at_end, F.substring(c, F.lit(1), F.length(c) - F.length(words) - 1)).when(at_start, F.substring(c, F.length(words) + 2, F.length(c)))
    return F.when(F.length(words) > 0, cut)


def with_variants(df: DataFrame, name: str, parents: str, out: str) -> DataFrame:
    """df with `out`, the readings of a typed name: as it stands, without a parent's name before or after it, without words for
    the kind of place and without numbers, each also with two words swapped. Steps are columns of their own, and what is done to
    several texts is written once over an array of them: nested into one expression the plan would grow with every step."""
    generic = r"\b(" + "|".join(GENERIC_WORDS) + r"|\d+)\b"
    keep = lambda x: x.isNotNull() & (F.length(x) > 0)
    d = df.withColumn("__l", F.transform(F.concat(F.array(name), F.coalesce(parents, F.array().cast("array<string>"))), letters))
    d = d.withColumn("__p", F.transform("__l", lambda x, i: F.when(i == 0, x).otherwise(_less(F.col("__l")[0], x))))
    d = d.withColumn("__b", F.concat("__p", F.transform("__p", lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, generic, " "), " +", " ")))))
    return d.withColumn(out, F.array_distinct(F.filter(F.concat("__b", F.transform("__b", _swapped)), keep))).drop("__l", "__p", "__b")


def _edit_share(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def map_names(typed: DataFrame, reference: DataFrame, threshold: float = THRESHOLD, max_edit_share: float = MAX_EDIT_SHARE) -> DataFrame:
    """(id, entry, score): the best reference entry of every typed name that has one, with its Jaccard similarity; a name without a row
    stands for none.

    typed: (id, scope, name, parents ARRAY<STRING>), one row per distinct name to map; reference: (scope, name, entry), several names may
    stand for one entry. Names are matched within their scope. Null or letterless names, unknown and null scopes and an empty
    reference give no rows. The entry of the greatest exact Jaccard similarity wins, of equal ones that of the smaller edit distance,
    then the smaller entry; entries beyond the edits allowed are not meant and don't compete.
    """
    key = lambda: F.concat_ws("\u0001", "scope", "bones")
    t = typed.where("id is not null and name is not null and scope is not null")
    # explode_outer: a plain explode would push a test of the whole expression below the steps it is made of
    v = with_variants(t, "name", "parents", "texts").select("id", "scope", F.explode_outer("texts").alias("text")).where("text is not null")
    v = v.withColumn("bones", skeleton(F.col("text"))).where("bones <> ''").withColumn("key", key())
    r = reference.where("name is not null and scope is not null and entry is not null").select("scope", "entry", letters(F.col("name")).alias("text"))
    r = r.withColumn("bones", skeleton(F.col("text"))).where("bones <> ''").distinct().withColumn("rkey", key())
    v, r = materialise_all((v, "typed"), (r, "reference"))
    # the same skeleton occurs in many typed names: each is looked up once
    lk, rk = v.select("key", "scope", "bones").distinct(), r.select(F.col("rkey").alias("key"), "scope", "bones").distinct()
    pairs = materialise(similarity_join(lk, rk, "key", "bones", "scope", threshold).select(F.col("lk").alias("key"), F.col("rk").alias("rkey"), "jaccard"), "pairs")
    c = join_dimension(v.select("id", "key", "text", "bones"), pairs, ["key"], "inner", spread=F.col("id"), hot=lambda: hot_keys(v, ["key"]))
    named = bounded_by(r.select("rkey", F.col("bones").alias("r_bones"), F.col("text").alias("r_text"), "entry"), r)
    c = join_dimension(c, named, ["rkey"], "inner", spread=F.col("id"))
    c = c.withColumns({"a": F.replace(without_digits(F.col("text")), F.lit(" "), F.lit("")), "b": F.replace(without_digits(F.col("r_text")), F.lit(" "), F.lit(""))})
    edit = F.least(_edit_share(F.col("a"), F.col("b")), _edit_share(F.col("bones"), F.col("r_bones")) + 0.02)
    short = F.least(F.length("a"), F.length("b")) <= 3
    edit = F.when(_abbreviates(F.col("text"), F.col("r_text")), F.least(edit, F.lit(0.1))).otherwise(edit)
    c = c.withColumn("edit", edit).where(F.col("edit") <= F.when(short, 0.0).otherwise(max_edit_share))
    best = F.min_by(F.struct("entry", "jaccard"), F.struct(-F.col("jaccard"), "edit", "entry"))
    return c.groupBy("id").agg(best.alias("b")).select("id", F.col("b.entry").alias("entry"), F.col("b.jaccard").alias("score"))


def _abbreviates(a: Column, b: Column) -> Column:
    """Whether a has the words of b, each cut off after its start, and at least four letters and half of b's letters in all."""
    wa, wb = F.split(a, " "), F.split(b, " ")
    prefix = F.forall(F.arrays_zip(wa.alias("x"), wb.alias("y")), lambda z: z["y"].startswith(z["x"]))
    return (F.size(wa) == F.size(wb)) & prefix & (F.length(a) >= 4) & (2 * F.length(a) >= F.length(b))
