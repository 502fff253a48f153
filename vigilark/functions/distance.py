"""String distances that Spark lacks, as Arrow-batched functions of two text columns.

Distances, not similarities: 0 for equal texts. Null in either text gives null. Each batch computes every distinct pair once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def jaro(a: str, b: str) -> float:
    """1 - Jaro similarity."""
    if a == b:
        return 0.0
    if not a or not b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, first = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                first.append(c)
                break
    if not first:
        return 1.0
    second = [c for c, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(first, second)) // 2
    m = len(first)
    return 1.0 - (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str, p: float = 0.1) -> float:
    d = jaro(a, b)
    k = 0
    while k < min(4, len(a), len(b)) and a[k] == b[k]:
        k += 1
    return d * (1 - k * p)


def osa(a: str, b: str) -> float:
    """Edits and swaps of neighbours, no text edited twice."""
    before, last, cur = None, list(range(len(b) + 1)), []
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, cur[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            cur.append(v)
        before, last = last, cur
    return float(last[-1])


def damerau(a: str, b: str) -> float:
    """Unrestricted edits and swaps."""
    top = len(a) + len(b)
    rows = {(-1, -1): top}
    seen: dict[str, int] = {}
    for i in range(len(a) + 1):
        rows[i, -1], rows[i, 0] = top, i
    for j in range(len(b) + 1):
        rows[-1, j], rows[0, j] = top, j
    for i in range(1, len(a) + 1):
        hit = 0
        for j in range(1, len(b) + 1):
            k, h = seen.get(b[j - 1], 0), hit
            same = a[i - 1] == b[j - 1]
            if same:
                hit = j
            rows[i, j] = min(rows[i - 1, j - 1] + (not same), rows[i, j - 1] + 1, rows[i - 1, j] + 1, rows[k - 1, h - 1] + (i - k - 1) + 1 + (j - h - 1))
        seen[a[i - 1]] = i
    return float(rows[len(a), len(b)])


def hamming(a: str, b: str) -> float:
    return float(sum(x != y for x, y in zip(a, b))) if len(a) == len(b) else float("inf")


def lcs(a: str, b: str) -> float:
    """Letters outside the longest common subsequence."""
    last = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b, 1):
            cur.append(last[j - 1] + 1 if x == y else max(last[j], cur[-1]))
        last = cur
    return float(len(a) + len(b) - 2 * last[-1])


def _grams(s: str, q: int) -> Counter:
    return Counter(s[i : i + q] for i in range(len(s) - q + 1))


def qgram(a: str, b: str, q: int = 1) -> float:
    x, y = _grams(a, q), _grams(b, q)
    return float(sum(abs(x[k] - y[k]) for k in x.keys() | y.keys()))


def cosine(a: str, b: str, q: int = 1) -> float:
    x, y = _grams(a, q), _grams(b, q)
    if not x or not y:
        return 0.0 if x == y else 1.0
    n = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return max(0.0, 1.0 - sum(v * y[k] for k, v in x.items()) / n)


def jaccard(a: str, b: str, q: int = 1) -> float:
    x, y = set(_grams(a, q)), set(_grams(b, q))
    return 1.0 - len(x & y) / len(x | y) if x | y else 0.0


def levenshtein(a: str, b: str) -> float:
    """Edits."""
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(last[j] + 1, cur[j - 1] + 1, last[j - 1] + (x != y)))
        last = cur
    return float(last[-1])


_METHODS: dict[str, Callable[[str, str], float]] = {
    "jw": jaro, "jaro_winkler": jaro_winkler, "osa": osa, "dl": damerau, "hamming": hamming, "lcs": lcs, "qgram": qgram,
    "cosine": cosine, "jaccard": jaccard,
}
METHODS = (*_METHODS, "lv", "soundex")


def _soundex(s: str) -> str:
    """As Spark computes it: texts that do not begin with a letter from A to Z stand for themselves."""
    if not s or not ("a" <= s[0] <= "z" or "A" <= s[0] <= "Z"):
        return s
    code = {c: d for d, cs in zip("123456", ("BFPV", "CGJKQSXZ", "DT", "L", "MN", "R")) for c in cs}
    s = s.upper()
    out, last = s[0], code.get(s[0], "")
    for c in s[1:]:
        d = code.get(c, "")
        if c in "AEIOUY":
            last = ""
        elif d and d != last:
            out, last = out + d, d
        elif d:
            last = d
    return (out + "000")[:4]


def distance_function(method: str) -> Callable[[str, str], float]:
    """The distance of two Python texts, the same as string_distance."""
    if method == "soundex":
        return lambda a, b: float(_soundex(a) != _soundex(b))
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")
    return levenshtein if method == "lv" else _METHODS[method]


def _letters(c: Column) -> Column:
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))


def _numbered(x: Column) -> Column:
    """Letters with the number of their occurrence, so that common occurrences are common elements."""
    return F.transform(x, lambda c, i: F.concat(c, F.size(F.filter(F.slice(x, F.lit(1), i + 1), lambda y: y == c)).cast("string")))


def _built_in(a: Column, b: Column, method: str) -> Column | None:
    """The methods that are expressions of the JVM; of single letters where they count letters."""
    x, y = _letters(a), _letters(b)
    if method == "lv":
        return F.levenshtein(a, b).cast("double")
    if method == "soundex":
        return F.when(F.soundex(a) == F.soundex(b), 0.0).otherwise(1.0)
    if method == "hamming":
        differ = F.size(F.filter(F.zip_with(x, y, lambda p, q: p != q), lambda d: d))
        return F.when(F.length(a) == F.length(b), differ.cast("double")).otherwise(float("inf"))
    if method == "jaccard":
        both = F.size(F.array_union(x, y))
        return F.when(both == 0, 0.0).otherwise(1 - F.size(F.array_intersect(x, y)) / both)
    if method == "qgram":
        return (F.size(x) + F.size(y) - 2 * F.size(F.array_intersect(_numbered(x), _numbered(y)))).cast("double")
    return None


def string_distance(a: Column, b: Column, method: str = "jw") -> Column:
    """Distance of two texts as DOUBLE, null if either is null. lv, soundex (0 or 1), hamming, jaccard and qgram are expressions of the JVM,
    the others run in Arrow batches."""
    built_in = _built_in(a, b, method)
    if built_in is not None:
        return F.when(a.isNotNull() & b.isNotNull(), built_in)
    if method not in _METHODS:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")
    one = _METHODS[method]

    @pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for p in zip(x, y):
            if p[0] is None or p[1] is None:
                out.append(None)
                continue
            d = known.get(p)
            if d is None:
                d = known[p] = one(*p)
            out.append(d)
        return pd.Series(out, dtype="float64")

    return run(a, b)
