"""Date texts of many kinds as instants.

Three steps: the distinct (text, zone, order) triples form a dictionary; every entry is parsed once, and what was parsed in
an earlier run is not parsed again; the instants are joined back to the rows.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark.plans.rows import canonical_text
from vigilark.session import list_dir

DAY = 86_400_000_000
EPOCH = date(1970, 1, 1).toordinal()
#: Day 0 of spreadsheet day counts.
SHEET_EPOCH = date(1899, 12, 30).toordinal() - EPOCH

# Month names of date texts.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9,
    "october": 10, "november": 11, "december": 12, "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8,
    "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "janvier": 1, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "aout": 8, "septembre": 9,
    "octobre": 10, "novembre": 11, "decembre": 12, "janv": 1, "fevr": 2, "avr": 4, "juil": 7,
    "januar": 1, "februar": 2, "marz": 3, "juni": 6, "juli": 7, "oktober": 10, "dezember": 12, "okt": 10, "dez": 12,
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9,
    "octubre": 10, "noviembre": 11, "diciembre": 12,
}

# Zone abbreviations in minutes from UTC.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "wat": 60, "cet": 60, "cest": 120, "cat": 120,
    "sast": 120, "eet": 120, "eest": 180, "eat": 180, "msk": 180, "pkt": 300, "ist": 330, "npt": 345, "ict": 420,
    "awst": 480, "pht": 480, "phst": 480, "jst": 540, "kst": 540, "acst": 570, "aest": 600, "acdt": 630, "aedt": 660,
    "nzst": 720, "nzdt": 780, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480,
    "pdt": -420,
}

# Abbreviations that mean something else to offices of a zone.
LOCAL_ABBREVIATIONS = {
    ("pst", "Asia/Manila"): 480, ("cst", "Asia/Shanghai"): 480, ("cst", "Asia/Taipei"): 480, ("bst", "Asia/Dhaka"): 360,
    ("ist", "Asia/Jerusalem"): 120, ("ist", "Europe/Dublin"): 60,
}

_TIME = r"(?P<h>\d{1,2})(?::|h)(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?: ?(?P<ap>[ap])\.?m\.?)?"
_ZONE = r"(?: ?(?P<z>z|(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?(?::?\d{2})?|[a-z]{2,5}|[a-z]+(?:/[a-z_+-]+[0-9]*){1,2}))?(?: ?\[(?P<region>[^\]]+)\])?"
_TAIL = rf"(?:(?:,? |t|, ?){_TIME}{_ZONE})?"
_DAYNAME = r"(?:[a-z]{3,9}\.?,? )?"
_FORMS = [
    re.compile(rf"(?P<y>\d{{4}})(?P<sep>[-/.])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}}){_TAIL}"),
    re.compile(rf"(?P<a>\d{{1,2}})(?P<sep>[-/.])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}|\d{{2}}){_TAIL}"),
    re.compile(rf"{_DAYNAME}(?P<d>\d{{1,2}})(?:st|nd|rd|th|er|\.)?(?: |-)(?:de )?(?P<mon>[a-z]{{3,10}})\.?(?:,? |-)(?:de )?(?P<y>\d{{4}}|\d{{2}}){_TAIL}"),
    re.compile(rf"{_DAYNAME}(?P<mon>[a-z]{{3,10}})\.? (?P<d>\d{{1,2}})(?:st|nd|rd|th)?,? (?P<y>\d{{4}}){_TAIL}"),
    re.compile(rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})(?:[t ](?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d+))?)?(?P<ap>)?{_ZONE})?"),
]
_NUMBER = re.compile(r"(\d+)(?:\.(\d+))?")
_OFFSET = re.compile(r"(?:utc|gmt)?([+-])(\d{1,2})(?::?(\d{2}))?(?::?(\d{2}))?")
_HIDDEN = {c: None for c in (0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF)}


def _plain(text: str) -> str:
    """Compatibility forms, digits of every script as 0-9, no hidden characters, outer quotes or spaces, lower case without accents."""
    t = unicodedata.normalize("NFKD", text.translate(_HIDDEN))
    t = "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in t if not unicodedata.combining(c))
    t = " ".join(t.replace("\u2212", "-").replace("\u2013", "-").split())
    return t.strip("\"'`“”‘’ ").lower()


def parse_instant(text: str | None, order: str | None) -> tuple[int, int | None, str | None] | None:
    """(microseconds of the wall clock, offset in seconds or None, zone name or None), or None if text denotes no instant.

    With an offset the instant is clock minus offset; without, the clock is local time of the zone or, if that
    is None, of the row's own zone. order is DMY or MDY; without it all-numeric dates that do not start with the year denote nothing.
    """
    if text is None:
        return None
    t = _plain(text)
    if not t:
        return None
    if m := _NUMBER.fullmatch(t):
        whole, frac = m[1], (m[2] or "")[:30]
        if len(whole) > 20:
            return None
        n, k = int(whole), len(whole)
        if k == 8 and not frac and 1900 <= n // 10000 <= 2200:
            pass  # a compact date, below
        elif k in (12, 14) and not frac and whole[:2] in ("19", "20") and (got := _clock(int(whole[:4]), int(whole[4:6]), int(whole[6:8]), int(whole[8:10]), int(whole[10:12]), int(whole[12:14] or 0), "")) is not None:
            return got, None, None
        elif k <= 6:
            part = int(frac or 0) * DAY
            return ((SHEET_EPOCH + n) * DAY + (part + 10 ** len(frac) // 2) // 10 ** len(frac), None, None) if n else None
        elif k <= 11:
            return n * 1_000_000 + int((frac + "000000")[:6]), 0, None
        elif k <= 14:
            return n * 1000 + int((frac + "000")[:3]), 0, None
        elif k <= 17:
            return n, 0, None
        elif k <= 20:
            return n // 1000, 0, None
        else:
            return None
    for form in _FORMS:
        m = form.fullmatch(t)
        if not m:
            continue
        g = m.groupdict()
        y = int(g["y"]) + (2000 if len(g["y"]) == 2 else 0)
        if g.get("a"):
            if order not in ("DMY", "MDY"):
                return None
            d, mo = (int(g["a"]), int(g["b"])) if order == "DMY" else (int(g["b"]), int(g["a"]))
        else:
            d = int(g["d"])
            mo = MONTHS.get(g["mon"]) if g.get("mon") else int(g["m"])
            if mo is None:
                continue
        h = int(g["h"] or 0)
        if g.get("ap"):
            if not 1 <= h <= 12:
                return None
            h = h % 12 + (12 if g["ap"] == "p" else 0)
        clock = _clock(y, mo, d, h, int(g["mi"] or 0), int(g["s"] or 0), g.get("f") or "")
        if clock is None:
            return None
        z, region = g.get("z"), g.get("region")
        if z and (o := _OFFSET.fullmatch(z)):
            secs = int(o[2]) * 3600 + int(o[3] or 0) * 60 + int(o[4] or 0)
            if int(o[2]) > 18 or int(o[3] or 0) > 59:
                return None
            return clock, -secs if o[1] == "-" else secs, None
        if z and "/" not in z:
            return (clock, ABBREVIATIONS[z] * 60, z) if z in ABBREVIATIONS else None
        return clock, None, _zone_name(region or z) if region or z else None
    return None


def _clock(y: int, m: int, d: int, h: int, mi: int, s: int, f: str) -> int | None:
    try:
        day = date(y, m, d).toordinal() - EPOCH
    except ValueError:
        return None
    if h == 24 and mi == s == 0 and not f.strip("0"):
        return (day + 1) * DAY
    if h > 23 or mi > 59 or s > 59:
        return None
    return day * DAY + ((h * 60 + mi) * 60 + s) * 1_000_000 + int((f + "000000")[:6])


def _zone_name(z: str) -> str:
    return "/".join("_".join(w.capitalize() for w in p.split("_")) for p in z.split("/")) if "/" in z else z.upper()


_PARSED = "text string, zone string, date_order string, clock_us long, offset_s int, named_zone string, seen long"


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for text, zone, order in zip(b["text"], b["zone"], b["date_order"]):
            r = parse_instant(text, order)
            if r is None or r[0] is None:
                out.append((None, None, None))
                continue
            clock, offset, name = r
            if offset is not None and name is not None:  # an abbreviation
                offset, name = LOCAL_ABBREVIATIONS.get((name, zone), offset // 60) * 60, None
            out.append((clock, offset, name))
        clock, offset, name = zip(*out) if out else ((), (), ())
        yield pd.DataFrame(
            {
                "text": b["text"], "zone": b["zone"], "date_order": b["date_order"], "clock_us": pd.array(clock, "Int64"),
                "offset_s": pd.array(offset, "Int32"), "named_zone": pd.array(name, "object"), "seen": b["seen"],
            }
        )


def parse_dictionary(entries: DataFrame) -> DataFrame:
    """(text, zone, date_order) -> the same with utc_us, null if the text denotes no instant.

    Python reads only the wall clock and the offset; time zones are applied by the JVM: a local time that occurs twice is
    the earlier instant, one that was skipped moves on by the skipped span.
    """
    seen = F.col("seen") if "seen" in entries.columns else F.lit(1).cast("long").alias("seen")
    p = entries.select("text", "zone", "date_order", seen).mapInPandas(_parse_batches, _PARSED)
    local = F.coalesce("named_zone", "zone")
    shifted = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("clock_us"), local))
    utc = F.when(F.col("offset_s").isNotNull(), F.col("clock_us") - F.col("offset_s").cast("long") * 1_000_000).when(local.isNotNull(), shifted)
    return p.select("text", "zone", "date_order", utc.alias("utc_us"), "seen")


KEYS = ("text", "zone", "date_order")
STORED = "text string, zone string, date_order string, utc_us long, seen long"
#: An entry is hot if at least one of so many rows held it when it was parsed; there are at most so many hot entries.
HOT_SHARE = 10_000


class InstantDictionary:
    """Parsed texts kept at `path`, a folder all executors share; each extend() adds one batch in a folder of its own, whose name no other
    run can choose. A run that failed half-way left no _SUCCESS mark and its folder is not read; two runs at once may both parse
    a text, which counts once. `seen` says in how many rows an entry was when it was parsed."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def batches(self) -> list[str]:
        names = [n for n in list_dir(self.spark, self.path) if n.startswith("batch-")]
        return [n for n in names if "_SUCCESS" in list_dir(self.spark, f"{self.path}/{n}")]

    def read(self) -> DataFrame:
        # every batch is a root of its own: two reads of one root count as the same relation, even if files came in between
        paths = [f"{self.path}/{n}" for n in self.batches()]
        return self.spark.read.schema(STORED).parquet(*paths) if paths else self.spark.createDataFrame([], STORED)

    def extend(self, entries: DataFrame) -> None:
        """Parses the distinct entries that are not there yet; a repeated call adds nothing."""
        fresh = entries.select(*KEYS).where("text is not null").groupBy(*KEYS).agg(F.count("*").alias("seen"))
        if self.batches():
            cond = [F.col(f"n.{k}").eqNullSafe(F.col(f"k.{k}")) for k in KEYS]
            fresh = fresh.alias("n").join(self.read().select(*KEYS).alias("k"), cond, "left_anti")
        parse_dictionary(fresh).write.parquet(f"{self.path}/batch-{len(self.batches()):06d}-{uuid.uuid4().hex}")


def dictionary_entries(df: DataFrame, text: str, zone: str, order: str) -> DataFrame:
    """The entries that the rows of df need."""
    return df.where(F.col(text).isNotNull() & ~_exact(text)).select(F.col(text).alias("text"), F.col(zone).alias("zone"), F.col(order).alias("date_order"))


def _exact(text: str):
    return F.col(text).rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\z")


def normalise_instants(df: DataFrame, text: str, zone: str, order: str, dictionary: InstantDictionary, out: str = "utc_us", extend: bool = True) -> DataFrame:
    """df with `out` (LONG, microseconds since 1970-01-01 UTC), null where the text is null or denotes no instant.

    Texts already in the form yyyy-MM-ddTHH:mm:ssZ are read by the JVM and need no dictionary; of the others every distinct
    (text, zone, order) is parsed once and joined back, hot ones by a broadcast, the others shuffled; with extend=False the dictionary must hold them already. Columns of df keep their names; df may have any columns but
    those beginning with __i_.
    """
    if extend:
        dictionary.extend(dictionary_entries(df, text, zone, order))
    exact = _exact(text)
    direct = F.unix_micros(F.try_to_timestamp(F.when(exact, F.col(text)), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))
    d = dictionary.read().select(canonical_text(KEYS).alias("__i_k"), "utc_us", "seen")
    rows = d.agg(F.sum("seen")).first()[0] or 0
    once = lambda e, name: e.groupBy("__i_k").agg(F.max("utc_us").alias(name))
    hot = d.where(F.col("seen") * HOT_SHARE >= rows)  # a text that fills a third of the rows meets its entry where it is
    needed = F.col(text).isNotNull() & ~exact
    # rows that need no entry, or have met it, are spread over all tasks by a key of their own
    own = F.concat(F.lit("-"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("string"))
    j = df.withColumns({"__i_k": F.when(needed, canonical_text([text, zone, order])).otherwise(own), "__i_d": F.when(exact, direct)})
    j = j.join(F.broadcast(once(hot, "__i_h").withColumn("__i_f", F.lit(True))), "__i_k", "left")
    j = j.withColumn("__i_k", F.when(F.col("__i_f"), own).otherwise(F.col("__i_k"))).join(once(d, "__i_u"), "__i_k", "left")
    return j.withColumn(out, F.coalesce("__i_d", "__i_h", "__i_u")).drop("__i_k", "__i_d", "__i_h", "__i_f", "__i_u")
