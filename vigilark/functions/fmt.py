"""Numbers and counts as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def big_mark(c: Column, decimals: int = 0, mark: str = ",") -> Column:
    """Number with thousands separators."""
    out = F.format_number(c, decimals)
    return F.translate(out, ",", mark) if mark != "," else out


def number_text(c: Column) -> Column:
    """A double with up to 15 significant digits and no trailing zeros."""
    t = F.format_string("%.15g", c)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.when(t.contains("."), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t))


def decimal_places(c: Column) -> Column:
    """Length of the text after the decimal point; without a point the length of the whole text, sign included."""
    return F.length(F.regexp_replace(number_text(c), r"^-?\d+\.", ""))


def detection_text(count: Column, virus: Column, order: list[str]) -> Column:
    """2 WPV1; null for viruses outside the list."""
    return F.when(virus.isin(order), F.concat(count.cast("long").cast("string"), F.lit(" "), virus))


def size_text(c: Column) -> Column:
    """Bytes as MB, KB or bytes."""
    mb, kb = 1_048_576, 1_024
    return (
        F.when(c >= mb, F.concat(F.format_number(c / mb, 2), F.lit(" MB"))).when(c >= kb, F.concat(F.format_number(c / kb, 2), F.lit(" KB")))
        .otherwise(F.concat(c.cast("string"), F.lit(" bytes")))
    )


def compression_columns(before: Column, after: Column) -> dict[str, Column]:
    """Saved bytes, percent and band of a recompression."""
    saved = before - after
    pct = F.round(F.try_divide(100 * saved, before), 2)
    band = F.when(pct > 50, "high").when(pct > 20, "medium").otherwise("low")
    return {"saved": saved, "saved_percent": pct, "band": band}
