"""Row identities: canonical text and hashes of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_text(columns: Sequence[str]) -> Column:
    """One unambiguous text of the given columns in the given order: every value is prefixed by its length, null is a
    mark of its own, so that no two different rows give the same text."""
    parts = []
    for c in columns:
        s = F.col(f"`{c}`").cast("string")
        parts.append(F.when(s.isNull(), F.lit("~")).otherwise(F.concat(F.length(s).cast("string"), F.lit(":"), s)))
    return F.concat(*parts) if parts else F.lit("")


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the canonical text, as 32 bytes."""
    return F.unhex(F.sha2(canonical_text(columns), 256))


def clean_guid(c: Column) -> Column:
    """GUID in lower case without braces and outer spaces."""
    return F.lower(F.regexp_replace(F.trim(c), "[{}]", ""))
