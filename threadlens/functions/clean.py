"""Column expressions for cleaning (built-in functions only, so they stay in
whole-stage codegen and predicates on raw columns still reach the scan)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
SENTINEL = "missing"          # text that replaces a null on read
BLOCKED_STATE = "blocked"     # comment state that is dropped
OUTLIER_TOPIC = -1            # topic of documents without a cluster
SHEET_NAME_MAX = 31           # longest sheet (partition) name
NON_ASCII_PATTERN = r"[^\x00-\x7F#&;]+"   # dormant text cleaning rule


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_text(c, sentinel: str = SENTINEL) -> Column:
    """Null → sentinel, then text (P1 + P2). Integers render without '.0'."""
    return F.coalesce(_col(c).cast("string"), F.lit(sentinel))


def not_blocked(c="final_state", blocked: str = BLOCKED_STATE) -> Column:
    """Keep rows whose state is not 'blocked'. A null state is kept, as the
    sentinel would be; written on the raw column so it is pushed to the scan."""
    c = _col(c)
    return c.isNull() | (c != F.lit(blocked))


def clean_count(c, sentinel: str = SENTINEL, lenient: bool = False) -> Column:
    """sentinel/null → 0, text → double → round half-even → bigint.

    ``bround`` is half-even like the reference's float rounding (2.5 → 2).
    Bad text raises under ANSI casts; ``lenient=True`` turns it into 0.
    """
    c = _col(c)
    text = F.coalesce(F.nullif(c.cast("string"), F.lit(sentinel)), F.lit("0"))
    number = F.coalesce(text.try_cast("double"), F.lit(0.0)) if lenient else text.cast("double")
    return F.bround(number, 0).cast("bigint")


def topic_or_outlier(c="Topic") -> Column:
    """Unmatched topic → -1, as int."""
    return F.coalesce(_col(c).cast("int"), F.lit(OUTLIER_TOPIC))


def sheet_name(c="Topic") -> Column:
    """Trimmed text of the topic, at most 31 characters."""
    return F.substring(F.trim(_col(c).cast("string")), 1, SHEET_NAME_MAX)


def strip_non_ascii(c) -> Column:
    """P16 (dormant in the reference): drop runs of non-ASCII characters,
    keeping '#', '&' and ';'."""
    return F.regexp_replace(_col(c), NON_ASCII_PATTERN, "")
