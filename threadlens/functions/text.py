"""Text expressions (JVM-side regex, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens are runs of letters or digits, lower-cased, at least two
# characters. The same pattern splits text identically in DuckDB.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
MIN_TOKEN_CHARS = 2


def tokens(text) -> Column:
    """Array of tokens of a whole text."""
    c = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.lower(c), TOKEN_SPLIT)
    return F.filter(parts, lambda t: F.length(t) >= MIN_TOKEN_CHARS)
