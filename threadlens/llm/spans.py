"""Positions of regular-expression matches with DataFrame functions only.

Spark's functions return the matched strings but not their places. Splitting
at the same expression gives the gaps between the matches; the running length
of gaps and matches gives the places, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,end:int,hit:string>"


def find_spans(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` (never empty ones) as
    array<struct<kind, start, end, hit>>, end exclusive."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits,
                       lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))

    def step(done, pair):
        a = done["at"] + pair["gap"]
        b = a + F.length(pair["hit"])
        span = F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"), pair["hit"].alias("hit"))
        return F.struct(b.alias("at"), F.concat(done["found"], F.array(span)).alias("found"))

    return F.aggregate(pairs, start, step, lambda done: done["found"])


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")
