"""Connected components of a graph given as DataFrames (used by M5/M6).

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014). In a large-star step every vertex
hands its smallest neighbour to its larger neighbours; in a small-star step
it hands it to its smaller ones. The edge set turns into one star per
component whose centre is the smallest id, after a number of rounds that
grows with the logarithm of the component, not with its diameter. Each step
is one aggregate (partial before the shuffle) and one join on the same key,
whose many side AQE splits for a hot vertex. Every round is checkpointed to
the shared folder; the driver sees two numbers per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.session import checkpoint_dir


def connected_components(vertices: DataFrame, edges: DataFrame, id_col: str = "id",
                         src: str = "src", dst: str = "dst",
                         rounds: list[int] | None = None) -> DataFrame:
    """(id, component) where component is the smallest id of the component; a
    vertex without edges is its own component. Ids may be of any orderable
    type. Null ids and self loops in ``edges`` are ignored. ``rounds``, if
    given, receives the number of rounds (for tests)."""
    checkpoint_dir(vertices.sparkSession)
    star = star_forest(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")), rounds)
    v = vertices.select(F.col(id_col).alias("id")).distinct()
    return (v.join(star, v.id == star.u, "left")
            .select(F.col("id").alias(id_col), F.coalesce("v", "id").alias("component")))


def star_forest(pairs: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(u, v): every vertex u that has an edge and is not the smallest of its
    component, with the smallest vertex v of its component."""
    checkpoint_dir(pairs.sparkSession)
    e = _downward(pairs.filter(F.col("u").isNotNull() & F.col("v").isNotNull())).checkpoint()
    seen, n = _signature(e), 0
    while seen[0]:
        n += 1
        e = _small_star(_large_star(e)).checkpoint()
        now = _signature(e)
        if now == seen:
            break
        seen = now
    if rounds is not None:
        rounds.append(n)
    return e


def _downward(pairs: DataFrame) -> DataFrame:
    """Distinct edges with u > v."""
    return (pairs.filter(F.col("u") != F.col("v"))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    return (both.filter(F.col("v") > F.col("u")).join(low, "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    to_low = e.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_low.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _signature(e: DataFrame) -> tuple:
    """Number of edges and a sum of their hashes: equal after a round that
    changed nothing."""
    row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
