"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (combined map-side) and one equi-join, so a hub
with many neighbours is split by AQE like any other skewed join key. Each round's
edges are written to the shared folder, which keeps plans short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reprise.storage import discard, materialize


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with v < u, distinct. Writes edges of the same form after one star step; what it wrote on the way and ``edges`` are removed.

    The minima are written out: AQE splits a hot key of a join only where both sides come straight from a shuffle, not from an aggregate.
    """
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "low")
        # a node whose neighbours are all larger is its own minimum
        near = near.join(low, "u", "left").withColumn("m", F.coalesce("m", "u"))
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "low")
        near = edges.join(low, "u")
        out = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    made = materialize(out.where("v < u").distinct(), "stars")
    for old in (low, edges):
        discard(old)
    return made


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges`` (two columns of one orderable type) with the smallest node it reaches.

    Returns (node, component); nodes without an edge to another node don't occur.
    Self-loops, repeated and reversed edges and rows with nulls are allowed and change nothing.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    state = materialize(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = _signature(state)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        state = _step(_step(state, True), False)
        now = _signature(state)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
