"""Clusters of linked sequences: components, their primary, what removing copies saves, and the order of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reprise.operators.components import connected_components
from reprise.storage import materialize


def members(pairs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(cluster_id, id): components of the pairs (id1, id2, overall) at or above the threshold; a cluster's id is its smallest member."""
    found = connected_components(pairs.where(F.col("overall") >= threshold).select("id1", "id2"))
    return found.select(F.col("component").alias("cluster_id"), F.col("node").alias("id"))


def saving(total: Column, primary: Column, count: Column) -> Column:
    """Units saved: all but the primary's, less a call for each copy and one for the new body; never below 0."""
    return F.greatest(F.lit(0), total - primary - (count - 1) - 1)


def summarize(member_rows: DataFrame, sequences: DataFrame, pairs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """cluster_id, primary_id, n_members, n_pairs, loc_reduction, avg_similarity, most saving first.

    sequences: id, n and the columns that order locations (file, start_line, start_offset; those that are there). The primary is the first by location.
    Where member_rows has count (sequences that a member stands for), n_sequences is their sum, savings are of all of them, and a
    member that stands for several is a cluster by itself. Where pairs have weight (pairs of sequences that one stands for), so do counts and means.
    """
    weighed = "count" in member_rows.columns
    order = [F.coalesce(F.col(c), F.lit("") if kind == "string" else F.lit(0)) for c, kind in sequences.dtypes if c in ("file", "start_line", "start_col", "end_line", "end_col", "start_offset")]
    rows = member_rows.join(sequences.select("id", "n", F.struct(*order, "n", "id").alias("place")), "id")
    weight = F.col("count") if weighed else F.lit(1)
    size = rows.groupBy("cluster_id").agg(F.count("*").alias("n_members"), F.sum(weight).alias("n_sequences"), F.sum(F.col("n") * weight).alias("total"), F.min(F.struct("place", "id", "n")).alias("first"))
    own = pairs.where(F.col("overall") >= threshold).join(member_rows.select(F.col("id").alias("id1"), "cluster_id"), "id1")
    times = F.col("weight") if "weight" in pairs.columns else F.lit(1)
    score = own.groupBy("cluster_id").agg(F.sum(times).cast("long").alias("n_pairs"), (F.sum(F.col("overall") * times) / F.sum(times)).alias("avg_similarity"))
    out = size.where("n_sequences >= 2").join(score, "cluster_id", "left")
    loc = saving(F.col("total"), F.col("first.n"), F.col("n_sequences"))
    sequences_ = ["n_sequences"] if weighed else []
    return out.select("cluster_id", F.col("first.id").alias("primary_id"), "n_members", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), loc.alias("loc_reduction"), F.coalesce("avg_similarity", F.lit(1.0)).alias("avg_similarity"), *sequences_)


def in_order(clusters: DataFrame) -> DataFrame:
    return clusters.orderBy(F.desc("loc_reduction"), "primary_id")


def split_by_file(cluster_rows: DataFrame, member_rows: DataFrame, files: DataFrame) -> DataFrame:
    """Clusters over several files, as one per file with at least two members there; savings in proportion (whole numbers).

    cluster_rows: cluster_id, n_members, loc_reduction; files: id, file. Clusters without such a file stay whole, with a null file.
    """
    here = member_rows.join(files, "id").groupBy("cluster_id", "file").agg(F.count("*").alias("here")).where("here >= 2")
    part = F.expr("loc_reduction * here div n_members")
    both = cluster_rows.join(here, "cluster_id", "left")
    return both.select("cluster_id", "file", F.coalesce("here", "n_members").alias("n_members"), F.when(F.col("here").isNull(), F.col("loc_reduction")).otherwise(part).alias("loc_reduction"))


def by_class(cluster_rows: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clusters with the class of their primary, clusters without one). places: id, class_name."""
    at = places.where("class_name is not null").select(F.col("id").alias("primary_id"), "class_name")
    return cluster_rows.join(at, "primary_id"), cluster_rows.join(at, "primary_id", "left_anti")


# How strategies rank.
RANKS = {"CONSTRUCTOR_DELEGATION": 100, "EXTRACT_PARENT_CLASS": 90, "EXTRACT_TO_UTILITY_CLASS": 80, "EXTRACT_TO_PARAMETERIZED_TEST": 80, "EXTRACT_HELPER_METHOD": 50, "MANUAL_REVIEW_REQUIRED": 0}


def work_order(rows: DataFrame) -> DataFrame:
    """Adds place: strategy first, then saving, members and score (largest first), then location. rows: strategy, loc_reduction, n_members, avg_similarity, primary_id."""
    rank = F.lit(0)
    for name, value in RANKS.items():
        rank = F.when(F.col("strategy") == name, F.lit(value)).otherwise(rank)
    keys = [(-rank).alias("_1"), (-F.col("loc_reduction")).alias("_2"), (-F.col("n_members")).alias("_3"), (-F.col("avg_similarity")).alias("_4"), F.col("primary_id").alias("_5")]
    # sorted by ranges of the whole order; a place is one inside its range and the rows of the ranges before it, whose counts are one row a range
    marked = rows.withColumn("_order", F.struct(*keys))
    dealt = materialize(marked.repartitionByRange("_order").withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_order"))
    return dealt.withColumn("_inside", inside).join(before, "_part").withColumn("place", (F.col("_before") + F.col("_inside")).cast("int")).drop("_order", "_part", "_inside", "_before")
