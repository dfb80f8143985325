"""Sliding windows over units: the sequences that are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _check(min_units: int, growth: int) -> None:
    if min_units < 1 or growth < 0:
        raise ValueError("min_units must be at least 1 and growth at least 0")


def maximal(df: DataFrame, min_units: int = 5, growth: int = 5) -> DataFrame:
    """df has ``units``. Each start that leaves room gives its longest window: adds start_offset, n and window."""
    _check(min_units, growth)
    last = F.size("units") - min_units
    rows = df.where(last >= 0).select("*", F.explode(F.sequence(F.lit(0), last)).alias("start_offset"))
    n = F.least(F.lit(min_units + growth), F.size("units") - F.col("start_offset"))
    return rows.withColumn("n", n).withColumn("window", F.slice("units", F.col("start_offset") + 1, F.col("n")))


def limited(df: DataFrame, min_units: int = 5, growth: int = 5) -> DataFrame:
    """Each start with each size from min_units to min_units + growth that fits."""
    _check(min_units, growth)
    last = F.size("units") - min_units
    rows = df.where(last >= 0).select("*", F.explode(F.sequence(F.lit(0), last)).alias("start_offset"))
    most = F.least(F.lit(min_units + growth), F.size("units") - F.col("start_offset"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(min_units), most)).alias("n"))
    return rows.withColumn("window", F.slice("units", F.col("start_offset") + 1, F.col("n")))


def full_bodies(df: DataFrame, min_units: int = 5, growth: int = 5) -> DataFrame:
    """Bodies longer than any window, as one sequence each."""
    _check(min_units, growth)
    rows = df.where(F.size("units") > min_units + growth)
    return rows.select("*", F.lit(0).alias("start_offset"), F.size("units").alias("n"), F.col("units").alias("window"))


def sequences(df: DataFrame, min_units: int = 5, growth: int = 5, maximal_only: bool = True) -> DataFrame:
    """All sequences of bodies; constructors (kind) always give windows of each size. full_body marks whole bodies that are longer than any window."""
    if not maximal_only:
        windows = limited(df, min_units, growth)
    elif "kind" in df.columns:
        special = F.coalesce(F.col("kind") == "constructor", F.lit(False))
        windows = maximal(df.where(~special), min_units, growth).unionByName(limited(df.where(special), min_units, growth))
    else:
        windows = maximal(df, min_units, growth)
    return full_bodies(df, min_units, growth).withColumn("full_body", F.lit(True)).unionByName(windows.withColumn("full_body", F.lit(False)))


def spans(units: Column, min_units: int = 5, growth: int = 5, maximal_only: bool = True, special: Column | None = None) -> Column:
    """(start_offset, n, full_body) of what ``sequences`` gives of one body, as an array; ``special`` marks the bodies that always give windows of each size."""
    _check(min_units, growth)
    size, most, none = F.size(units), min_units + growth, F.array().cast("array<struct<start_offset:int,n:int,full_body:boolean>>")

    def span(start: Column, n: Column, full: bool = False) -> Column:
        return F.struct(start.cast("int").alias("start_offset"), n.cast("int").alias("n"), F.lit(full).alias("full_body"))

    def longest(start: Column) -> Column:
        return F.least(F.lit(most), size - start)

    starts = F.sequence(F.lit(0), size - min_units)
    every = F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(min_units), longest(s)), lambda n: span(s, n))))
    cut = F.transform(starts, lambda s: span(s, longest(s))) if maximal_only else every
    if maximal_only and special is not None:
        cut = F.when(special, every).otherwise(cut)
    return F.concat(F.when(size > most, F.array(span(F.lit(0), size, True))).otherwise(none), F.when(size >= min_units, cut).otherwise(none))


def window_key(window: Column, mark: str = "\x01") -> Column:
    """Equal windows have equal keys."""
    return F.md5(F.array_join(window, mark))
