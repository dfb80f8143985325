"""Predicates on pairs of sequences, and how pairs meet files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reprise.operators.similarity import positional


def size_filter(n1: Column, n2: Column, most: float = 0.30) -> Column:
    """Sizes differ by at most this share of the larger one; equal passes."""
    if not 0 <= most <= 1:
        raise ValueError("the ratio must be between 0 and 1")
    return (F.greatest(n1, n2) - F.least(n1, n2)) / F.greatest(n1, n2) <= F.lit(most)


def structural_filter(fuzzy1: Column, fuzzy2: Column, least: float = 0.5) -> Column:
    if not 0 <= least <= 1:
        raise ValueError("the threshold must be between 0 and 1")
    return positional(fuzzy1, fuzzy2) >= F.lit(least)


def prefilter(pairs: DataFrame, most: float = 0.30, least: float | None = 0.5) -> DataFrame:
    """pairs has n1, n2 and fuzzy1, fuzzy2. The cheap filter comes first; least None leaves the second out."""
    kept = pairs.where(size_filter(F.col("n1"), F.col("n2"), most))
    return kept if least is None else kept.where(structural_filter(F.col("fuzzy1"), F.col("fuzzy2"), least))


def overlaps(path1: Column, path2: Column, box1: Column, box2: Column, start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    """Whether two sequences share lines: one known path, not in two different known containers, ranges that meet."""
    same = F.coalesce(path1 == path2, F.lit(False))
    apart = F.coalesce(box1 != box2, F.lit(False))
    return same & ~apart & (start1 <= end2) & (start2 <= end1)


def equal_size_score(n1: Column, n2: Column, score: Column) -> Column:
    """Pairs of unequal sizes score nothing."""
    return F.when(n1 != n2, F.lit(0.0)).otherwise(score)


def above(pairs: DataFrame, threshold: float) -> DataFrame:
    return pairs.where(F.col("overall") >= F.lit(threshold))


def by_file(pairs: DataFrame, file1: str = "file1", file2: str = "file2") -> DataFrame:
    """Each pair under both its files, once where they are one."""
    return pairs.select(F.explode(F.array_distinct(F.array(file1, file2))).alias("file"), *pairs.columns)
