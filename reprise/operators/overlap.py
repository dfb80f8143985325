"""Greedy choice of pairs that don't overlap, within each pair of containers."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Best first: fewest escapes, whole bodies, long spans, large sizes, early lines; then score and place, so that order never rests on rows.
PRIORITY = (("escapes", True), ("full_body", False), ("span", False), ("n1", False), ("start1", True), ("overall", False), ("start2", True), ("id1", True), ("id2", True))


def _free(kept: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a range meets none of the kept ones, which are sorted and don't meet each other."""
    k = bisect_right(kept, (start, 1 << 62))
    return not ((k and kept[k - 1][1] >= start) or (k < len(kept) and kept[k][0] <= end))


def _take(kept: tuple[list, list], s1: int, e1: int, s2: int, e2: int) -> bool:
    """Keep a pair if it meets none of the kept ones on either side."""
    free = _free(kept[0], s1, e1) and _free(kept[1], s2, e2)
    if free:
        insort(kept[0], (s1, e1))
        insort(kept[1], (s2, e2))
    return free


def non_overlapping(pairs: DataFrame, *more: str) -> DataFrame:
    """pairs: id1, id2, box1, box2 (containers), start1, end1, start2, end2, n1, n2, overall; optionally full_body1, full_body2, escapes1, escapes2, twin.

    Sides are put in order of container (and place, inside one) first, so unordered groups compare like with like. The choice is sequential in a group; a
    group is the pairs of two containers, which their lengths bound; each step looks up its neighbours among those kept. ``twin``: whether box2 is a copy of
    box1 rather than itself. ``more``: stems of further columns with a side 1 and 2, which change places with their sides.
    """
    for name, value in (("escapes1", F.lit(0)), ("escapes2", F.lit(0)), ("full_body1", F.lit(False)), ("full_body2", F.lit(False)), ("twin", F.lit(False)), ("n2", F.col("n1"))):
        if name not in pairs.columns:
            pairs = pairs.withColumn(name, value)
    turned = F.struct("box1", "start1", "id1") > F.struct("box2", "start2", "id2")
    sides = []
    for stem in ("id", "box", "start", "end", "n", *more):
        sides += [F.when(turned, F.col(f"{stem}{3 - k}")).otherwise(F.col(f"{stem}{k}")).alias(f"{stem}{k}") for k in (1, 2)]
    first = [F.when(turned, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(c) for c in ("escapes", "full_body")]
    rows = pairs.select(*sides, "overall", *first, "twin").withColumn("span", F.col("end1") - F.col("start1"))

    # a stream of the groups one behind another, as most have few pairs; in a call for each, the call costs more than the choice
    group = ("box1", "box2", "twin")
    order = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in PRIORITY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, ([], [])
        for batch in batches:
            keys, spans = (zip(*(batch.column(c).to_pylist() for c in names), strict=True) for names in (group, ("start1", "end1", "start2", "end2")))
            out = []
            for i, (key, (s1, e1, s2, e2)) in enumerate(zip(keys, spans, strict=True)):
                if key != now:
                    now, kept = key, ([], [])
                if _take(kept, s1, e1, s2, e2):
                    out.append(i)
            yield batch.take(pa.array(out, pa.int32()))

    return rows.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, rows.schema)
