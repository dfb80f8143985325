"""Packing documents' tokens into fixed-length sequences by minimum bin slack.

Only how many pieces have each length matters for the plan, and there are at most ``length`` lengths, so the driver plans
over that histogram, however many pieces there are. Per bin, the longest piece left goes in and a subset-sum
programme over bit sets (one shift and one OR per length and doubled count) finds the fullest combination of the
lengths still available for the rest of the bin. That pattern is used as often as the counts allow, so each pattern uses up
a length and there are at most about ``length`` of them. Pieces are then numbered within their
length and meet their place in the pattern table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reprise.llm import tokens
from reprise.llm.common import per_document
from reprise.storage import materialize

LENGTH = 2048
#: Pieces that are numbered together by one task.
RUN = 10_000


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length fill ``room`` as far as possible. counts: pieces available by length."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for size in sorted((s for s in counts if s <= room), reverse=True):
        left, take = min(counts[size], room // size), 1
        while left > 0:  # counts in doubled portions: any number up to ``left`` is a sum of some
            n = min(take, left)
            steps.append((size, n, reach))
            reach |= (reach << (size * n)) & mask
            left, take = left - n, take * 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for size, n, before in reversed(steps):
        if not before >> at & 1:
            used[size] = used.get(size, 0) + n
            at -= size * n
    return used


def plan(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, dict[int, int]]]:
    """(how many bins, {piece length: how many in each}) patterns that hold every piece of the histogram."""
    counts = {s: n for s, n in histogram.items() if n > 0}
    out = []
    while counts:
        first = max(counts)
        counts[first] -= 1
        used = fullest({s: n for s, n in counts.items() if n > 0}, length - first)
        counts[first] += 1
        used[first] = used.get(first, 0) + 1
        times = min(counts[s] // n for s, n in used.items())
        out.append((times, used))
        for s, n in used.items():
            counts[s] -= n * times
            if not counts[s]:
                del counts[s]
    return out


def places(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from_rank, to_rank, each, first_bin, at): ranks in [from, to) of a length lie ``each`` to a bin, from offset ``at`` on."""
    rows, taken, bins = [], {}, 0
    for times, used in patterns:
        at = 0
        for size in sorted(used, reverse=True):
            n, start = used[size], taken.get(size, 0)
            rows.append((size, start, start + n * times, n, bins, at))
            taken[size] = start + n * times
            at += size * n
        bins += times
    return rows


def cut_pieces(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, row, piece, start, length, ids_crc32 (and ids); ``row`` tells repeated ids apart.

    A document is its ids and then id 0; one that is longer than ``length`` is cut every ``length`` ids. A null text is empty, so every row gives a piece.
    """
    end = np.array([0], "<u4").tobytes()

    def make():
        encode = tokens.encoder(vocabulary)

        def step(rows):
            out = {k: [] for k in ("doc_id", "row", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids)}
            for doc, row, raw in zip(rows["doc_id"], rows["row"], encode(rows["text"]), strict=True):
                raw += end
                for piece, at in enumerate(range(0, len(raw), 4 * length)):
                    part = raw[at : at + 4 * length]
                    values = [doc, row, piece, at // 4, len(part) // 4, zlib.crc32(part)]
                    for k, v in zip(out, values + [np.frombuffer(part, "<u4").astype(np.int32)] * with_ids, strict=True):
                        out[k].append(v)
            types = {"piece": pa.int32(), "ids": pa.list_(pa.int32())}
            return {k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()}

        return step

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    schema = "doc_id long, row long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return per_document(rows, schema, make)


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, with_ids: bool = False, run: int = RUN) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``length`` ids; one row per piece, with sequence_id and offset.

    Pieces of a sequence lie without gaps from offset 0. Null ids, repeated rows and null texts (one id each) are packed
    like all others; an empty table gives no rows. Sequence ids have no meaning beyond telling sequences apart.
    """
    pieces = materialize(cut_pieces(docs, length, vocabulary, with_ids), "pieces")
    total = pieces.count()
    runs = max(1, -(-total // run))
    # ranks within a length: first within a run of it, then by the runs before; no task holds a whole length
    spread = pieces.withColumn("run", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(runs)).cast("int"))
    tally = spread.groupBy("length", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    tally = materialize(tally.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "tally")
    histogram = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``length`` rows
    table = places(plan(histogram, length))
    by_length: dict[int, tuple] = {}
    for size in {r[0] for r in table}:
        own = np.array([r[1:] for r in table if r[0] == size], np.int64)
        by_length[size] = tuple(own.T)

    inside = Window.partitionBy("length", "run").orderBy("doc_id", "row", "piece")
    # the tally grows with the pieces: a merge join, never a broadcast
    ranked = spread.withColumn("at", F.row_number().over(inside) - 1).join(tally.select("length", "run", "before").hint("merge"), ["length", "run"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, (F.col("before") + F.col("at")).alias("rank"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, ranks = b.column("length").to_numpy(), b.column("rank").to_numpy()
            bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes).tolist():
                rows = sizes == size
                start, _, each, first, at = by_length[size]
                k = np.searchsorted(start, ranks[rows], "right") - 1
                i = ranks[rows] - start[k]
                bins[rows], offsets[rows] = first[k] + i // each[k], at[k] + i % each[k] * size
            kept = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(bins), pa.array(offsets)], [*kept, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return ranked.mapInArrow(put, schema)
