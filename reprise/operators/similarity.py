"""Similarity of two arrays: LCS, Levenshtein and positional ratios over units, and their weighted sum.

The expressions suit short windows. For whole tables of pairs, score_pairs does the two dynamic programmes in one Arrow
function, row by row of the programme but all pairs of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reprise.config import WEIGHT_SETS

REFACTORABLE = 0.70
#: Pairs in which one array has more elements are gone through one by one.
_LONG = 64


def _longer(a: Column, b: Column) -> Column:
    return F.greatest(F.size(a), F.size(b))


def _ratio(a: Column, b: Column, value: Column) -> Column:
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(value)


def lcs_length(a: Column, b: Column) -> Column:
    """The length of the longest common subsequence: one row of the programme for each element of a."""
    first = F.transform(F.sequence(F.lit(0), F.size(b)), lambda _: F.lit(0))

    def row(before: Column, x: Column) -> Column:
        def cell(now: Column, j: Column) -> Column:
            diagonal, above, left = F.get(before, j - 1), F.get(before, j), F.get(now, j - 1)
            return F.concat(now, F.array(F.when(F.get(b, j - 1) == x, diagonal + 1).otherwise(F.greatest(above, left))))

        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(F.lit(0)), cell)

    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).otherwise(F.aggregate(a, first, row, lambda r: F.element_at(r, -1)))


def edit_distance(a: Column, b: Column) -> Column:
    first = F.sequence(F.lit(0), F.size(b))

    def row(before: Column, x: Column) -> Column:
        def cell(now: Column, j: Column) -> Column:
            cost = F.when(F.get(b, j - 1) == x, F.lit(0)).otherwise(F.lit(1))
            return F.concat(now, F.array(F.least(F.get(before, j) + 1, F.get(now, j - 1) + 1, F.get(before, j - 1) + cost)))

        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(F.get(before, F.lit(0)) + 1), cell)

    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, _longer(a, b)).otherwise(F.aggregate(a, first, row, lambda r: F.element_at(r, -1)))


def lcs(a: Column, b: Column) -> Column:
    return _ratio(a, b, lcs_length(a, b) / _longer(a, b))


def levenshtein(a: Column, b: Column) -> Column:
    return _ratio(a, b, 1 - edit_distance(a, b) / _longer(a, b))


def positional(a: Column, b: Column) -> Column:
    """Equal places over the longer size."""
    n = F.least(F.size(a), F.size(b))
    equal = F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return _ratio(a, b, equal / _longer(a, b))


def equal_bits(a: Column, b: Column, most: int) -> Column:
    """The equal places of arrays of up to ``most`` (at most 31) elements, as bits. No lambda, which would cost far more for each of many pairs."""
    return sum((F.coalesce((F.get(a, F.lit(i)) == F.get(b, F.lit(i))).cast("int"), F.lit(0)) * (1 << i) for i in range(most)), F.lit(0))


def positional_short(a: Column, b: Column, most: int) -> Column:
    """``positional`` of arrays of one size from 1 to ``most`` (at most 31) elements."""
    return F.bit_count(equal_bits(a, b, most)) / F.size(a)


def combined(lcs_: Column, lev: Column, pos: Column, weights: tuple[float, float, float] = WEIGHT_SETS["balanced"]) -> Column:
    return lcs_ * F.lit(weights[0]) + lev * F.lit(weights[1]) + pos * F.lit(weights[2])


def programmes(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lcs length, edit distance, equal places) of each pair of integer arrays."""
    flat = [np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (a, b)]
    ends = [np.cumsum([0, *(len(v) for v in x)]) for x in (a, b)]
    return flat_programmes(flat[0], ends[0], flat[1], ends[1])


def _padded(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray, width: int, fill: int) -> np.ndarray:
    at = offsets[rows][:, None] + np.arange(width)
    inside = at < offsets[rows + 1][:, None]
    return np.where(inside, values[np.where(inside, at, 0)], fill) if len(values) else np.full(at.shape, fill, np.int64)


def _groups(na: np.ndarray, nb: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of up to _LONG elements, those of like sizes together, so that little is padded: a group's longest has at most twice its shortest, or 8."""
    longer = np.maximum(na, nb)
    order = np.lexsort((nb, na, longer))[: np.count_nonzero(longer <= _LONG)]
    kinds = np.ceil(np.log2(np.maximum(longer[order], 8))).astype(int)
    for part in np.split(order, np.flatnonzero(np.diff(kinds)) + 1):
        yield from (part[at : at + 2048] for at in range(0, len(part), 2048))


def reachable(a: np.ndarray, a_offsets: np.ndarray, b: np.ndarray, b_offsets: np.ndarray, weights: tuple[float, float, float]) -> np.ndarray:
    """What each pair's overall score can be at most: neither programme gives more than the elements of one array that the other one has. Long pairs: 1."""
    na, nb = np.diff(a_offsets), np.diff(b_offsets)
    out = np.ones(len(na))
    for rows in _groups(na, nb):
        x, y = _padded(a, a_offsets, rows, int(na[rows].max()), -1), _padded(b, b_offsets, rows, int(nb[rows].max()), -2)
        there = np.zeros(x.shape, bool)
        for j in range(y.shape[1]):
            there |= (x == y[:, j : j + 1]) & (j < nb[rows])[:, None]
        common = (there & (np.arange(x.shape[1]) < na[rows][:, None])).sum(axis=1)
        w = min(x.shape[1], y.shape[1])
        equal = ((x[:, :w] == y[:, :w]) & (np.arange(w) < np.minimum(na, nb)[rows][:, None])).sum(axis=1)
        longer = np.maximum(na, nb)[rows]
        out[rows] = np.where(longer == 0, 1.0, ((weights[0] + weights[1]) * common + weights[2] * equal) / np.maximum(longer, 1))
    return out


def long_programmes(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """The same of one pair: rows of the programmes are whole numbers, a bit for each element of a (Hyyro; Myers). Equal heads and tails are set aside."""
    n = min(len(a), len(b))
    equal = int((a[:n] == b[:n]).sum())
    head = int(np.argmin(np.append(a[:n] == b[:n], False)))
    tail = int(np.argmin(np.append((a[::-1][: n - head] == b[::-1][: n - head]), False)))
    x, y = a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist()
    if not x or not y:
        return head + tail, max(len(x), len(y)), equal
    at: dict[int, list[int]] = {v: [] for v in y}
    for i, v in enumerate(x):
        if v in at:
            at[v].append(i)
    often = {v: sum(1 << i for i in places) for v, places in at.items() if len(places) > 32}  # of all values, masks would grow with the square of the size
    full, top = (1 << len(x)) - 1, 1 << len(x) - 1
    free, more, less, edits = full, full, 0, len(x)  # free: the places that the subsequence doesn't use; more, less: where a column goes up and down by 1
    for v in y:
        same = often[v] if v in often else sum(1 << i for i in at[v])
        used = free & same
        free = ((free + used) | (free - used)) & full
        down, across = same | less, (((same & more) + more) ^ more) | same
        up, left = (less | ~(across | more)) & full, more & across
        edits += bool(up & top) - bool(left & top)
        up, left = (up << 1 | 1) & full, (left << 1) & full
        more, less = (left | ~(down | up)) & full, up & down
    return head + tail + len(x) - free.bit_count(), edits, equal


def flat_programmes(a: np.ndarray, a_offsets: np.ndarray, b: np.ndarray, b_offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of arrays that lie one behind another, the k-th from offsets[k] to offsets[k + 1]."""
    na, nb = np.diff(a_offsets), np.diff(b_offsets)
    out = np.zeros((3, len(na)), np.int64)
    longer = np.maximum(na, nb)
    for k in np.flatnonzero(longer > _LONG):
        out[:, k] = long_programmes(a[a_offsets[k] : a_offsets[k + 1]], b[b_offsets[k] : b_offsets[k + 1]])
    for rows in _groups(na, nb):
        wa, wb = int(na[rows].max(initial=0)), int(nb[rows].max(initial=0))
        x, y = _padded(a, a_offsets, rows, wa, -1), _padded(b, b_offsets, rows, wb, -2)
        w = min(wa, wb)
        out[2, rows] = ((x[:, :w] == y[:, :w]) & (np.arange(w) < np.minimum(na, nb)[rows][:, None])).sum(axis=1)
        common, edits = np.zeros((len(rows), wb + 1), np.int64), np.broadcast_to(np.arange(wb + 1), (len(rows), wb + 1)).copy()
        pick = np.arange(len(rows))
        done = na[rows] == 0
        out[0, rows[done]], out[1, rows[done]] = 0, nb[rows][done]
        steps = np.arange(wb + 1)
        for i in range(wa):
            same = x[:, i : i + 1] == y
            best = np.maximum(common[:, 1:], np.where(same, common[:, :-1] + 1, 0))
            common = np.concatenate([common[:, :1], np.maximum.accumulate(best, axis=1)], axis=1)
            near = np.minimum(edits[:, 1:] + 1, edits[:, :-1] + ~same)
            near = np.concatenate([np.full((len(rows), 1), i + 1), near], axis=1)
            edits = np.minimum.accumulate(near - steps, axis=1) + steps  # insertions run along the row
            ends = na[rows] == i + 1
            out[0, rows[ends]] = common[pick[ends], nb[rows][ends]]
            out[1, rows[ends]] = edits[pick[ends], nb[rows][ends]]
    return out[0], out[1], out[2]


def score_pairs(pairs: DataFrame, a: str = "units1", b: str = "units2", weights: tuple[float, float, float] = WEIGHT_SETS["balanced"], least: float | None = None) -> DataFrame:
    """Replace the arrays of each pair by lcs, lev, positional, overall and can_refactor. Null arrays count as empty.

    ``least``: pairs that can't reach it overall, by the elements they have in common, may be left out before the programmes; others below it stay.
    """
    kept = [c for c in pairs.columns if c not in (a, b)]
    types = dict(pairs.dtypes)
    filled = {c: F.coalesce(c, F.array().cast(types[c])) for c in (a, b)}
    # whole numbers, as windows have them, are compared as they are
    hashed = pairs.select(*kept, *(filled[c].alias(c) if types[a] == types[b] == "array<bigint>" else F.transform(filled[c], lambda x: F.xxhash64(x)).alias(c) for c in (a, b)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [(np.asarray(x.values.fill_null(-3)), np.asarray(x.offsets, np.int64)) for x in (batch.column(c) for c in (a, b))]
            if least is not None and min(weights) >= 0:
                held = np.flatnonzero(reachable(*lists[0], *lists[1], weights) >= least - 1e-9)
                batch = batch.take(pa.array(held))
                lists = [(np.asarray(x.values.fill_null(-3)), np.asarray(x.offsets, np.int64)) for x in (batch.column(c) for c in (a, b))]
            longer = np.maximum(*(np.diff(offsets) for _, offsets in lists)).astype(float)
            common, edits, equal = flat_programmes(*lists[0], *lists[1])
            with np.errstate(invalid="ignore", divide="ignore"):
                values = [np.where(longer == 0, 1.0, v / longer) for v in (common, longer - edits, equal)]
                values[1] = np.where(longer == 0, 1.0, 1 - edits / longer)
            overall = values[0] * weights[0] + values[1] * weights[1] + values[2] * weights[2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, values), pa.array(overall), pa.array(overall >= REFACTORABLE)], [*kept, "lcs", "lev", "positional", "overall", "can_refactor"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + (", " if kept else "") + "lcs double, lev double, positional double, overall double, can_refactor boolean"
    return hashed.mapInArrow(run, schema)
