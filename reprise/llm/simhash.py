"""SimHash near-duplicates by multi-index hashing.

Fingerprints are found document by document. Distinct fingerprints then go into
one table per bit segment. With 64 bits in m segments and a radius of
k = m*r + a differing bits, two near fingerprints differ by at most r bits in one of
the first a+1 segments or by at most r-1 in one of the others, so each fingerprint
enumerates those small balls, meets the table's entries in the same bucket, and
whole distances are verified there.

A bucket that holds more than ``block`` rows is split into pairs of blocks, which go
to different tasks; a task never holds more than one pair of blocks. Each gives a
spanning forest of its links instead of all its pairs, so no link between two
groups is lost and rows stay in proportion to blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reprise.llm.common import per_document
from reprise.operators.components import connected_components
from reprise.storage import materialize, shuffle_partitions

BITS = 64
#: Shingles whose bits are counted at a time; bounds the memory for one very long text.
CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = 4) -> int:
    """The unsigned 64-bit SimHash of a text; 0 for a text without words."""
    w = text.encode().lower().split() if text else []  # bytes.lower() changes A-Z alone
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        h = np.array([digest(join(w[i : i + words]), 42) for i in range(at, min(n, at + CHUNK))], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) per row of ``docs``; fp is the fingerprint as a signed long. A null text counts as empty."""

    def make():
        def step(rows):
            fps = np.array([fingerprint(t, words) for t in rows["text"]], np.uint64).view(np.int64)
            return {"doc_id": pa.array(rows["doc_id"], pa.int64()), "fp": pa.array(fps)}

        return step

    return per_document(docs.select("doc_id", "text"), "doc_id long, fp long", make)


def segments(parts: int) -> list[tuple[int, int]]:
    """(offset, width) of each bit segment, the wider ones first."""
    width, extra = divmod(BITS, parts)
    out, at = [], 0
    for i in range(parts):
        out.append((at, width + (i < extra)))
        at += out[-1][1]
    return out


def _probes(fps: DataFrame, radius: int, parts: int) -> DataFrame:
    """(bucket, fp): a fingerprint in its own bucket of each table and in those of its small balls.

    Of two segments that differ, exactly one has a zero at the lowest differing bit; only that one probes.
    """
    small, over = divmod(radius, parts)
    tables = None
    for k, (at, width) in enumerate(segments(parts)):
        r = small if k <= over else small - 1
        if r < 0:
            continue
        masks = [sum(1 << b for b in bits) for n in range(r + 1) for bits in combinations(range(width), n)]
        seg = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        rows = fps.select("fp", seg.alias("seg"), F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
        rows = rows.where("(seg & mask & -mask) = 0").select((F.col("seg").bitwiseXOR(F.col("mask")) + F.lit(k << 58).cast("long")).alias("bucket"), "fp")
        tables = rows if tables is None else tables.unionByName(rows)
    return tables


def _forest(fp: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links between left and right (indexes into fp)."""
    a, b = np.nonzero(np.bitwise_count(fp[left][:, None] ^ fp[right][None, :]) <= radius)
    a, b = left[a], right[b]
    off = a != b
    a, b = a[off], b[off]
    if len(a) <= len(left) + len(right):
        return a, b
    root = np.arange(len(fp))
    keep = np.zeros(len(a), bool)
    while True:  # hook the larger root to the smallest it meets, then shorten all paths
        ra, rb = root[a], root[b]
        live = ra != rb
        if not live.any():
            return a[keep], b[keep]
        hi, lo = np.maximum(ra, rb)[live], np.minimum(ra, rb)[live]
        order = np.lexsort((lo, hi))
        first = order[np.r_[True, np.diff(hi[order]) != 0]]
        keep[np.nonzero(live)[0][first]] = True
        root[hi[first]] = lo[first]
        while not np.array_equal(root, root[root]):
            root = root[root]


def _verify(radius: int, small: int = 48):
    def links(bucket: np.ndarray, side: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows sorted by bucket (a bucket here is one pair of blocks). side: 0 any, else which block of the pair."""
        starts = np.r_[0, np.nonzero(np.diff(bucket))[0] + 1]
        sizes = np.diff(np.r_[starts, len(bucket)])
        size = np.repeat(sizes, sizes)
        at = np.arange(len(bucket)) - np.repeat(starts, sizes)
        out_a, out_b = [], []
        row = np.nonzero((size > 1) & (size <= small))[0]
        off = 1
        while len(row := row[at[row] + off < size[row]]):
            hit = row[np.bitwise_count(fp[row] ^ fp[row + off]) <= radius]
            out_a.append(fp[hit])
            out_b.append(fp[hit + off])
            off += 1
        for s, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
            own, sides = fp[s : s + n], side[s : s + n]
            left = np.nonzero(sides <= 1)[0]
            right = np.nonzero(sides != 1)[0]
            a, b = _forest(own, left, right, radius)
            out_a.append(own[a])
            out_b.append(own[b])
        none = np.zeros(0, np.uint64)
        a, b = np.concatenate([none, *out_a]), np.concatenate([none, *out_b])
        off = a != b
        return a[off], b[off]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the rows of a bucket may go on in the next batch
        names = ("bucket", "i", "j", "side", "fp")

        def emit(cols):
            new = np.r_[True, (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)]
            a, b = links(np.cumsum(new), cols[3], cols[4].view(np.uint64))
            return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            differs = np.nonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))[0]
            cut = differs[-1] + 1 if len(differs) else 0
            held = [c[cut:] for c in cols]
            if cut:
                yield emit([c[:cut] for c in cols])
        if held and len(held[0]):
            yield emit(held)

    return run


def parts_for(distinct: int, radius: int, least_load: float = 16.0) -> int:
    """How many segments: as many as leave a table's buckets few strangers. More segments mean smaller balls, fewer mean wider segments.

    Any number finds the same links; this one only keeps the chance meetings of a probe, distinct fingerprints over buckets, under ``least_load``.
    """
    return next((m for m in range(max(1, radius - 1), 1, -1) if distinct / 2 ** (BITS // m) < least_load), 2)


def near_links(fps: DataFrame, radius: int = 4, parts: int | None = None, block: int = 2048) -> DataFrame:
    """Links (a, b) between distinct values of ``fp``: enough of those within ``radius`` bits to connect whatever all of them connect."""
    spark = fps.sparkSession
    known = materialize(fps.select("fp").distinct(), "known")
    rows = _probes(known, radius, parts or parts_for(known.count(), radius))
    hot = materialize(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > block), "hot")  # see components on why
    rows = rows.join(hot, "bucket", "left").withColumn("blocks", F.ceil(F.coalesce("n", F.lit(1)) / F.lit(block)).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"), "fp",
    )
    dealt = rows.repartition(shuffle_partitions(spark), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(_verify(radius), "a long, b long")


def simhash_groups(docs: DataFrame, words: int = 4, radius: int = 4, parts: int | None = None, block: int = 2048) -> DataFrame:
    """Near-duplicate groups of ``docs`` (doc_id, text; other columns are not read).

    Per row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id in reach).
    Texts without words (null, empty, blank) have fingerprint zero and link like others. Repeated rows stay
    repeated. A null doc_id is never a component's id unless the whole group has none. An empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, words), "simhash")
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = connected_components(near_links(fps, radius, parts, block))
    roots = firsts.join(linked.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    roots = materialize(roots.select("fp", "root", "first"), "roots")
    lowest = materialize(roots.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")
    owners = roots.join(lowest, "root").select("fp", "component_id")
    return fps.join(owners, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that stand for their near-duplicate group: those with its smallest doc_id.

    Rows that repeat an id and its text are one document and give one row. Rows without an id stay where no row with an
    id is near; identical ones among them give one row.
    """
    groups = simhash_groups(docs, words, radius)
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "fingerprint").distinct()
    known = docs.where("doc_id is not null").join(stay.where("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    known = known.dropDuplicates(["doc_id", "text"])
    # rows without an id are told apart by their fingerprints; the columns of docs stay inside a struct, so that no name clashes
    lone = stay.where("doc_id is null").select("fingerprint")
    marked = docs.where("doc_id is null").dropDuplicates(["text"]).select(F.struct("*").alias("row"), "text", F.xxhash64("text").alias("doc_id"))
    prints = fingerprints(marked, words).select(F.col("doc_id").alias("key"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")).distinct()
    blank = marked.join(prints.join(lone, "fingerprint").select(F.col("key").alias("doc_id")).distinct(), "doc_id", "left_semi").select("row.*")
    return known.select(docs.columns).unionByName(blank.select(docs.columns))
