"""Mixing sources to target weights.

A source's documents form one stream of words, cut into blocks of one length. The mix is a row of slots, dealt into output
shards. Each shard draws its source counts from a multinomial whose chances are what the sources still owe, so all shards
together meet every quota exactly. A source's j-th slot takes block p(j) of a pseudorandom permutation of its
blocks, a new one on each pass; a source with q slots and n blocks thus uses each block floor(q/n) or ceil(q/n) times.
Slots meet blocks by an equi-join on (source, block).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reprise.llm.common import bounded, per_document, words_of
from reprise.llm.mph import mix
from reprise.storage import materialize

# The weights by source, repeating, and how often a source may be repeated.
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK = 128
#: A source has at least so many blocks, if it has so many words: small sources have shorter blocks, so that whole blocks come near their targets.
LEAST_BLOCKS = 256
#: Slots of an output shard at least, and output shards at most (then they grow).
SHARD_SLOTS = 8192
MOST_SHARDS = 65_536
#: Documents of a source whose places are added up together.
RUN = 4_000


def share_out(sizes: list[int], weights: tuple = WEIGHTS, most: int = MOST_REPEATS) -> list[float]:
    """Targets by source: the sum of sizes, shared by weight, none over ``most`` times its size; excess goes to the others again."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    target, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(w[i] for i in open_)
        above = [i for i in open_ if left * w[i] / total > most * sizes[i]]
        if not above:
            for i in open_:
                target[i] = left * w[i] / total
            break
        for i in above:
            target[i] = float(most * sizes[i])
        left -= sum(target[i] for i in above)
        open_ = [i for i in open_ if i not in set(above)]
    return target


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each key: four Feistel rounds, repeated while the value is outside."""
    half = np.array([max(1, (int(x - 1).bit_length() + 1) // 2) for x in np.unique(n)])
    half = half[np.searchsorted(np.unique(n), n)].astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, k, v = half[todo], low[todo], key[todo], out[todo]
        left, right = v >> h, v & m
        for r in range(4):
            left, right = right, left ^ (mix(right ^ (k << np.uint64(3)), 7 + r) & m)
        out[todo] = v = (left << h) | right
        todo = todo[v >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def draw_shards(quota: np.ndarray, shard_slots: int, seed: int) -> np.ndarray:
    """Source counts by output shard (rows); their sums are ``quota``."""
    left, rows = quota.astype(np.int64).copy(), []
    while left.sum():
        k = min(shard_slots, int(left.sum()))
        rng = np.random.Generator(np.random.Philox(key=[seed, len(rows)]))
        got = np.zeros_like(left)
        while (need := k - int(got.sum())) > 0:
            owed = left - got
            got += np.minimum(rng.multinomial(need, owed / owed.sum()), owed)
        rows.append(got)
        left -= got
    return np.array(rows, np.int64).reshape(-1, len(quota))


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, key, size) per row; key is a hash of all three of id, source and text."""

    def make():
        def step(rows):
            size = pa.array([len(words_of(t)) for t in rows["text"]], pa.int64())
            return {"doc_id": pa.array(rows["doc_id"], pa.int64()), "source": pa.array(rows["source"], pa.string()), "key": pa.array(rows["key"], pa.int64()), "size": size}

        return step

    rows = docs.select("doc_id", "source", F.xxhash64("doc_id", "source", "text").alias("key"), "text")
    return per_document(rows, "doc_id long, source string, key long, size long", make)


@dataclass
class Plan:
    placed: DataFrame  # a row per document: its source's figures, and where it begins in its source's stream
    cut: DataFrame  # (source_no, begin, block, part_from, part_to): the parts of documents in blocks, in words of the document
    times: DataFrame  # (source_no, block, times): how often the mix takes a block


def plan_mix(docs: DataFrame, weights: tuple = WEIGHTS, block: int = BLOCK, seed: int = 17, run: int = RUN) -> Plan | None:
    """Lay out the sources of ``docs`` (doc_id, source, text) and draw the mix; None for an empty table.

    The driver holds one row a source and the counts by shard and source, at most MOST_SHARDS rows.
    """
    spark = docs.sparkSession
    sized = materialize(word_counts(docs), "sizes")
    spread = sized.withColumn("run", F.pmod(F.xxhash64("doc_id", "size"), F.lit(max(1, sized.count() // run))).cast("int"))
    tally = materialize(spread.groupBy("source", "run").agg(F.sum("size").alias("words")), "tally")
    found = tally.groupBy("source").agg(F.sum("words").alias("words")).collect()
    sources = sorted(((r["source"], int(r["words"])) for r in found), key=lambda x: (x[0] is None, x[0] or ""))
    if not sources:
        return None
    sizes = [n for _, n in sources]
    targets = share_out(sizes, weights)
    widths = [max(1, min(block, n // LEAST_BLOCKS)) for n in sizes]
    blocks = np.array([-(-n // w) for n, w in zip(sizes, widths, strict=True)], np.int64)
    quota = np.array([round(t * b / n) if n else 0 for t, b, n in zip(targets, blocks.tolist(), sizes, strict=True)], np.int64)
    counts = draw_shards(quota, max(SHARD_SLOTS, -(-int(quota.sum()) // MOST_SHARDS)), seed)
    starts = np.cumsum(counts, axis=0) - counts

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0).to_pylist():
                own = counts[shard]
                source = np.repeat(np.arange(len(own)), own)
                j = np.arange(len(source)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(starts[shard], own)
                n = blocks[source]
                key = mix((j // n).astype(np.uint64) * np.uint64(1 << 20) + source.astype(np.uint64), seed)
                yield pa.RecordBatch.from_pydict({"source_no": pa.array(source.astype(np.int32)), "block": pa.array(permute(j % n, n, key))})

    rows = [(i, s, n, t, w) for i, ((s, n), t, w) in enumerate(zip(sources, targets, widths, strict=True))]
    table = spark.createDataFrame(rows, "source_no int, source string, source_size long, target double, width long")
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = tally.select("source", "run", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "run").orderBy("doc_id", "size", "key").rowsBetween(Window.unboundedPreceding, -1)
    a, r = spread.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("a"), runs.alias("r")
    placed = a.join(r, F.col("a.source").eqNullSafe(F.col("r.source")) & (F.col("a.run") == F.col("r.run"))).select("doc_id", "size", "key", "a.source", (F.col("before") + F.col("inside")).alias("begin")).alias("p")
    placed = placed.join(table.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("doc_id", "size", "key", "p.source", "source_no", "source_size", "target", "width", "begin")
    placed = materialize(placed, "placed")

    times = spark.range(len(counts), numPartitions=max(1, min(len(counts), 4096))).mapInArrow(slots, "source_no int, block long").groupBy("source_no", "block").agg(F.count("*").alias("times"))
    times = times.hint("merge")  # or the planner would take the table for as small as the range of shards, and broadcast it
    cut = placed.where("size > 0").select("source_no", "begin", "size", "width", F.explode(F.expr("sequence(begin div width, (begin + size - 1) div width)")).alias("block"))
    part_from = F.greatest(F.col("begin"), F.col("block") * F.col("width")) - F.col("begin")
    part_to = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * F.col("width")) - F.col("begin")
    return Plan(placed, cut.select("source_no", "begin", "block", part_from.alias("part_from"), part_to.alias("part_to")), times)


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, text): doc_id, size, source, source_size, target (its source's), taken.

    A null text has no words and a document without words takes none; null sources are one source, last in order; repeated rows
    and null ids are documents of their own; an empty table gives no rows.
    """
    plan = plan_mix(docs, weights, block, seed)
    if plan is None:
        return docs.select("doc_id", F.lit(0).cast("long").alias("size"), "source", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    words = (F.col("part_to") - F.col("part_from")) * F.col("times")
    taken = plan.cut.join(plan.times, ["source_no", "block"]).groupBy("source_no", "begin").agg(F.sum(words).alias("taken"))
    full = plan.placed.withColumn("at", F.when(F.col("size") > 0, F.col("begin"))).join(taken.withColumnRenamed("begin", "at").hint("merge"), ["source_no", "at"], "left")
    return full.select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``; n_chars, where there is one, follows the text.

    A document gives as many rows as its most taken block is taken. Its first row has the parts taken at least once, its second those taken at
    least twice, and so on; a row with all parts has the text as it was, others their words, joined by one space. What the mix
    doesn't take isn't there, and so are documents without words. An empty table gives no rows.
    """
    plan = plan_mix(docs, weights, block, seed)
    if plan is None:
        return docs
    parts = plan.cut.join(plan.times, ["source_no", "block"]).groupBy("source_no", "begin").agg(F.collect_list(F.struct("part_from", "part_to", "times")).alias("_parts"))
    same = Window.partitionBy("_id", "_key")
    taken = plan.placed.where("size > 0").join(parts.hint("merge"), ["source_no", "begin"]).select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("key").alias("_key"), "begin", "_parts")
    taken = taken.select("_id", "_key", F.row_number().over(same.orderBy("begin")).alias("_nth"), "_parts")
    # repeated rows are alike in id, source and text, so any of them may have any of the places
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.xxhash64("doc_id", "source", "text").alias("_key"), F.col("text").alias("_text"))
    rows = rows.withColumn("_nth", F.row_number().over(same.orderBy("_key")))
    joined = rows.join(taken, ["_id", "_key", "_nth"]).select("_row", "_text", "_parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for large in batches for piece in bounded(large)):
            at, texts = [], []
            for i, (text, parts) in enumerate(zip(batch.column("_text").to_pylist(), batch.column("_parts").to_pylist(), strict=True)):
                words = words_of(text)
                whole = sum(p["part_to"] - p["part_from"] for p in parts) == len(words)
                parts.sort(key=lambda p: p["part_from"])
                for copy in range(1, max(p["times"] for p in parts) + 1):
                    some = [p for p in parts if p["times"] >= copy]
                    complete = whole and len(some) == len(parts)
                    texts.append(text if complete else b" ".join(w for p in some for w in words[p["part_from"] : p["part_to"]]).decode())
                    at.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("_row").take(pa.array(at, pa.int64())), pa.array(texts, pa.string())], ["_row", "_text"])

    row_type = joined.schema["_row"].dataType
    from pyspark.sql.types import StringType, StructField, StructType

    made = joined.mapInArrow(run, StructType([StructField("_row", row_type), StructField("_text", StringType())]))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return made.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
