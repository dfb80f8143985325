"""Shingles, MinHash signatures and banded buckets.

Two forms: a portable one, from md5 and modular arithmetic, that any SQL engine computes alike; and a fast one, in which one
Arrow function does tokens, shingles and signature of a text, hashing each unit once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reprise.storage import discard, materialize, release

SHINGLE = 3
PRIME = (1 << 31) - 1


def seeds(hashes: int) -> list[tuple[int, int]]:
    """Multiplier and addend of each portable hash function, below PRIME, from a linear congruence."""
    out, x = [], 20_240_607
    for _ in range(hashes):
        x = (x * 48_271) % PRIME
        a = x
        x = (x * 48_271) % PRIME
        out.append((a, x))
    return out


def portable_hash(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def shingles(tokens: Column, k: int = SHINGLE) -> Column:
    """The distinct k-token shingles, joined by a space; up to k tokens make one shingle."""
    n = F.greatest(F.size(tokens) - k, F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.array_join(F.slice(tokens, i, F.lit(k)), " ")))


def portable_wide(df: DataFrame, key: str, shingle_column: str, hashes: int) -> DataFrame:
    """(key, m0, m1, ..): the least hash of each function over a set of shingles, one row a key. Partial minima are taken before the shuffle."""
    # the outer form, as the optimiser would put a copy of the shingles' whole expression in a filter before the inner one
    rows = df.select(key, F.explode_outer(shingle_column).alias("s")).where("s is not null").select(key, portable_hash(F.col("s")).alias("h"))
    return rows.groupBy(key).agg(*[F.min((F.col("h") * a + b) % PRIME).alias(f"m{i}") for i, (a, b) in enumerate(seeds(hashes))])


def portable_signatures(wide: DataFrame, key: str, hashes: int) -> DataFrame:
    """(key, slot, value) of portable_wide's rows."""
    return wide.select(key, F.posexplode(F.array(*[F.col(f"m{i}") for i in range(hashes)])).alias("slot", "value"))


def portable_buckets(wide: DataFrame, key: str, bands: int, rows_per_band: int) -> DataFrame:
    """(key, band, bucket) of portable_wide's rows, without a further shuffle."""
    made = [F.md5(F.concat_ws("-", *[F.col(f"m{b * rows_per_band + r}") for r in range(rows_per_band)])) for b in range(bands)]
    return wide.select(key, F.posexplode(F.array(*made)).alias("band", "bucket"))


def _check(bands: int, rows_per_band: int, hashes: int) -> None:
    if not 1 <= bands <= 256 or bands * rows_per_band != hashes:
        raise ValueError("bands must be between 1 and 256, and bands times rows must be the signature's length")


def signature(tokens: list[list[int]], hashes: int, k: int = SHINGLE) -> np.ndarray:
    """The fast signature of a sequence of units' token hashes; an empty one has a signature of its own."""
    flat = np.array([t for unit in tokens for t in unit], np.uint64)
    with np.errstate(over="ignore"):
        if len(flat) > k:
            h = flat[: len(flat) - k + 1].copy()
            for i in range(1, k):
                h = h * np.uint64(0x9E3779B97F4A7C15) + flat[i : len(flat) - k + 1 + i]
        else:
            h = np.zeros(1, np.uint64)
            for t in flat:
                h = h * np.uint64(0x9E3779B97F4A7C15) + t
        h = np.unique(h)
        seed = np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        best = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(h), 4096):
            x = h[at : at + 4096, None] ^ seed[None, :]
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            best = np.minimum(best, (x ^ (x >> np.uint64(32))).min(axis=0))
    return best


def bucket_rows(df: DataFrame, key: str, units: str, bands: int = 25, rows_per_band: int = 4, k: int = SHINGLE) -> DataFrame:
    """(key, band, bucket) of arrays of units, by fast signatures; in one pass, without a shuffle."""
    hashes = bands * rows_per_band
    _check(bands, rows_per_band, hashes)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[int]] = {}
        for batch in batches:
            out: list[np.ndarray] = []
            for value in batch.column(1).to_pylist():
                own = []
                for unit in value or []:
                    if unit not in cache:
                        if len(cache) > 100_000:
                            cache.clear()
                        cache[unit] = [xxhash.xxh64_intdigest(t) for t in unit.encode().lower().split()]
                    own.append(cache[unit])
                out.append(signature(own, hashes, k).reshape(bands, rows_per_band))
            if out:
                keys = [xxhash.xxh64_intdigest(x.tobytes()) for s in out for x in s]
                at = pa.array(np.repeat(np.arange(len(out)), bands))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(out))), pa.array(np.array(keys, np.uint64).view(np.int64))], [key, "band", "bucket"])

    return df.select(key, units).mapInArrow(run, f"`{key}` {kind}, band int, bucket long")


def candidate_pairs(buckets: DataFrame, key: str) -> DataFrame:
    """(id1, id2), id1 < id2: keys that share a bucket. An equi-join, whose hot buckets AQE splits over tasks; none is capped."""
    a, b = buckets.alias("a"), buckets.alias("b")
    met = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col(f"a.{key}") < F.col(f"b.{key}")))
    return met.select(F.col(f"a.{key}").alias("id1"), F.col(f"b.{key}").alias("id2")).distinct()


def estimate(a: Column, b: Column) -> Column:
    """The share of equal slots of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def estimated_pairs(signatures: DataFrame, key: str, bands: int, rows_per_band: int) -> DataFrame:
    """(id1, id2, estimate): pairs of keys that share a band of their signature (an array), each once, with their share of equal slots.

    Signatures are carried into the join by the bands that several keys have, so pairs need no further join, however many there are.
    Spark takes an array for a single element where it guesses a table's size, so signatures come as a written table, which it knows the size of.
    """
    made = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.slice("signature", b * rows_per_band + 1, rows_per_band))
    rows = signatures.select(key, F.posexplode(made).alias("band", "slots"))
    shared = materialize(rows.groupBy("band", "slots").agg(F.count("*").alias("c")).where("c > 1").drop("c"), "shared")
    own = rows.join(shared, ["band", "slots"], "left_semi").groupBy(key).agg(F.collect_list("band").alias("all"))
    held = materialize(signatures.join(own, key), "held")
    discard(shared)
    release(signatures.sparkSession)
    met = held.select(key, "signature", "all", F.explode("all").alias("band")).withColumn("slots", F.slice("signature", F.col("band") * rows_per_band + 1, F.lit(rows_per_band)))
    a, b = (met.select("band", "slots", F.col(key).alias(f"id{k}"), F.col("signature").alias(f"s{k}"), F.col("all").alias(f"all{k}")) for k in (1, 2))
    met = a.join(b, ["band", "slots"]).where("id1 < id2")
    # a pair meets at every band that both share with others and that is equal; it is taken at the first
    equal = F.filter(F.array_intersect("all1", "all2"), lambda x: F.slice("s1", x * rows_per_band + 1, rows_per_band) == F.slice("s2", x * rows_per_band + 1, rows_per_band))
    return met.where(F.array_min(equal) == F.col("band")).select("id1", "id2", estimate(F.col("s1"), F.col("s2")).alias("estimate"))
