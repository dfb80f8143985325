"""Substring dedup by level-wise doubling of repeated windows.

A document with the same words as a smaller one goes altogether, and takes no further part. Of the others, windows of the
shortest length are counted, and those that occur in one document alone drop out. The survivors alone are extended to twice the length (one
less where that is odd), counted and thinned out again, and so on up to the full window, or until none survive.

A full window holds many windows of a shorter length; of these, the one with the smallest hash leads it. Equal windows have
equal leaders, so a level counts only leaders, about one in twenty words, and loses no repeat: a full window's leaders, one of each
level, are its chain, and a chain ends where its leader of some level is in one document alone.

A match of full windows is one of 128 bits, so among n of them about n*n/2**129 pairs of different ones are taken for equal.
Shorter levels' hashes have 64 bits: a false match there costs a little work and changes nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reprise.llm.common import per_document, words_of
from reprise.storage import discard, materialize

WINDOW = 50
#: Words of the shortest level at least.
START = 12
_TABLE_WORDS = 500_000


class _WordHashes(dict):
    """Words' hashes, each found once; emptied when too many."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, 977)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > _TABLE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_HASHES = _WordHashes()


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9DDFEA08EB382D69) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each window of ``size``: doubled lengths, put together."""
    done, out, level, length = 0, None, words, 1
    while True:
        if size & length:
            if out is None:
                out, done = level, length
            else:  # the longer part first
                n = len(words) - done - length + 1
                out, done = _join(level[: max(0, n)], out[length : length + max(0, n)]), done + length
        length *= 2
        if length > size:
            return out[: max(0, len(words) - size + 1)]
        half = length // 2
        level = _join(level[: max(0, len(level) - half)], level[half:])


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """Minimum or maximum over each run of ``width`` values, by doubling."""
    n, level, length = len(x) - width + 1, x, 1
    while 2 * length <= width:
        level = best(level[:-length], level[length:])
        length *= 2
    return best(level[:n], level[width - length : width - length + n])


def lengths(window: int, start: int = START) -> list[int]:
    """Rising lengths of the levels, each about twice the one before; the last is ``window``, the first at least ``start`` or half the window."""
    out = [window]
    while out[0] > 1 and (len(out) == 1 or (out[0] + 1) // 2 >= start):
        out.insert(0, (out[0] + 1) // 2)
    return out


def level_hashes(words: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """The hashes of the windows of each size; each level's are put together from two windows of the level before."""
    out = [window_hashes(words, sizes[0])]
    for before, size in zip(sizes, sizes[1:], strict=False):
        n, shift = max(0, len(words) - size + 1), size - before
        out.append(_join(out[-1][:n], out[-1][shift : shift + n]))
    return out


def chains(words: np.ndarray, sizes: list[int]) -> np.ndarray:
    """For each full window the hash of its leader at each shorter level (a row a window)."""
    return np.stack([_slide(h, sizes[-1] - size + 1, np.minimum) for h, size in zip(level_hashes(words, sizes), sizes[:-1], strict=False)], axis=1)


def full_hashes(words: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each full window."""
    return level_hashes(words, sizes)[-1], window_hashes((words ^ (words >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25), sizes[-1])


def _survey(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """Per row: doc_id, n_words, words_sha256, and the distinct chains of its windows."""

    def make():
        def step(rows):
            out = {"doc_id": rows["doc_id"], "n_words": [], "words_sha256": [], "chains": []}
            for text in rows["text"]:
                words = words_of(text)
                out["n_words"].append(len(words))
                out["words_sha256"].append(hashlib.sha256(b" ".join(words)).hexdigest())
                found = np.zeros((0, len(sizes) - 1), np.uint64)
                if len(words) >= sizes[-1]:
                    found = chains(_HASHES.of(words), sizes)
                    found = found[np.r_[True, (np.diff(found, axis=0) != 0).any(axis=1)]]  # neighbours mostly share their chain
                out["chains"].append(found.view(np.int64).tolist())
            return {"doc_id": pa.array(out["doc_id"], pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()), "words_sha256": pa.array(out["words_sha256"]), "chains": pa.array(out["chains"], pa.list_(pa.list_(pa.int64())))}

        return step

    return per_document(docs.select("doc_id", "text"), "doc_id long, n_words long, words_sha256 string, chains array<array<long>>", make)


def _survivors(found: DataFrame, levels: int) -> DataFrame:
    """(doc_id, chain) whose leaders of all levels are in several documents; each level sees what the one before left."""
    for level in range(levels):
        keyed = found.select("doc_id", "chain", F.get("chain", F.lit(level)).alias("h"))
        repeated = materialize(keyed.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h"), f"level{level}")
        left = materialize(keyed.join(repeated, "h").select("doc_id", "chain"), f"chains{level}")
        for old in (found, repeated):
            discard(old)
        found = left
        if found.isEmpty():
            break
    return found


def _full_windows(docs: DataFrame, candidates: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, w, v): the distinct hashes of full windows whose chain survives."""

    def make():
        def step(rows):
            ids, found = [], []
            for doc, text, lead in zip(rows["doc_id"], rows["text"], rows["leaders"], strict=True):
                words = _HASHES.of(words_of(text))
                if len(words) < sizes[-1]:
                    continue
                at = np.nonzero(np.isin(chains(words, sizes)[:, -1], np.array(lead, np.int64).view(np.uint64)))[0]
                w, v = full_hashes(words, sizes)
                w, first = np.unique(w[at], return_index=True)
                ids.append(np.full(len(w), doc, np.int64))
                found.append((w, v[at][first]))
            if not ids:
                return None
            w, v = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
            return {"doc_id": pa.array(np.concatenate(ids)), "w": pa.array(w), "v": pa.array(v)}

        return step

    joined = docs.select("doc_id", "text").join(candidates, "doc_id").select("doc_id", "text", "leaders")
    return per_document(joined, "doc_id long, w long, v long", make)


def _cut(docs: DataFrame, marked: DataFrame, sizes: list[int]) -> DataFrame:
    """Of documents with marked windows: doc_id, words_sha256, n_removed, kept_sha256, kept_text."""

    window = sizes[-1]

    def make():
        def step(rows):
            out = {k: [] for k in ("words_sha256", "n_removed", "kept_sha256", "kept_text")}
            for text, marks in zip(rows["text"], rows["marks"], strict=True):
                words = words_of(text)
                kept = words
                if len(words) >= window:
                    n = len(words) - window + 1
                    hit = np.isin(level_hashes(_HASHES.of(words), sizes)[-1], np.array(marks, np.int64).view(np.uint64))
                    edge = np.zeros(len(words) + 1, np.int64)
                    edge[:n] += hit
                    edge[window : window + n] -= hit
                    gone = np.cumsum(edge)[:-1] > 0
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                joined = b" ".join(kept)
                for k, v in zip(out, (hashlib.sha256(b" ".join(words)).hexdigest(), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()), strict=True):
                    out[k].append(v)
            return {"doc_id": pa.array(rows["doc_id"], pa.int64())} | {k: pa.array(v, pa.int64() if k == "n_removed" else pa.string()) for k, v in out.items()}

        return step

    joined = docs.select("doc_id", "text").join(marked, "doc_id").select("doc_id", "text", "marks")
    return per_document(joined, "doc_id long, words_sha256 string, n_removed long, kept_sha256 string, kept_text string", make)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Remove words covered by windows that also start in a document with a smaller doc_id.

    Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256 (and kept_text: the kept words, joined by one
    space; null where nothing was removed). Windows are judged on the input. A null text has no words. Rows with a
    null id are neither smaller nor larger than others and stay whole. Rows of one id are one document: they don't remove
    each other's words. An empty table gives no rows.
    """
    sizes = lengths(window)
    survey = materialize(_survey(docs, sizes), "survey")
    # what hot keys meet is written out first: AQE splits a join's key only where both sides come straight from a shuffle
    owners = materialize(survey.where("doc_id is not null").groupBy("words_sha256").agg(F.min("doc_id").alias("owner")), "owners")
    rows = survey.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull()).select("doc_id", "words_sha256").distinct()
    copies = materialize(materialize(rows, "long").join(owners, "words_sha256").where("doc_id <> owner").select("doc_id", "words_sha256"), "copies")
    whole = survey.where("doc_id is not null and size(chains) > 0").join(copies, ["doc_id", "words_sha256"], "left_anti")
    found = _survivors(materialize(whole.select("doc_id", F.explode("chains").alias("chain")), "chains"), len(sizes) - 1)
    candidates = materialize(found.groupBy("doc_id").agg(F.collect_set(F.element_at("chain", -1)).alias("leaders")), "leaders")
    windows = materialize(_full_windows(docs, candidates, sizes), "windows")
    first = materialize(windows.groupBy("w", "v").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("w", "v", "low"), "first")
    marked = windows.join(first, ["w", "v"]).where("doc_id > low").groupBy("doc_id").agg(F.collect_set("w").alias("marks"))
    cut = materialize(_cut(docs, marked, sizes), "cut").dropDuplicates(["doc_id", "words_sha256"])
    for old in (found, candidates, windows, first):
        discard(old)
    gone = copies.select("doc_id", "words_sha256", F.lit(-1).cast("long").alias("n_removed"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.lit("").alias("kept_text"))
    changed = cut.join(copies, ["doc_id", "words_sha256"], "left_anti").unionByName(gone)
    out = survey.drop("chains").join(changed, ["doc_id", "words_sha256"], "left")
    removed = F.when(F.col("n_removed") < 0, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.coalesce("kept_sha256", "words_sha256").alias("kept_sha256"), *["kept_text"] * with_text)
