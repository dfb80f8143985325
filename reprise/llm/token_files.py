"""Token ids in binary shards with a keyed index.

A shard is two files: raw ids (unsigned, little-endian, documents one after the other; 16 bits each where the
vocabulary has at most 65,536 ids, else 32) and an index, in which a minimal perfect hash takes a document's key to a slot holding a fingerprint of the key, the document's offset and
its length in ids. Shards follow ascending doc_id, nulls first; rows of one id follow by text. A key is (doc_id, its how-manieth row).

Each task attempt writes files of its own names; the manifest lists those of the attempts that Spark committed, so
a lost or repeated task leaves nothing half-written in it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reprise.llm import mph, tokens
from reprise.storage import materialize, scratch_path, shuffle_partitions

END_ID = 1
#: Documents of a shard on average, once there are more than the session's partitions hold; bounds an index and a task's keys.
SHARD_DOCS = 200_000
_NULL = -(1 << 63)


def _keys(ids: np.ndarray, nth: np.ndarray, null: np.ndarray) -> np.ndarray:
    return mph.mix(mph.mix(ids.astype(np.int64).view(np.uint64), 101) + nth.astype(np.uint64) * np.uint64(2) + null.astype(np.uint64), 102)


def _prints(keys: np.ndarray) -> np.ndarray:
    return (mph.mix(keys, 103) >> np.uint64(32)).astype(np.uint32)


def _nth(ids: list, last: tuple) -> tuple[list[int], tuple]:
    """How often each of these sorted ids came before it; last carries over from the rows before."""
    out = []
    for x in ids:
        last = (x, last[1] + 1) if last[1] >= 0 and last[0] == x else (x, 0)
        out.append(last[1])
    return out, last


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None) -> DataFrame:
    """Encode every text of ``docs`` (doc_id, text), each followed by END_ID, into shards under ``path``.

    Returns the manifest: shard, first_id, n_docs, n_tokens, width (bytes an id), payload, index, start (ids in all shards before).
    A null text is an empty one; an empty table gives an empty manifest.
    """
    schema = "shard int, first_id long, n_docs long, n_tokens long, width int, payload string, index string"
    width = 2 if tokens.vocabulary_size(vocabulary) <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = tokens.encoder(vocabulary), np.array([END_ID], "<u4").tobytes()
        shard, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        store, folder = _open(path)
        out, ids, nth, lengths, last = None, [], [], [], (None, -1)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                if out is None:
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(f"{folder}/{name}.ids")
                got = rows.column("doc_id").to_pylist()
                more, last = _nth(got, last)
                coded = [x + end for x in encode(rows.column("text").to_pylist())]
                out.write(np.frombuffer(b"".join(coded), "<u4").astype(f"<u{width}").tobytes())
                ids.append(np.array([_NULL if x is None else x for x in got], np.int64))
                nth.append(np.array([2 * n + (x is None) for n, x in zip(more, got, strict=True)], np.int64))
                lengths.append(np.array([len(x) // 4 for x in coded], np.int64))
        if out is None:
            return
        out.close()
        ids, both, lengths = (np.concatenate(x) for x in (ids, nth, lengths))
        keys = _keys(ids, both >> 1, both & 1)
        table = mph.PerfectHash.build(keys)
        slots = table.slots(keys)
        order = np.argsort(slots, kind="stable")
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        with store.open_output_stream(f"{folder}/{name}.idx") as f:
            f.write(mph.dump({"sizes": table.sizes, "bits": np.packbits(table.bits), "rest": table.rest, "prints": _prints(keys)[order], "offsets": starts[order], "lengths": lengths[order]}))
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int32()), "first_id": pa.array([int(ids[0])], pa.int64()), "n_docs": pa.array([len(ids)], pa.int64()),
            "n_tokens": pa.array([int(lengths.sum())], pa.int64()), "width": pa.array([width], pa.int32()), "payload": [f"{path}/{name}.ids"], "index": [f"{path}/{name}.idx"],
        })

    n_shards = max(shuffle_partitions(docs.sparkSession), -(-docs.count() // SHARD_DOCS))
    dealt = docs.select("doc_id", "text").repartitionByRange(n_shards, "doc_id").sortWithinPartitions("doc_id", "text")
    shards = materialize(dealt.mapInArrow(run, schema), "manifest")
    from pyspark.sql import Window

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class Shard:
    """Keyed access to one shard: the index is held, ids are read from the payload when asked for."""

    def __init__(self, payload: str, index: str, width: int):
        store, at = _open(index)
        with store.open_input_file(at) as f:
            a = mph.load(f.read())
        n = int(a["sizes"].sum())
        self.table = mph.PerfectHash(a["sizes"], np.unpackbits(a["bits"], count=n).astype(bool), a["rest"])
        self.prints, self.offsets, self.lengths = a["prints"], a["offsets"], a["lengths"]
        store, at = _open(payload)
        self.file, self.width = store.open_input_file(at), width

    def find(self, ids: list[int | None], nth: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(offset, length) in ids of each key; -1 where the fingerprint says that the shard hasn't got it."""
        values = np.array([_NULL if x is None else x for x in ids], np.int64)
        keys = _keys(values, np.array(nth, np.int64), np.array([x is None for x in ids], np.int64))
        slots = self.table.slots(keys)
        known = slots >= 0
        known[known] = self.prints[slots[known]] == _prints(keys[known])
        offsets, lengths = np.full(len(keys), -1, np.int64), np.full(len(keys), -1, np.int64)
        offsets[known], lengths[known] = self.offsets[slots[known]], self.lengths[slots[known]]
        return offsets, lengths

    def read(self, offset: int, length: int) -> bytes:
        """The ids as unsigned 32-bit integers, whatever their width in the file."""
        raw = self.file.read_at(self.width * length, self.width * offset)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4").tobytes()

    def close(self) -> None:
        self.file.close()


def read_ids(keys: DataFrame, manifest: DataFrame) -> DataFrame:
    """Look up every row of ``keys`` (doc_id) in the files of ``manifest``.

    Per row: doc_id, start (ids of all documents before), n_tokens, ids_crc32; rows whose key isn't there are left out.
    The driver and each task hold one line a shard (some 200 bytes), never the documents' keys.
    """
    shards = [r.asDict() for r in manifest.orderBy("shard").collect()]
    firsts = np.array([s["first_id"] for s in shards], np.int64)
    counted = keys.groupBy("doc_id").agg(F.count("*").alias("n"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.array([_NULL if x is None else x for x in b.column(0).to_pylist()], np.int64)
            shard = np.maximum(0, np.searchsorted(firsts, ids, "right") - 1).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n": b.column(1), "shard": pa.array(shard)})

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, Shard] | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = batch.slice(at, 4096).to_pydict()
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                k = 0
                while k < len(rows["shard"]):
                    shard, end = rows["shard"][k], k
                    while end < len(rows["shard"]) and rows["shard"][end] == shard:
                        end += 1
                    if held is None or held[0] != shard:
                        if held:
                            held[1].close()
                        held = (shard, Shard(*(shards[shard][k] for k in ("payload", "index", "width"))))
                    pairs = [(x, i) for x, n in zip(rows["doc_id"][k:end], rows["n"][k:end], strict=True) for i in range(n)]
                    offsets, lengths = held[1].find([x for x, _ in pairs], [i for _, i in pairs])
                    for (x, _), o, n in zip(pairs, offsets.tolist(), lengths.tolist(), strict=True):
                        if o >= 0:
                            out["doc_id"].append(x)
                            out["start"].append(shards[shard]["start"] + o)
                            out["n_tokens"].append(n)
                            out["ids_crc32"].append(zlib.crc32(held[1].read(o, n)))
                    k = end
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in out.items()})
        if held:
            held[1].close()

    if not shards:
        return counted.select("doc_id", *(F.lit(0).cast("long").alias(c) for c in ("start", "n_tokens", "ids_crc32"))).where("false")
    dealt = counted.mapInArrow(deal, "doc_id long, n long, shard int").repartition(len(shards), "shard").sortWithinPartitions("shard", "doc_id")
    return dealt.mapInArrow(look, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_to_files(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the ids of ``docs`` to files in the shared folder and read them back by key: doc_id, start, n_tokens, ids_crc32.

    A null text is an empty one and has its end id alone. Null ids come first; rows of one id follow by text, and each gives a row,
    exact repeats included. Other columns aren't read; an empty table gives no rows.
    """
    manifest = write_ids(docs, scratch_path(docs.sparkSession, "ids"), vocabulary)
    return read_ids(docs.select("doc_id"), manifest)
