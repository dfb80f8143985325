"""Bounded training samples: rows of ``labels`` with the features of their documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reprise.llm.common import per_document
from reprise.llm.docstats import FEATURES, features


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")), F.lit(0)) % folds


def with_features(docs: DataFrame, *keep: str) -> DataFrame:
    types = dict(docs.dtypes)

    def make():
        def step(rows):
            return {k: pa.array(rows[k], _ARROW[types[k]]) for k in keep} | {"features": pa.array([features(t)[1] for t in rows["text"]], pa.list_(pa.float64()))}

        return step

    return per_document(docs.select(*keep, "text"), ", ".join(f"{k} {types[k]}" for k in keep) + ", features array<double>", make)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}


def sample(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """The ``most`` rows with the smallest hashes of doc_id. A first cut by hash leaves about a quarter more, so that little is sorted."""
    share = min(1.0, 1.25 * most / max(1, rows.count()) + 1e-6)
    h = F.xxhash64("doc_id", F.lit(seed))
    low = rows if share == 1.0 else rows.where(h < F.lit(int((share - 0.5) * (1 << 64))).cast("long"))
    return low.orderBy(h, "doc_id").limit(most)


def training_rows(docs: DataFrame, labels: DataFrame, folds: int, max_labelled: int, max_unlabelled: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1, 0, or -1: not looked at) of at most so many rows outside fold 0.

    Rows are taken by the hash of their id, so the sample is the same on each run and
    independent of order. Ids with several labels have the smallest; ids without a
    document, and null ids or labels, don't count. Unlabelled rows come from all documents
    outside fold 0, whatever their label would be.
    """
    inside = fold("doc_id", folds) != 0
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & inside).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    ids = sample(known, max_labelled, 7).select("doc_id", "y")
    if max_unlabelled:
        web = sample(docs.where(F.col("doc_id").isNotNull() & inside).select("doc_id"), max_unlabelled, 11)
        ids = ids.unionByName(web.select("doc_id", F.lit(-1).alias("y")))
    # at most max_labelled + max_unlabelled ids of 12 bytes
    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "y", "text")
    found = with_features(picked, "doc_id", "y").groupBy("doc_id", "y").agg(F.min("features").alias("features")).orderBy("doc_id", "y").toPandas()
    x = np.array(found["features"].tolist(), float).reshape(len(found), len(FEATURES))
    return x, found["y"].to_numpy(int)
