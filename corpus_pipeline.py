"""A training corpus from ``documents``: rejects go, one of each near-duplicate group stays, secrets are masked, sources are mixed, tokens are packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.llm import mixing, packing, pu, secrets, simhash
from reprise.storage import materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3; trained on this stage's documents and the table of labels.

    Null texts score as empty ones; repeated rows stay or go together; without labels every score is 0.5 and all stay; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return pu.keep_quality(docs, pu.fit_quality(docs, labels))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, the one of the smallest id; nulls and texts without words are alike, and one of them stays. Empty stays empty."""
    return simhash.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced by a mark, and n_chars follows. Texts without any stay as they are, nulls too; repeated rows are masked alike."""
    found = secrets.with_redacted(secrets.find_secrets(docs), "clean")
    touched = F.size("found") > 0
    new = {"text": F.when(touched, F.col("clean")).otherwise(F.col("doc.text")), "n_chars": F.when(touched, F.length("clean").cast("long")).otherwise(F.col("doc.n_chars"))}
    return found.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, or parts of them, that the mix takes, as often as it takes them. Nulls and texts without words have nothing to take and go."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents with their places in sequences of 2048 tokens; a null text would be an empty one, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("secret scans", secret_scans),
    ("source mix", source_mix),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs


#: SQL can't express a classifier or a packing plan; tests/llm holds the stages against brute force instead.
ORACLE_SQL = None
