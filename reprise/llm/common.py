"""What several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Fixed value: the separators that the contracts name, [\x20\x09-\x0D]. bytes.split() without arguments splits at exactly these.
SEPARATORS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ as UTF-8; none for null. A lone surrogate can't come from Spark."""
    return text.encode().split() if text else []


def per_document(df: DataFrame, schema: str, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]]) -> DataFrame:
    """mapInArrow with one Python function a task: make() builds it (and its caches), it maps columns to columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for piece in bounded(batch):
                out = step({n: piece.column(i).to_pylist() for i, n in enumerate(piece.schema.names)})
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def bounded(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in slices of ``rows``, so that no more rows are Python objects at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
