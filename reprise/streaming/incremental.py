"""The LSH index as a stream: each batch of new sequences meets what came before, then joins it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reprise.operators import lsh

SCHEMA = "id long, band int, bucket long"


def query_and_add(spark: SparkSession, index_path: str, batch: DataFrame, batch_id: int, bands: int = 25, rows_per_band: int = 4) -> DataFrame:
    """(id1, id2): pairs of the batch with earlier sequences and with each other; the batch's buckets are then in the index.

    The index has a folder for each batch, written in overwrite mode: a batch that is run again doesn't come in twice, and doesn't meet itself as an earlier one.
    """
    target = f"{index_path}/batch={batch_id}"
    lsh.bucket_rows(batch, "id", "units", bands, rows_per_band).write.mode("overwrite").parquet(target)
    index = spark.read.schema(SCHEMA + ", batch int").option("basePath", index_path).parquet(index_path)
    new = index.where(F.col("batch") == batch_id).drop("batch")
    old = index.where(F.col("batch") < batch_id).drop("batch").alias("o")
    n = new.alias("n")
    met = n.join(old, (F.col("n.band") == F.col("o.band")) & (F.col("n.bucket") == F.col("o.bucket"))).select(F.least("n.id", "o.id").alias("id1"), F.greatest("n.id", "o.id").alias("id2"))
    return met.where("id1 <> id2").unionByName(lsh.candidate_pairs(new, "id")).distinct()


def run(stream: DataFrame, index_path: str, checkpoint: str, sink: Callable[[DataFrame, int], None], bands: int = 25, rows_per_band: int = 4, available_now: bool = True) -> StreamingQuery:
    """stream: id, units. sink gets the candidate pairs of each batch and its number."""

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(query_and_add(batch.sparkSession, index_path, batch, batch_id, bands, rows_per_band), batch_id)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
