"""The knowledge bank as a stream: arriving documents are compared with the bank so far, then added to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType

from quillmark.operators.chunks import chunks
from quillmark.params import BANK

BANK_COLUMNS = ["doc_id", "chunk_ix", "start_offset", "end_offset", "word_count", "normalized_text", "content_hash"]


def grow_bank(documents: DataFrame, bank_path: str, checkpoint: str, on_batch=None) -> StreamingQuery:
    """Appends the chunks of every micro-batch of ``documents`` (doc_id, text) to the bank, partitioned by batch.

    ``on_batch(batch, bank)`` sees the batch and the bank of the batches before it: what arrived earlier. A batch that
    is run again overwrites its own partition.
    """
    schema = StructType(chunks(documents, BANK).select(*BANK_COLUMNS).schema.fields).add("batch", LongType())
    documents.sparkSession.createDataFrame([], schema).write.mode("append").partitionBy("batch").parquet(bank_path)  # the folder, if it is new

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        if on_batch is not None:
            # the schema is given, so that the first batch, which finds no files, finds an empty bank
            earlier = spark.read.option("basePath", bank_path).schema(schema).parquet(bank_path)
            on_batch(batch, earlier.where(F.col("batch") < batch_id).drop("batch"))
        chunks(batch, BANK).select(*BANK_COLUMNS).write.mode("overwrite").parquet(f"{bank_path}/batch={batch_id}")
        batch.unpersist()

    return documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
