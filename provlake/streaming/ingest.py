"""Documents as a stream: each micro-batch is chunked and put into the index, once for each batch of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest import ChunkConfig, index_documents
from ..sources.io import upsert_index


def stream_documents(spark: SparkSession, source: str, schema: str = "doc_id long, text string", files_a_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)


def index_stream(documents: DataFrame, index: str, checkpoint: str, config: ChunkConfig = ChunkConfig()) -> StreamingQuery:
    """Start a query that ends when all that is there is indexed. Upserts by chunk_id make a repeated batch harmless."""

    def put(batch: DataFrame, _: int) -> None:
        from pyspark.sql import functions as F

        rows = index_documents(batch, config)
        upsert_index(rows.withColumn("chunk_id", F.concat_ws("/", F.col("doc_id").cast("string"), "chunk_id")), index)

    return documents.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
