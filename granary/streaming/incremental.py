"""Pages that arrive as files, chunked, embedded and put into a collection as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granary import schemas
from granary.config import Settings
from granary.operators.chunks import chunk_pages
from granary.operators.vectors import Collection, hashed_embedding


def upsert_stream(spark: SparkSession, folder: str, collection: Collection, checkpoint: str, settings: Settings = Settings()) -> StreamingQuery:
    """Works through all JSON-lines files of ``folder`` that weren't read yet, and ends.

    Of pages with one url in a batch the one crawled last counts. A batch that is run
    again puts the same ids in again, so the collection is the same as after one run.
    A batch writes its own rows only.
    """
    pages = spark.readStream.schema(schemas.PAGE).json(folder)

    def put(batch: DataFrame, _: int) -> None:
        chunks = chunk_pages(batch, settings, ("last_crawled",))
        chunks = chunks.withColumn("embedding", hashed_embedding(F.col("text"))).withColumn("place", F.col("metadata.chunk_index"))
        collection.upsert(chunks, ["last_crawled", "place"])

    return pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
