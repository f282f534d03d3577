"""Documents that arrive as Parquet files, cut into chunks for search: a stream that takes only new files, and ends.

    spark-submit jobs/chunk_documents.py --documents IN --chunks OUT --checkpoint DIR [--config FILE]

IN, a folder or a pattern, holds files of (doc_id, text, lang, source, n_chars). OUT is Parquet, partitioned by
lang: a row a chunk. Spark's file sink keeps the log of the files that belong to OUT
and the checkpoint that of the files that were read, so a run that is stopped
anywhere and started again gives the same rows, and a run without new files none.
Read OUT through Spark, which honours that log.

A null or short text has no chunks. Null doc_ids make a null url and id. Files are
taken as new by their names: a file that is written anew under its name isn't.
"""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from granary.functions import text as X
from granary.functions.splitter import split
from granary.runtime import ship
from jobs.common import config, log, session, start

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CHUNK = "id string, doc_id bigint, chunk_index int, text string, n_chars int, title string, breadcrumbs string, lang string"


@dataclass(frozen=True)
class Config:
    chunk_size: int = 500
    chunk_overlap: int = 80
    min_chunk: int = 50
    files_per_batch: int = 1000


def chunks(docs: DataFrame, c: Config = Config()) -> DataFrame:
    """A row a chunk of at least ``min_chunk`` characters; a chunk's id depends on its document and its place."""
    pieces = docs.where(F.char_length("text") >= c.min_chunk).select("*", F.posexplode(split(F.col("text"), c.chunk_size, c.chunk_overlap)).alias("i", "piece"))
    said = X.strip(F.col("piece"))
    rows = pieces.select(
        X.chunk_id(F.concat(F.lit("doc://"), "doc_id"), F.col("i")).alias("id"), "doc_id", F.col("i").alias("chunk_index"), said.alias("text"), F.char_length(said).alias("n_chars"),
        F.coalesce("source", F.lit("")).alias("title"), F.concat_ws(" > ", "lang", "source").alias("breadcrumbs"), "lang",
    )
    return rows.where(F.col("n_chars") >= c.min_chunk)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).parquet(path)


def run(spark: SparkSession, documents: str, target: str, checkpoint: str, c: Config = Config()) -> dict[str, int]:
    """Takes the files of ``documents`` that no run with this ``checkpoint`` took, waits for the end, and counts what was read and written."""
    ship(spark)
    docs = spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", c.files_per_batch).parquet(documents)
    made = chunks(docs.observe("read", F.count(F.lit(1)).alias("documents"), F.sum(F.octet_length("text")).alias("bytes")), c)
    made = made.observe("written", F.count(F.lit(1)).alias("chunks"))
    stream = made.writeStream.format("parquet").partitionBy("lang").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    counts = {"batches": 0, "documents": 0, "bytes": 0, "chunks": 0}
    for p in stream.recentProgress:
        seen = p.observedMetrics
        if "read" in seen:
            own = {"batches": 1, **seen["read"].asDict(), **seen["written"].asDict()}
            log.info("batch %s: %s documents (%s bytes) read from %s, %s chunks written to %s", p.batchId, own["documents"], own["bytes"] or 0, documents, own["chunks"], target)
            counts = {k: v + (own[k] or 0) for k, v in counts.items()}
    log.info("done: %s", counts)
    return counts


def main(argv: list[str] | None = None) -> None:
    a = start(__doc__, {"documents": "folder or pattern of Parquet files", "chunks": "folder of the chunks", "checkpoint": "folder of the stream's checkpoint"}, argv)
    settings = Config(**config(a.config, "chunk_documents.json", tuple(Config.__dataclass_fields__)))
    spark = session("chunk-documents")
    try:
        run(spark, a.documents, a.chunks, a.checkpoint, settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
