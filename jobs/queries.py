"""The jobs as queries: each runs twice into one new folder, and its output is read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.queries import LAYOUT, NAMED, SKIP, SPLIT
from granary.runtime import shared_path

from . import chunk_documents, refresh_pages


def job1_chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "job1")
    # as a pattern, because the table may be one file, and a stream takes a plain path for a folder
    for _ in range(2):
        chunk_documents.run(spark, f"{sf_dir}/documents.parque[t]", f"{folder}/chunks", f"{folder}/checkpoint")
    return chunk_documents.read_chunks(spark, f"{folder}/chunks")


def job2_refresh_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "job2")
    for _ in range(2):
        refresh_pages.run(spark, f"{sf_dir}/pages.parquet", folder)
    return refresh_pages.read_current(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_chunk_documents": job1_chunk_documents, "job2_refresh_pages": job2_refresh_pages}
ORACLE = {
    "job1_chunk_documents": f"""WITH RECURSIVE texts AS (SELECT doc_id AS doc, text FROM documents WHERE length(text) >= 50), {SPLIT}
SELECT substr(sha256('doc://' || doc || '::chunk::' || i), 1, 16) AS id, doc_id, i::INT AS chunk_index, piece AS text, length(piece)::INT AS n_chars, coalesce(source, '') AS title, concat_ws(' > ', lang, source) AS breadcrumbs, lang
FROM split JOIN documents ON doc = doc_id WHERE length(piece) >= 50""",
    "job2_refresh_pages": f"""WITH RECURSIVE {LAYOUT}, last AS (SELECT url, max(page_id) AS page_id FROM page GROUP BY url),
kept AS (SELECT page.*, {NAMED} AS name FROM page JOIN last USING (url, page_id) WHERE content <> '' AND NOT ({SKIP})),
texts AS (SELECT page_id AS doc, CASE WHEN section = '' THEN content WHEN h1 = '' THEN section ELSE h1 || chr(10) || chr(10) || section END AS text FROM kept WHERE length(CASE WHEN section = '' THEN content ELSE section END) >= 50), {SPLIT},
good AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY i) - 1 AS n FROM split WHERE length(piece) >= 50)
SELECT substr(sha256(url || '::chunk::' || CASE WHEN section = '' THEN '' ELSE h1 || '_' END || i), 1, 16) AS id, piece AS text, url, name AS title, CASE WHEN section = '' THEN '' ELSE h1 END AS section_heading, '' AS breadcrumbs,
(CASE WHEN section = '' THEN i ELSE n END)::INT AS chunk_index, NULL::VARCHAR AS content_type, 'general' AS type, 1 AS run FROM good JOIN kept ON doc = page_id""",
}
