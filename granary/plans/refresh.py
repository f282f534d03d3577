"""The refresh job: fetched pages to page records, to chunks, to the collection and the lexical index.

``spark-submit -m granary.plans.refresh --fetched PATH`` with ``--skip-main``,
``--skip-handbook``, ``--handbook-only`` and ``--areas A B``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.config import Settings
from granary.functions import text as X
from granary.operators import chunks as C
from granary.operators import pages, vectors
from granary.operators.text_index import TextIndex
from granary.runtime import ship
from granary.sources import files


def refresh(spark: SparkSession, fetched: DataFrame, settings: Settings = Settings(), skip_main: bool = False, skip_handbook: bool = False, areas: list[str] | None = None, full_rebuild: bool = False, fresh_hours: int | None = None) -> dict:
    """Runs all steps over all of ``fetched`` and gives counts. Every step is a table on disk before the next reads it.

    ``settings.max_pages`` is a budget of fetching and cuts nothing here. Where
    ``fetched`` has ``content_type``, ``status`` or ``fetched_at``, only what
    ``pages.usable`` admits counts.

    New chunks replace those with their id, of such within one refresh the last by
    file and place; what a site no longer has stays, unless
    ``full_rebuild`` empties the collection first.
    """
    ship(spark)
    fetched = pages.usable(fetched, fresh_hours)
    general, typed, chunks = f"{settings.raw_dir}/all_pages", f"{settings.raw_dir}/handbook_pages", f"{settings.processed_dir}/chunks"
    if not skip_main:
        files.write_json_lines(pages.general_pages(fetched, settings.site), general)
    if not skip_handbook:
        wanted = fetched if not areas else fetched.where(X.code_of(F.col("url"), "course").substr(1, 4).isin(*areas) | (X.page_kind(F.col("url")) == "program"))
        files.write_json_lines(pages.typed_pages(wanted, settings.site), typed)
    found = files.read_pages(spark, general, typed)
    files.write_json_lines(C.chunk_pages(found, settings, ("src_ord",)), chunks)
    made = files.read_chunks(spark, chunks)
    collection = vectors.Collection(spark, settings.index_dir, settings.collection)
    if full_rebuild:
        collection.clear()
    embedded = made.withColumn("embedding", vectors.hashed_embedding(F.col("text")))
    total = collection.upsert(embedded.withColumn("place", F.col("metadata.chunk_index")), ["src_ord", "place"])
    collection.vacuum()
    index_changes(TextIndex(spark, f"{settings.index_dir}/bm25"), made.drop("src_ord"), full_rebuild)
    return C.chunk_statistics(found, made).first().asDict() | {"collection": total}


def index_changes(index: TextIndex, made: DataFrame, full_rebuild: bool = False) -> TextIndex:
    """The index with the chunks of ``made``. Only those of ids whose chunks are new or other than before go into it, as a segment; if there are none, nothing is written.

    With ``full_rebuild`` chunks whose ids ``made`` lacks go.
    """
    if not index.segments:
        return index.add(made, ("id", "text"))
    stamp = lambda df: df.select("id", F.xxhash64("text", F.to_json("metadata")).alias("stamp")).groupBy("id").agg(F.sort_array(F.collect_list("stamp")).alias("stamps"))  # noqa: E731  an id has few chunks
    new, old = stamp(made), stamp(index.documents()).withColumnRenamed("stamps", "was")
    both = new.join(old, "id", "full")
    changed = made.join(both.where("stamps is not null and not stamps <=> was").select("id"), "id", "left_semi")
    gone = both.where("stamps is null").select("id") if full_rebuild else None
    if changed.isEmpty() and (gone is None or gone.isEmpty()):
        return index
    return index.add(changed, ("id", "text"), replace=True, removed=gone)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--fetched", required=True)
    p.add_argument("--skip-main", action="store_true")
    p.add_argument("--skip-handbook", action="store_true")
    p.add_argument("--handbook-only", action="store_true")
    p.add_argument("--full-rebuild", action="store_true")
    p.add_argument("--fresh-hours", type=int)
    p.add_argument("--areas", nargs="*")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("granary-refresh").getOrCreate()
    print(refresh(spark, spark.read.parquet(a.fetched), Settings.from_env(), a.skip_main or a.handbook_only, a.skip_handbook, a.areas, a.full_rebuild, a.fresh_hours))


if __name__ == "__main__":
    main()
