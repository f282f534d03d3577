"""From page records to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.config import Settings
from granary.functions import text as X
from granary.functions.splitter import split, split_many


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _metadata(heading: Column, index: Column, kind: Column) -> Column:
    trail = F.array_join(F.coalesce("breadcrumbs", F.array().cast("array<string>")), " > ")
    return F.struct(F.col("url"), _text("title").alias("title"), heading.alias("section_heading"), trail.alias("breadcrumbs"), index.cast("int").alias("chunk_index"), kind.cast("string").alias("content_type"))


def chunk_typed_pages(pages: DataFrame, settings: Settings = Settings(), carry: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of course and program pages: whole if short, else their content in pieces, each below the header."""
    line = lambda label, name, end="": F.when(_text(name) != "", F.concat(F.lit(label), F.col(name), F.lit(end)))
    level = F.when(_text("level") != "", F.concat(F.lit("Level: "), F.initcap("level")))
    course = F.concat_ws("\n", _text("title"), line("", "uoc", " Units of Credit"), level, line("Faculty: ", "faculty"), line("School: ", "school"), line("Offering: ", "offering_terms"))
    program = F.concat_ws("\n", _text("title"), line("Duration: ", "duration"), line("Faculty: ", "faculty"))
    header = F.when(F.col("type") == "course", course).otherwise(program)
    base = pages.withColumn("header", header).withColumn("whole", F.concat("header", F.lit("\n\n"), _text("content")))
    short = F.char_length("whole") <= 3 * settings.chunk_size
    kind = F.col("type")
    atomic = base.where(short).select(X.chunk_id(F.col("url"), F.lit("atomic_0")).alias("id"), X.strip(F.col("whole")).alias("text"), _metadata(F.lit(""), F.lit(0), kind).alias("metadata"), *carry)
    pieces = base.where(~short).select("*", F.posexplode(split(_text("content"), settings.chunk_size, settings.chunk_overlap)).alias("i", "piece"))
    pieces = pieces.where(F.char_length(X.strip(F.col("piece"))) >= settings.min_chunk)
    parts = pieces.select(X.chunk_id(F.col("url"), F.concat(F.lit("hb_"), F.col("i"))).alias("id"), F.concat("header", F.lit("\n\n"), X.strip(F.col("piece"))).alias("text"), _metadata(F.lit(""), F.col("i"), kind).alias("metadata"), *carry)
    return atomic.unionByName(parts)


def chunk_general_pages(pages: DataFrame, settings: Settings = Settings(), carry: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of each section; of the whole content where a page has no sections.

    A chunk's index counts the chunks that a page keeps, over its sections. A
    page's pieces stay in one array until they are counted, so nothing shuffles.
    """
    none = F.expr("cast(array() as array<struct<heading:string,content:string>>)")
    parts = F.filter(F.coalesce("sections", none), lambda s: F.char_length(F.coalesce(s.content, F.lit(""))) >= settings.min_chunk)
    titled = lambda s: F.when(F.coalesce(s.heading, F.lit("")) != "", F.concat(s.heading, F.lit("\n\n"), s.content)).otherwise(s.content)
    base = pages.withColumn("has_sections", F.size(F.coalesce("sections", none)) > 0)
    rows = base.where("has_sections").withColumn("parts", parts)
    rows = rows.withColumn("pieces", split_many(F.transform("parts", titled), settings.chunk_size, settings.chunk_overlap))

    def kept(s: Column, k: Column) -> Column:
        own = F.transform(F.get("pieces", k), lambda t, i: F.struct(F.coalesce(s.heading, F.lit("")).alias("heading"), i.alias("i"), X.strip(t).alias("t")))
        return F.filter(own, lambda x: F.char_length(x.t) >= settings.min_chunk)

    rows = rows.select("*", F.posexplode(F.flatten(F.transform("parts", kept))).alias("k", "chunk"))
    heading = F.col("chunk.heading")
    by_section = rows.select(X.chunk_id(F.col("url"), F.concat(heading, F.lit("_"), F.col("chunk.i"))).alias("id"), F.col("chunk.t").alias("text"), _metadata(heading, F.col("k"), F.lit(None)).alias("metadata"), *carry)
    plain = base.where(~F.col("has_sections") & (F.char_length(_text("content")) >= settings.min_chunk)).select("*", F.posexplode(split(_text("content"), settings.chunk_size, settings.chunk_overlap)).alias("i", "piece"))
    plain = plain.where(F.char_length(X.strip(F.col("piece"))) >= settings.min_chunk)
    whole = plain.select(X.chunk_id(F.col("url"), F.col("i")).alias("id"), X.strip(F.col("piece")).alias("text"), _metadata(F.lit(""), F.col("i"), F.lit(None)).alias("metadata"), *carry)
    return by_section.unionByName(whole)


def chunk_pages(pages: DataFrame, settings: Settings = Settings(), carry: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of all pages, each by its type, with the columns ``carry`` of their page."""
    typed = F.coalesce(F.col("type").isin("course", "program"), F.lit(False))
    return chunk_general_pages(pages.where(~typed), settings, carry).unionByName(chunk_typed_pages(pages.where(typed), settings, carry))


def chunk_statistics(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """n_pages, n_chunks, chunks_per_page and duplicate_ids."""
    n = chunks.groupBy("id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"), F.count_if(F.col("n") > 1).alias("duplicate_ids"))
    return pages.agg(F.count("*").alias("n_pages")).crossJoin(n).withColumn("chunks_per_page", F.col("n_chunks") / F.greatest("n_pages", F.lit(1)))
