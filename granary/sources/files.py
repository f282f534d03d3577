"""JSON-lines sources and sinks, and the seeds of a crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import schemas
from granary.config import Site


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank and malformed lines are left out; a path that isn't there has no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_pages(spark: SparkSession, *paths: str) -> DataFrame:
    """Pages of several files, with ``src_ord``, the place of a page's file; FileNotFoundError if none is there."""
    if not any(exists(spark, p) for p in paths):
        raise FileNotFoundError(f"none of {', '.join(paths)} is there")
    parts = [read_json_lines(spark, p, schemas.PAGE).withColumn("src_ord", F.lit(i)) for i, p in enumerate(paths)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks with ``src_ord``, the place of their page's file (null where it wasn't written)."""
    return read_json_lines(spark, path, f"{schemas.CHUNK}, src_ord int")


def write_json_lines(df: DataFrame, path: str) -> None:
    """Replaces what is there."""
    df.write.mode("overwrite").json(path)


def seeds(spark: SparkSession, site: Site) -> DataFrame:
    return spark.createDataFrame([(x,) for x in site.seeds], "url string")


def catalogue_seeds(spark: SparkSession, site: Site, areas: list[str] | None = None, year: str | None = None) -> DataFrame:
    """Listing pages, and a query page for each area and level. ``year`` changes the query pages only."""
    listing = spark.createDataFrame([(x, None) for x in site.listing_urls()], "url string, area string")
    area = spark.createDataFrame([(x,) for x in (areas or site.areas)], "area string")
    level = spark.createDataFrame([(x,) for x in site.levels], "level string")
    made = F.format_string(f"{site.catalogue}/%s/courses/{year or site.year}?query=%s", "level", "area")
    return listing.unionByName(area.crossJoin(level).select(made.alias("url"), "area"))
