"""The link graph: links of pages, new links, and the frontier of a crawl over stored pages."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.functions.html import join_urls, unescaped
from granary.runtime import shared_path


def resolved(src: Column, href: Column) -> Column:
    """``href`` against ``src`` as ``join_urls`` does it. Plain absolute and root-relative ones are resolved in the JVM; Python gets nulls in their place."""
    plain = href.rlike(r"^(?:[a-z][a-z0-9+.-]*:/)?/[^\s\x00-\x20]*$") & ~href.rlike(r"(?:^|/)\.\.?(?:[/?#;]|$)") & ~href.rlike(r"[?#;](?:#|$)|[\[\]]")
    rest = F.coalesce(~plain, F.lit(False))
    return F.when(rest, join_urls(F.when(rest, src), F.when(rest, href))).otherwise(X.resolve_link(src, href))


def decoded(href: Column) -> Column:
    """Character references resolved. ``&amp;`` alone is resolved in the JVM; Python gets nulls in place of hrefs that have no other."""
    rest = F.coalesce(href.rlike("&(?!amp;)#?[a-zA-Z0-9]"), F.lit(False))
    return F.when(rest, unescaped(F.when(rest, href))).otherwise(F.replace(href, F.lit("&amp;"), F.lit("&")))


def links(pages: DataFrame) -> DataFrame:
    """(src, href, url) for each link; the url of what can't be one is null."""
    out = pages.select(F.col("url").alias("src"), F.explode(X.hrefs(F.col("html"))).alias("href"))
    out = out.withColumn("href", decoded(F.col("href"))).where("href <> ''")
    return out.withColumn("url", resolved(F.col("src"), F.col("href")))


def valid_links(found: DataFrame, domains: tuple[str, ...]) -> DataFrame:
    return found.where(X.valid_link(F.col("url"), domains))


def new_links(found: DataFrame, visited: DataFrame) -> DataFrame:
    """(norm_url) of links that, normalized, aren't among the visited urls; each once."""
    seen = visited.select(X.normalize_url(F.col("url")).alias("norm_url")).distinct()
    return found.where("url is not null").select(X.normalize_url(F.col("url")).alias("norm_url")).distinct().join(seen, "norm_url", "left_anti")


def frontier(pages: DataFrame, domains: tuple[str, ...], visited: DataFrame | None = None) -> DataFrame:
    """(norm_url) of what a crawl fetches next: valid links of ``pages`` that aren't visited (nor pages of these)."""
    seen = pages.select("url") if visited is None else visited.select("url").unionByName(pages.select("url"))
    return new_links(valid_links(links(pages), domains), seen)


def detail_links(listing: DataFrame) -> DataFrame:
    """(url, type) of course and program pages that listing pages link to, each once."""
    found = links(listing).withColumn("type", X.page_kind(F.col("href"))).where("type is not null and url is not null")
    return found.groupBy("url").agg(F.min("type").alias("type"))


def crawl_depths(edges: DataFrame, seeds: DataFrame, max_depth: int = 6, max_pages: int | None = None, folder: str | None = None) -> DataFrame:
    """(url, depth): the fewest links from a seed to each url, up to ``max_depth``; at most ``max_pages`` if given, nearer ones first.

    Each round joins only the frontier with the edges and leaves out what was
    visited. Rounds are written to ``folder`` (the session's checkpoint folder if
    none is given), so a lost executor costs a round at most.
    """
    spark = edges.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        path = f"{folder.rstrip('/')}/crawl-{uuid.uuid4().hex}" if folder else shared_path(spark, "crawl")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    frontier = kept(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    visited = frontier
    for depth in range(1, max_depth + 1):
        found = frontier.join(edges, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct()
        frontier = kept(found.join(visited, "url", "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.head(1):
            break
        visited = visited.unionByName(frontier)
    return visited if max_pages is None else visited.orderBy("depth", "url").limit(max_pages)
