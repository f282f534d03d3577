"""From fetched HTML to page records, general and typed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.config import Site
from granary.functions import html as H
from granary.functions import text as X
from granary.operators.vectors import latest


def html_only(fetched: DataFrame, content_type: str = "content_type") -> DataFrame:
    return fetched.where(F.col(content_type).contains("text/html"))


def succeeded(fetched: DataFrame, status: str = "status") -> DataFrame:
    return fetched.where(F.col(status) == 200)


def fresh_responses(fetched: DataFrame, hours: int = 24, fetched_at: str = "fetched_at") -> DataFrame:
    """Responses that a cache of that many hours would still give."""
    return fetched.where(F.col(fetched_at) > F.current_timestamp() - F.expr(f"INTERVAL {int(hours)} HOURS"))


def usable(fetched: DataFrame, hours: int | None = None) -> DataFrame:
    """What a crawl would have kept, by the columns that ``fetched`` has.

    Responses of HTML (``content_type``) that succeeded (``status``), of one url the
    last (``fetched_at``), and with ``hours`` no older ones. Null statuses and types
    are left out.
    """
    if "content_type" in fetched.columns:
        fetched = html_only(fetched)
    if "status" in fetched.columns:
        fetched = succeeded(fetched)
    if "fetched_at" in fetched.columns:
        fetched = latest(fetched if hours is None else fresh_responses(fetched, hours), "url", "fetched_at")
    return fetched


def general_pages(fetched: DataFrame, site: Site, mode: str = "all") -> DataFrame:
    """Page records of ``fetched`` (url, html): urls to be skipped and pages without content are left out.

    Urls are filtered before any page is parsed.
    """
    read = fetched.where(~F.coalesce(X.skipped_url(F.col("url")), F.lit(False))).withColumn("p", H.page_fields(F.col("html"), site.brand, mode))
    kept = read.where(X.strip(F.col("p.content")) != "")
    return kept.select("url", "p.title", "p.h1", "p.meta_description", "p.breadcrumbs", "p.content", "p.sections", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("last_crawled"))


def typed_pages(fetched: DataFrame, site: Site) -> DataFrame:
    """Course and program records of ``fetched`` (url, html), told apart by their urls; other urls are left out."""
    url = F.col("url")
    read = fetched.withColumn("type", X.page_kind(url)).where(F.col("type").isNotNull())
    read = read.withColumn("p", H.typed_fields(F.col("html"), F.col("type")))
    course = F.col("type") == "course"
    code = F.when(course, X.code_of(url, "course")).otherwise(X.code_of(url, "program"))
    read = read.withColumns({"code": code, "level": X.level_of(url), "uoc": F.when(course, X.credits(F.col("html"))), "content": F.array_join("p.parts", "\n\n")})
    named = F.when(F.col("code") == "", F.col("p.title")).otherwise(F.concat(F.when(course, "").otherwise("Program "), F.col("code"), F.lit(" — "), F.col("p.title")))
    about = F.when(course, F.format_string(f"%s %s - %s UOC - {site.brand} %s", "code", "p.title", "uoc", F.initcap("level")))
    about = about.otherwise(F.format_string(f"Program %s %s - {site.brand} %s", "code", "p.title", F.initcap("level")))
    return read.where(X.strip(F.col("content")) != "").select(
        "url", "type", F.when(course, F.col("code")).alias("course_code"), F.when(~course, F.col("code")).alias("program_code"), named.alias("title"), "level", "uoc", "p.faculty",
        F.when(course, F.col("p.school")).alias("school"), F.when(course, F.col("p.offering_terms")).alias("offering_terms"), F.when(~course, F.col("p.duration")).alias("duration"), "content",
        F.transform("p.parts", lambda x: F.struct(X.before_colon(x).alias("heading"), x.alias("content"))).alias("sections"),
        F.array(F.lit(site.catalogue_name), F.initcap("level"), F.when(course, "Courses").otherwise("Programs"), F.col("code")).alias("breadcrumbs"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("last_crawled"), about.alias("meta_description"),
    )


def crawl_counters(pages: DataFrame) -> DataFrame:
    """Pages by type; pages without one are general."""
    return pages.groupBy(F.coalesce("type", F.lit("general")).alias("type")).agg(F.count("*").alias("n_pages"))


def carried_headings(nodes: DataFrame, page: str = "page_id", pos: str = "pos") -> DataFrame:
    """``nodes`` (a text node's heading is null) with the last heading before each: ``section_heading``, empty before the first."""
    from pyspark.sql import Window

    w = Window.partitionBy(page).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return nodes.withColumn("section_heading", F.coalesce(F.last("heading", ignorenulls=True).over(w), F.lit("")))
