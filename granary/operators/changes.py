"""What has changed between a snapshot of pages and what is known of them: a join of fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Schema of what is known of a page: its url and fingerprint.
KNOWN = "url string, fingerprint string"


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns; null, empty and shifted values differ."""
    parts = [x for c in columns for x in (F.coalesce(F.octet_length(c).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    return F.sha2(F.concat(*parts), 256)


def latest_version(pages: DataFrame, order: tuple[str, ...], content: tuple[str, ...] = ("html",)) -> DataFrame:
    """(url, fingerprint, ``order``, versions) of each url's last row by ``order``, then by fingerprint; ``versions`` counts its rows. Null urls are left out.

    Rows are reduced to a fingerprint before they move.
    """
    rows = pages.where("url is not null").select("url", fingerprint(*content).alias("fingerprint"), *order)
    last = F.max(F.struct(*order, "fingerprint")).alias("x")
    return rows.groupBy("url").agg(last, F.count("*").alias("versions")).select("url", "x.fingerprint", *[F.col(f"x.{c}").alias(c) for c in order], "versions")


def changes(now: DataFrame, known: DataFrame) -> DataFrame:
    """``now`` (url, fingerprint, ...), each url once, with ``status``: new, changed or same; and the urls of ``known`` that it lacks, gone.

    Both sides are narrow, and they are all that is shuffled.
    """
    old = known.select("url", F.col("fingerprint").alias("was"))
    status = F.when(F.col("fingerprint").isNull(), "gone").when(F.col("was").isNull(), "new").when(F.col("was") == F.col("fingerprint"), "same").otherwise("changed")
    return now.join(old, "url", "full").withColumn("status", status).drop("was")


def current(log: DataFrame, run: str = "run") -> DataFrame:
    """(url, fingerprint, run) of the pages that are there by the last run that says anything about them; ``log`` has ``status``."""
    last = F.max_by(F.struct("fingerprint", "status"), run).alias("x")
    rows = log.groupBy("url").agg(last, F.max(run).alias(run))
    return rows.where("x.status <> 'gone'").select("url", "x.fingerprint", run)


def content_of(pages: DataFrame, wanted: DataFrame, order: tuple[str, ...], content: tuple[str, ...] = ("html",)) -> DataFrame:
    """The rows of ``pages`` that ``wanted`` (a written table of ``latest_version``'s columns) names, one for each url.

    Joined by url and place; where few are wanted Spark broadcasts them, by their
    measured size, and pages stay where they are. Only urls with several rows
    are compared by fingerprint, and only then shuffled.
    """
    keys = wanted.select("url", "versions", F.col("fingerprint").alias("wanted_"), *[F.col(c).alias(f"{c}_") for c in order])
    rows = pages.join(keys, "url")
    for c in order:
        rows = rows.where(F.col(c).eqNullSafe(F.col(f"{c}_")))
    extra = ["versions", "wanted_", *[f"{c}_" for c in order]]
    single = rows.where("versions = 1").drop(*extra)
    if wanted.where("versions > 1").isEmpty():
        return single
    many = rows.where("versions > 1").withColumn("own_", fingerprint(*content)).where("own_ = wanted_").dropDuplicates(["url"])
    return single.unionByName(many.drop("own_", *extra))
