"""A snapshot of fetched pages, parsed and chunked only where it differs from the runs before.

    spark-submit jobs/refresh_pages.py --pages IN --out OUT [--config FILE]

IN is Parquet of (url, html, ...), the whole site as it now is. OUT has three tables:

    pages   run=N   url, fingerprint, status: the new, changed and gone pages of a run
    chunks  run=N, type=T   the chunks of its new and changed pages
    marks   one row a run that is done, with what it counted: the high-water mark

A run compares fingerprints of the pages with those of the runs up to the mark. Pages
that are the same are neither parsed nor written. A run that is stopped has no
mark: the next one has its number and overwrites its partitions. A run without
changes writes nothing, so running it again gives the same tables. The site as it is
(``read_current``) is each page's chunks of the last run that says anything about it.

Pages that a snapshot lacks stay, as a crawl may miss pages; with ``keep_gone`` false
they are marked gone and their chunks no longer count. Of rows with one url the last by
``order`` counts. Null urls are left out; null html has no content. One run at a time.
"""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from granary import schemas
from granary.config import Settings, Site
from granary.functions import text as X
from granary.operators import changes as D
from granary.operators import chunks as C
from granary.operators import pages as P
from granary.runtime import shared_path, ship
from jobs.common import config, log, session, start

LOG = f"{D.KNOWN}, status string, run int"
CHUNK = "id string, text string, url string, title string, section_heading string, breadcrumbs string, chunk_index int, content_type string, type string, run int"
MARK = "run int, read bigint, new bigint, changed bigint, gone bigint, same bigint, chunks bigint"


@dataclass(frozen=True)
class Config:
    chunk_size: int = 500
    chunk_overlap: int = 80
    min_chunk: int = 50
    order: tuple[str, ...] = ("page_id",)
    brand: str = "Example"
    keep_gone: bool = True
    skip: tuple[str, ...] = ()


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _begin(spark: SparkSession, out: str) -> None:
    """Empty tables where there are none yet."""
    for name, schema, by in (("pages", LOG, ["run"]), ("chunks", CHUNK, ["run", "type"]), ("marks", MARK, [])):
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*by).parquet(f"{out}/{name}")


def marks(spark: SparkSession, out: str) -> DataFrame:
    return _table(spark, f"{out}/marks", MARK)


def _done(spark: SparkSession, out: str) -> int:
    return marks(spark, out).agg(F.coalesce(F.max("run"), F.lit(0))).first()[0]


def read_pages(spark: SparkSession, out: str) -> DataFrame:
    """(url, fingerprint, run) of the pages that the site has; run is the last in which each changed."""
    return D.current(_table(spark, f"{out}/pages", LOG).where(F.col("run") <= _done(spark, out)))


def read_current(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of the site as it is."""
    found = _table(spark, f"{out}/chunks", CHUNK).where(F.col("run") <= _done(spark, out))
    return found.join(read_pages(spark, out).select("url", "run"), ["url", "run"], "left_semi")


def chunked(rows: DataFrame, c: Config) -> DataFrame:
    """Chunks of pages: catalogue pages by their named parts, others by their sections."""
    site = Site(brand=c.brand)
    kind = X.page_kind(F.col("url"))
    typed = P.typed_pages(rows.where(kind.isNotNull()), site)
    general = P.general_pages(rows.where(kind.isNull()), site)
    both = [df.select(*[(F.col(x) if x in df.columns else F.lit(None)).cast(t).alias(x) for x, t in _fields(schemas.PAGE)]) for df in (general, typed)]
    limits = Settings(chunk_size=c.chunk_size, chunk_overlap=c.chunk_overlap, min_chunk=c.min_chunk)
    made = C.chunk_general_pages(both[0], limits).withColumn("type", F.lit("general"))
    made = made.unionByName(C.chunk_typed_pages(both[1], limits).withColumn("type", F.col("metadata.content_type")))
    return made.select("id", "text", "metadata.*", "type")


def _fields(schema: str) -> list[tuple[str, str]]:
    from pyspark.sql.types import StructType

    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(schema)]


def run(spark: SparkSession, pages: str, out: str, c: Config = Config()) -> dict[str, int]:
    """One refresh; gives its counts, those of its mark. ``pages`` is a path."""
    ship(spark)
    _begin(spark, out)
    rows = spark.read.parquet(pages)
    if c.skip:
        rows = rows.where(~F.coalesce(F.lower("url").rlike("|".join(c.skip)), F.lit(False)))
    number = _done(spark, out) + 1
    found = D.changes(D.latest_version(rows, c.order), read_pages(spark, out))
    if c.keep_gone:
        found = found.where("status <> 'gone'")
    seen, made_ = Observation("pages"), Observation("chunks")
    found = found.observe(seen, *[F.count_if(F.col("status") == x).alias(x) for x in ("new", "changed", "gone", "same")])
    path = shared_path(spark, "changes")
    found.where("status <> 'same'").write.parquet(path)
    changed = spark.read.schema(found.schema).parquet(path)
    counts = {"run": number, "read": 0, **seen.get, "chunks": 0}
    counts["read"] = counts["new"] + counts["changed"] + counts["same"]
    log.info("run %s: %s pages read from %s: %s new, %s changed, %s gone, %s as before", number, counts["read"], pages, counts["new"], counts["changed"], counts["gone"], counts["same"])
    if not counts["new"] + counts["changed"] + counts["gone"]:
        log.info("run %s: nothing to write", number)
        return counts
    # each run's partition is written as a whole, so what a stopped run left in it goes
    changed.select("url", "fingerprint", "status").write.mode("overwrite").parquet(f"{out}/pages/run={number}")
    made = chunked(D.content_of(rows, changed.where("status <> 'gone'"), c.order), c).observe(made_, F.count(F.lit(1)).alias("chunks"))
    made.write.mode("overwrite").partitionBy("type").parquet(f"{out}/chunks/run={number}")
    counts["chunks"] = made_.get["chunks"]
    spark.createDataFrame([tuple(counts[x] for x, _ in _fields(MARK))], MARK).coalesce(1).write.mode("append").parquet(f"{out}/marks")
    log.info("run %s: %s chunks written to %s/chunks/run=%s", number, counts["chunks"], out, number)
    return counts


def main(argv: list[str] | None = None) -> None:
    a = start(__doc__, {"pages": "Parquet of the fetched pages", "out": "folder of the three tables"}, argv)
    found = config(a.config, "refresh_pages.json", tuple(Config.__dataclass_fields__))
    settings = Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})
    spark = session("refresh-pages")
    try:
        run(spark, a.pages, a.out, settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
