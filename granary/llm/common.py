"""What the operators share: the shared folder, tables that cut lineage, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.runtime import shared_dir, shared_path, ship, table  # noqa: F401  (re-exported)

#: A word, as the quality and near-duplicate operators see it: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, label: str, rows: int | None = None, per_file: int = 50_000) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lineage cut there.

    The files survive the loss of any executor. They stay until the folder is
    cleaned, because results that are still lazy read them. ``rows``, an upper
    bound of the table's rows, spares small tables many small files: the last
    step then runs in a task for ``per_file`` rows.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    (df if rows is None else df.coalesce(max(1, -(-rows // per_file)))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table from ``written`` that no later plan reads."""
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that ``df`` doesn't have (case aside)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column(df: DataFrame, name: str) -> Column:
    """The column of exactly that name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")
