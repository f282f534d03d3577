"""The vector collection: embedding, upsert, exact search, statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from granary import schemas
from granary.functions import vectors as V
from granary.functions.text import tokens
from granary.sources.files import exists

Embedder = Callable[[list[str]], list[list[float]]]
_LOADED: dict[str, Embedder] = {}


def embed_with(df: DataFrame, load: Callable[[], Embedder], name: str, text: str = "text", batch: int = 64) -> DataFrame:
    """``df`` with ``embedding``, by a model that each worker loads once (under ``name``) and that gets ``batch`` texts a call."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if name not in _LOADED:
            _LOADED.clear()
            _LOADED[name] = load()
        model = _LOADED[name]
        for b in batches:
            texts = [x or "" for x in b]
            yield pd.Series([v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])], dtype=object)

    return df.withColumn("embedding", run(F.col(text))).withColumn("embedding", V.normalized(F.col("embedding")))


def _counts(text: Column, dimensions: int = V.DIMENSIONS) -> Column:
    """How often the terms of each hash occur: (b, n) of the dimensions that occur, in order.

    Sorted, equal dimensions are neighbours: a run's length is the distance between its ends.
    """
    m = F.sort_array(F.transform(tokens(text), lambda t: V.bucket(t, dimensions)))
    ends = lambda m: F.filter(F.transform(m, lambda x, i: F.struct(x.alias("b"), i.alias("i"))), lambda p: F.get(m, p.i + 1).isNull() | (F.get(m, p.i + 1) != p.b))
    runs = lambda e: F.transform(e, lambda p, k: F.struct(p.b.alias("b"), (p.i - F.coalesce(F.get(e, k - 1).getField("i"), F.lit(-1))).cast("double").alias("n")))
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  a name for a value within an expression
    return once(m, lambda m: once(ends(m), runs))


def hashed_embedding(text: Column, dimensions: int = V.DIMENSIONS) -> Column:
    """The default embedding, without a model: how often the terms of each hash occur, normalized. It knows no meanings."""
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))

    def dense(c: Column) -> Column:
        length = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.n * x.n))
        parts = lambda length: F.transform(c, lambda p, k: F.concat(zeros(p.b - F.coalesce(F.get(c, k - 1).getField("b"), F.lit(-1)) - 1), F.array(p.n / length)))
        return F.concat(F.flatten(once(length, parts)), zeros(dimensions - 1 - F.coalesce(F.get(c, F.size(c) - 1).getField("b"), F.lit(-1))))

    return once(_counts(text, dimensions), dense)


def hashed_similarity(docs: DataFrame, query: str, id: str = "id", text: str = "text") -> DataFrame:
    """(id, text, similarity) of every document to a query under the hashed embedding.

    A document's counts are kept for the dimensions that occur, and the product
    runs over the query's few; nothing shuffles.
    """
    base = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).withColumn("c", _counts(F.col("text")))
    base = base.crossJoin(F.broadcast(docs.sparkSession.range(1).select(_counts(F.lit(query)).alias("q"))))
    length = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x.n * x.n)) * F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.n * x.n))
    product = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.n * F.coalesce(F.get(F.filter("c", lambda y: y.b == x.b), F.lit(0)).getField("n"), F.lit(0.0)))
    return base.select("id", "text", F.when(length > 0, product / length).otherwise(0.0).alias("similarity"))


def embedded_query(spark: SparkSession, query: str) -> DataFrame:
    """One row: the hashed embedding of a question as ``query``."""
    return spark.range(1).select(hashed_embedding(F.lit(query)).alias("query"))


def search(vectors: DataFrame, query: Column | list[float] | DataFrame, k: int, where: Column | None = None, id: str = "id", embedding: str = "embedding", digits: int | None = None, unit: bool = False) -> DataFrame:
    """The k rows nearest to ``query`` by cosine distance, with ``distance``, ``similarity`` and ``rank`` from 1; the smaller id first among equals.

    Exact: every vector that ``where`` admits is compared, and each task keeps its
    k best. ``query`` is a vector, or a frame of one row with a column ``query``.
    ``unit``: all vectors have length one or zero, so the product over the query's
    nonzero components is enough. Rows without a vector are left out; zero vectors
    are at distance 1.
    """
    rows = (vectors if where is None else vectors.where(where)).where(F.col(embedding).isNotNull())
    if not isinstance(query, DataFrame):
        query = vectors.sparkSession.range(1).select((F.array(*[F.lit(float(x)) for x in query]) if isinstance(query, list) else query).alias("query"))
    one = F.filter(F.transform("query", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p.x != 0) if unit else F.col("query")
    rows = rows.crossJoin(F.broadcast(query.select(one.alias("query_"), V.norm(F.col("query")).alias("length_"))))
    product = F.aggregate("query_", F.lit(0.0), lambda s, p: s + p.x * F.get(F.col(embedding), p.i))
    distance = F.lit(1.0) - product if unit else V.cosine_distance(F.col(embedding), F.col("query_"), F.col("length_"))
    rows = rows.withColumn("distance", distance if digits is None else F.round(distance, digits)).drop("query_", "length_")
    best = rows.orderBy("distance", id).limit(k)
    similarity = 1 - F.col("distance")
    return best.withColumn("similarity", similarity if digits is None else F.round(similarity, digits)).withColumn("rank", F.row_number().over(Window.orderBy("distance", id)))


def latest(new: DataFrame, id: str = "id", seq: str | list[str] = "seq") -> DataFrame:
    """Of rows with one id the last by ``seq``, then by the other columns in turn, so any order of rows gives the same; nulls come first."""
    order = [seq] if isinstance(seq, str) else list(seq)
    rest = [c for c in new.columns if c != id and c not in order]
    last = F.max(F.struct(F.struct(*order).alias("o"), F.struct(*rest).alias("r"))).alias("x")
    return new.groupBy(id).agg(last).select(id, "x.r.*")


def upserted(existing: DataFrame, new: DataFrame, id: str = "id", seq: str | list[str] = "seq") -> DataFrame:
    """``existing`` with ``new`` put in: of new rows with one id the ``latest`` counts, and it replaces what was there."""
    put = latest(new, id, seq)
    return existing.join(put, id, "left_anti").unionByName(put.select(*existing.columns))


class Collection:
    """A named collection: what each upsert put in, as a table of its own (a delta), and a manifest that says which of them count, in which order.

    A row counts unless a later delta has its id, so an upsert writes its rows and
    nothing else, however large the collection is. Beyond DELTAS of them the newest become
    one, with the older ones that aren't over twice as large, so a row is rewritten a
    logarithm of times. The manifest's last row is written last: readers see a collection
    before or after an upsert, and one that is stopped leaves it as it was.
    ``vacuum`` removes deltas that the manifest no longer names.
    """

    DELTAS = 8

    def __init__(self, spark: SparkSession, path: str, name: str = "pages", schema: str = schemas.VECTOR):
        self.spark, self.path, self.schema = spark, f"{path.rstrip('/')}/{name}", schema

    def _manifest(self) -> tuple[int, list[tuple[int, int]]]:
        """The last number, and (delta, rows) of those that count, the oldest first."""
        if not exists(self.spark, f"{self.path}/manifest"):
            return 0, []
        last = self.spark.read.schema("number int, deltas array<struct<delta:int,n:bigint>>").json(f"{self.path}/manifest").orderBy(F.desc("number")).first()
        return (last.number, [(d.delta, d.n) for d in last.deltas or []]) if last else (0, [])

    def _name(self, number: int, deltas: list[tuple[int, int]]) -> None:
        self.spark.createDataFrame([(number, deltas)], "number int, deltas array<struct<delta:int,n:bigint>>").coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def _read(self, deltas: list[tuple[int, int]]) -> DataFrame:
        """The rows of these deltas that no later one of them replaces. Only ids of the later ones are looked at; few are broadcast."""
        out, later = self.spark.createDataFrame([], self.schema), None
        for delta, _ in reversed(deltas):
            rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/d{delta}")
            out = out.unionByName(rows if later is None else rows.join(later, "id", "left_anti"))
            later = rows.select("id") if later is None else later.unionByName(rows.select("id"))
        return out

    def _write(self, rows: DataFrame, delta: int) -> tuple[int, int]:
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.path}/d{delta}")
        return delta, seen.get["n"]

    def read(self) -> DataFrame:
        return self._read(self._manifest()[1])

    def upsert(self, new: DataFrame, seq: str | list[str] = "seq") -> int:
        """Puts ``new`` in and gives the number of rows after."""
        number, deltas = self._manifest()
        columns = [c.name for c in self.spark.createDataFrame([], self.schema).schema]
        put = self._write(self._latest(new, seq, f"{self.path}/repeated{number + 1}").select(*columns), number + 1)
        if put[1]:
            deltas = [*deltas, put]
            self._name(number + 1, deltas)
            if len(deltas) > self.DELTAS:
                self.compact()
        return self.read().count()

    def _latest(self, new: DataFrame, seq: str | list[str], path: str) -> DataFrame:
        """As ``latest``, but only rows whose id is repeated are shuffled and compared; texts and embeddings of others stay where they are."""
        new.groupBy("id").count().where("count > 1").select(F.col("id").alias("id_")).write.mode("overwrite").parquet(path)
        ids = self.spark.read.parquet(path)
        if ids.isEmpty():
            return new
        same = F.col("id").eqNullSafe(F.col("id_"))
        last = latest(new.join(ids, same, "left_semi"), seq=seq)
        return new.join(ids, same, "left_anti").select(*last.columns).unionByName(last)

    def compact(self) -> None:
        """Makes the newest deltas one, with all older ones that have at most twice the rows of those after them."""
        number, deltas = self._manifest()
        first = max(0, len(deltas) - max(2, self.DELTAS // 2 + 1))
        while first and deltas[first - 1][1] <= 2 * sum(n for _, n in deltas[first:]):
            first -= 1
        if len(deltas) - first > 1:
            self._name(number + 1, [*deltas[:first], self._write(self._read(deltas[first:]), number + 1)])

    def clear(self) -> None:
        self._name(self._manifest()[0] + 1, [])

    def vacuum(self) -> None:
        """Removes the files of deltas that the manifest no longer names; nothing may be reading them."""
        number, deltas = self._manifest()
        for d in set(range(1, number + 1)) - {d for d, _ in deltas}:
            folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/d{d}")
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def peek(self, n: int = 10) -> DataFrame:
        return self.read().orderBy("id").limit(n)

    def stats(self) -> DataFrame:
        return statistics(self.read())


def statistics(vectors: DataFrame, n: int = 10) -> DataFrame:
    """One row: ``total_chunks``, and the distinct urls among the first ``n`` rows, sorted."""
    sample = vectors.orderBy("id").limit(n).agg(F.array_sort(F.collect_set("metadata.url")).alias("sample_urls"))
    return vectors.agg(F.count("*").alias("total_chunks")).crossJoin(sample)
