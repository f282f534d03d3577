"""An inverted-file index of vectors: k-means lists as partitions of a Parquet table.

Vectors are dealt to the nearest of some centroids and stored partitioned by that list,
so a search reads the partitions that it probes and no others. Of each list its
radius is kept, the largest distance of a member from the centroid. By the triangle
inequality that bounds how near a list's members can be to a query: an exact search
probes a few lists, and then reads only those that may hold something nearer.

Distances are cosine distances; of unit vectors these are half the squared Euclidean ones.
Null and zero vectors, and such with other than finite components, are list -1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from granary.functions import vectors as V
from granary.operators import vectors

#: Lists at most; their centroids are held on the driver and sent to each worker.
MAX_LISTS = 16_384
#: Vectors a list that centroids are fitted on (a sample by a hash of the id); every vector is indexed.
SAMPLE = 256
#: Vectors a list among which the driver chooses the first centroids, and rounds of k-means at most.
FIRST, ROUNDS = 4, 20
#: Vectors and queries that one task compares at once in ``search_many``, and pairs at a time.
BLOCK, QUERIES, TILE = 16_384, 8_192, 1 << 22
LISTS = 16_384
#: Vectors a list that centroids are fitted on (a sample by a hash of the id); every vector is indexed.
SAMPLE = 256
#: Vectors and queries that one task compares at once in ``search_many``.
BLOCK, QUERIES = 8_192, 8_192
LISTS = "list int, centroid array<double>"
NOWHERE = -1


def default_lists(n: int) -> int:
    """About the square root, so that a probe reads as much as the choice of lists costs."""
    return max(1, min(MAX_LISTS, math.isqrt(n)))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def _units(column: pd.Series) -> np.ndarray:
    x = _matrix(column)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, less what is the same for all centroids of a row."""
    return np.einsum("ij,ij->i", c, c)[None, :] - 2 * x @ c.T


def usable(embedding: Column) -> Column:
    """Whether a vector has a direction: no nulls, all components finite, and not all of them zero."""
    n = V.norm(embedding)
    return F.coalesce((n > 0) & (n < F.lit(float("inf"))) & ~F.isnan(n), F.lit(False))


def spread(x: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """At most ``lists`` rows of ``x``, each chosen by its squared distance from those before (k-means++); no two are equal."""
    draw, chosen = np.random.default_rng(seed), [0]
    away = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < lists and away.max() > 1e-12:
        chosen.append(int(draw.choice(len(x), p=away / away.sum())))
        away = np.minimum(away, ((x - x[chosen[-1]]) ** 2).sum(1))
        away[chosen[-1]] = 0
    return x[chosen]


def fit(rows: DataFrame, lists: int, n: int, seed: int = 42, id: str = "id", embedding: str = "embedding") -> np.ndarray:
    """Centroids (at most ``lists``) of the unit vectors of ``rows``, by k-means over a sample of about SAMPLE for each list.

    The driver gets FIRST vectors a list, and a sum a list in each round: Spark's own
    k-means sends it the distances of all pairs of centroids in each.
    """
    if not n:
        return np.zeros((0, 1))
    spark, place = rows.sparkSession, F.pmod(F.xxhash64(id), F.lit(1 << 30))
    within = lambda each: rows.where(place <= int(min(1.0, lists * each / n) * (1 << 30)))
    first = within(FIRST).orderBy(F.xxhash64(F.lit(seed), id), id).select(embedding).limit(2 * FIRST * lists).collect()
    first = first or rows.select(embedding).limit(1).collect()
    centers = spread(_units(pd.Series([r[0] for r in first])), lists, seed)
    units = within(SAMPLE).select(F.col(embedding).alias("x")).persist()

    def one_round(c: np.ndarray) -> list:
        sent = spark.sparkContext.broadcast(c)

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = sent.value
            total, count = np.zeros(c.shape), np.zeros(len(c), np.int64)
            for b in batches:
                if len(b):
                    x = _units(b["x"])
                    near = _squares(x, c).argmin(1)
                    np.add.at(total, near, x)
                    count += np.bincount(near, minlength=len(c))
            at = np.flatnonzero(count)
            yield pd.DataFrame({"list": at.astype(np.int32), "n": count[at], "total": pd.Series(list(total[at]), dtype=object)})

        def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found: dict[int, tuple[int, np.ndarray]] = {}
            for b in batches:
                for i, n, t in zip(b["list"], b["n"], b["total"], strict=True):
                    m, u = found.get(i, (0, 0.0))
                    found[i] = m + n, u + np.asarray(t)
            yield pd.DataFrame({"list": list(found), "n": [m for m, _ in found.values()], "total": pd.Series([u for _, u in found.values()], dtype=object)})

        kind = "list int, n long, total array<double>"
        return units.mapInPandas(sums, kind).repartition("list").mapInPandas(added, kind).collect()

    try:
        for _ in range(ROUNDS):
            new = centers.copy()
            for r in one_round(centers):
                new[r.list] = np.array(r.total) / r.n
            moved, centers = ((new - centers) ** 2).sum(1).max(), new
            if moved <= 1e-8:
                break
        return centers
    finally:
        units.unpersist()


class VectorIndex:
    """An index at ``path``: ``vectors`` (by list) and their ``columns``, ``centroids``, and ``sizes`` (n and radius of each list)."""

    def __init__(self, spark: SparkSession, path: str, id: str = "id", embedding: str = "embedding"):
        self.spark, self.path, self.id, self.embedding, self._read = spark, path.rstrip("/"), id, embedding, None
        found = sorted(spark.read.schema(LISTS).parquet(f"{self.path}/centroids").collect())
        self.centroids = np.array([r.centroid for r in found]) if found else np.zeros((0, 1))

    @classmethod
    def build(cls, rows: DataFrame, path: str, lists: int | None = None, id: str = "id", embedding: str = "embedding", seed: int = 42) -> VectorIndex:
        """Fits centroids and writes all of ``rows``. Ids are of one type and not null."""
        spark, good = rows.sparkSession, rows.where(usable(F.col(embedding)))
        n = good.count()
        centers = fit(good, lists or default_lists(n), n, seed, id, embedding)
        made = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], LISTS)
        made.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/centroids")
        rows.limit(0).write.mode("overwrite").parquet(f"{path.rstrip('/')}/columns")
        out = cls(spark, path, id, embedding)
        out._put(rows, "overwrite")
        return out

    def add(self, rows: DataFrame) -> None:
        """Further vectors, of other ids than those that are there, dealt to the centroids as they are."""
        self._put(rows, "append")

    def _put(self, rows: DataFrame, mode: str) -> None:
        centers = self.spark.sparkContext.broadcast(self.centroids)

        @F.pandas_udf("list int, distance double")
        def nearest(found: pd.Series) -> pd.DataFrame:
            c = centers.value
            if not len(found):
                return pd.DataFrame({"list": np.zeros(0, np.int32), "distance": np.zeros(0)})
            x = _units(found)
            best = _squares(x, c).argmin(1)
            return pd.DataFrame({"list": best.astype(np.int32), "distance": np.linalg.norm(x - c[best], axis=1)})

        good = usable(F.col(self.embedding))
        some = rows.where(good).withColumn("near_", nearest(F.col(self.embedding)))
        some = some.withColumns({"list": F.col("near_.list"), "distance_": F.col("near_.distance")}).drop("near_")
        none = rows.where(~good).withColumns({"list": F.lit(NOWHERE), "distance_": F.lit(0.0)})
        # ranges of (list, hash of the id): a list that holds much is written by several tasks, small ones share a task
        dealt = some.unionByName(none).withColumn("hash_", F.xxhash64(self.id)).repartitionByRange("list", "hash_").drop("hash_")
        self._read = None
        dealt.write.mode(mode).partitionBy("list").parquet(f"{self.path}/vectors")
        stored = self._stored()
        stored.groupBy("list").agg(F.count("*").alias("n"), F.max("distance_").alias("radius")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/sizes")

    def _stored(self) -> DataFrame:
        if self._read is None:  # the folders are listed once for each state of the index
            columns = self.spark.read.parquet(f"{self.path}/columns").schema
            self._read = self.spark.read.schema(columns.add("distance_", DoubleType()).add("list", IntegerType())).parquet(f"{self.path}/vectors")
        return self._read

    def rows(self) -> DataFrame:
        """All that is stored, as it was given, with its ``list``."""
        return self._stored().drop("distance_")

    def sizes(self) -> dict[int, tuple[int, float]]:
        """n and radius of each list; MAX_LISTS rows at most."""
        return {r.list: (r.n, r.radius) for r in self.spark.read.schema("list int, n bigint, radius double").parquet(f"{self.path}/sizes").collect()}

    def of(self, lists: list[int], where: Column | None = None) -> DataFrame:
        """What these lists hold: partitions of the table, so other files aren't read."""
        found = self.rows().where(F.col("list").isin(*lists) if lists else F.lit(False))
        return found if where is None else found.where(where)

    def _distances(self, query: list[float]) -> np.ndarray:
        q = np.array(query, np.float64)
        return np.linalg.norm(self.centroids - q / np.linalg.norm(q), axis=1)

    def search(self, query: list[float], k: int, probes: int | None = None, where: Column | None = None, digits: int | None = None) -> DataFrame:
        """The k nearest to ``query`` with ``distance``, ``similarity`` and ``rank``, as ``vectors.search`` gives them.

        Without ``probes`` the answer is exact. With it, the nearest ``probes`` lists are
        read and nothing else: members of other lists are missed, if they would be among the k.
        """
        ask = lambda lists: vectors.search(self.of(lists, where).drop("list"), query, k, id=self.id, embedding=self.embedding, digits=digits)
        if not any(query) or not len(self.centroids):  # no direction, or nothing to compare: every distance is 1
            return ask([*range(len(self.centroids)), NOWHERE])
        near = self._distances(query)
        if probes is not None:
            return ask(np.argsort(near, kind="stable")[:probes].tolist())
        return ask(self._needed(near, query, k, where))

    def _needed(self, near: np.ndarray, query: list[float], k: int, where: Column | None) -> list[int]:
        """The lists that may hold one of the k nearest: first a few are read for a distance that k vectors keep, then bounds decide."""
        first = np.argsort(near, kind="stable")[: max(1, len(near) // 16)].tolist()
        found = vectors.search(self.of(first, where), query, k, id=self.id, embedding=self.embedding).select("distance").collect()
        if len(found) < k:
            return [*range(len(near)), NOWHERE]
        reach = max(r.distance for r in found) + 1e-6  # rounding, of bounds and of digits
        size = self.sizes()
        bound = np.array([max(0.0, near[i] - size.get(i, (0, 0.0))[1] - 1e-9) ** 2 / 2 for i in range(len(near))])
        return [*np.flatnonzero(bound <= reach).tolist(), *([NOWHERE] if reach >= 1 else [])]

    def search_many(self, queries: DataFrame, k: int, probes: int | None = None, digits: int | None = None, query_id: str = "query_id", vector: str = "vector") -> DataFrame:
        """(query_id, id, distance, rank, list): the k nearest for each row of ``queries``, in one job.

        Without ``probes`` all queries meet all vectors, whatever their list; with it,
        queries go to the lists that they probe. They meet in blocks of at most about BLOCK
        members and QUERIES queries, as products of matrices that keep k rows a query. So no
        table has a row for each pair, and a list that holds a third of all vectors, or is
        asked for by all queries, is many tasks.
        Queries without a direction have no rows; vectors without one are left out.
        """
        centers, spark, kinds = self.spark.sparkContext.broadcast(self.centroids), self.spark, dict(self.rows().dtypes)
        good = queries.where(usable(F.col(vector))).select(F.col(query_id).alias("q"), F.col(vector).alias("qv"))

        @F.pandas_udf("array<int>")
        def probed(found: pd.Series) -> pd.Series:
            c = centers.value
            if not len(found) or not len(c):
                return pd.Series([[]] * len(found), dtype=object)
            return pd.Series(list(np.argsort(_squares(_units(found), c), axis=1, kind="stable")[:, :probes].astype(np.int32)), dtype=object)

        # a cell: a list, or all of them
        size = {i: n for i, (n, _) in self.sizes().items() if i >= 0}
        cells = size if probes else {0: sum(size.values())}
        blocks = spark.createDataFrame([(i, max(1, -(-n // BLOCK))) for i, n in cells.items()] or [(0, 1)], "cell int, blocks int")
        parts = max(1, -(-good.count() // QUERIES))
        asks = good.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int")).withColumn("cell", F.explode(probed("qv")) if probes else F.lit(0)).join(F.broadcast(blocks), "cell")
        asks = asks.withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        held = self.rows().where(F.col("list") >= 0).select(F.col(self.id).alias("v"), F.col(self.embedding).alias("vv"), "list", (F.col("list") if probes else F.lit(0)).alias("cell")).join(F.broadcast(blocks), "cell")
        held = held.withColumn("vb", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).drop("blocks")

        def compare(own: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
            out = [own.iloc[:0].assign(v=[], distance=[], list=[])]
            if len(own) and len(members):
                members = members.sort_values("v", ignore_index=True)  # of equal distances the smaller id
                asked, x, keep = _units(own["qv"]), _units(members["vv"]), min(k, len(members))
                step = max(1, TILE // len(members))
                for a in range(0, len(own), step):
                    distance = 1 - asked[a : a + step] @ x.T
                    if digits is not None:
                        distance = np.round(distance, digits)
                    last = np.partition(distance, keep - 1, axis=1)[:, keep - 1]
                    row, at = np.nonzero(distance <= last[:, None])
                    order = np.lexsort((at, distance[row, at], row))
                    row, at = row[order], at[order]
                    best = np.arange(len(row)) - np.searchsorted(row, row) < keep
                    row, at = row[best], at[best]
                    out.append(pd.DataFrame({"q": own["q"].to_numpy()[a + row], "v": members["v"].to_numpy()[at], "distance": distance[row, at], "list": members["list"].to_numpy()[at]}))
            return pd.concat(out[1:] or out)[["q", "v", "distance", "list"]]

        keys = ["cell", "vb", "qb"]
        near = asks.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(compare, f"q {dict(good.dtypes)['q']}, v {kinds[self.id]}, distance double, list int")
        rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "v"))
        best = near.withColumn("rank", rank).where(F.col("rank") <= k)
        return best.select(F.col("q").alias("query_id"), F.col("v").alias("id"), "distance", "rank", "list")

    def recall(self, queries: DataFrame, k: int, query_id: str = "query_id", vector: str = "vector") -> list[float]:
        """recall[p - 1]: the share of the true k nearest of ``queries`` that a search with p probes finds, for every p.

        One exact search gives all of it: a neighbour is found by p probes if its list is
        among the p lists nearest to the query. A row a number of lists comes to the driver.
        """
        centers = self.spark.sparkContext.broadcast(self.centroids)

        @F.pandas_udf("int")
        def place(found: pd.Series, lists: pd.Series) -> pd.Series:
            if not len(found):
                return pd.Series([], dtype="int32")
            c = centers.value
            squares = _squares(_units(found), c)
            own = np.take_along_axis(squares, lists.to_numpy()[:, None], 1)
            earlier = (squares < own) | ((squares == own) & (np.arange(len(c)) < lists.to_numpy()[:, None]))
            return pd.Series(earlier.sum(1).astype(np.int32))

        asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("qv"))
        true = self.search_many(queries, k, None, None, query_id, vector).join(asked, "query_id")
        counts = np.zeros(max(1, len(self.centroids)))
        for r in true.groupBy(place("qv", "list").alias("p")).agg(F.count("*").alias("n")).collect():
            counts[r.p] = r.n
        return (np.cumsum(counts) / max(1, counts.sum())).tolist()

    def probes_for(self, queries: DataFrame, k: int, wanted: float = 0.95, query_id: str = "query_id", vector: str = "vector") -> int:
        """The fewest probes with at least that recall over ``queries``, a sample of those to come; all lists if there are none."""
        curve = np.array(self.recall(queries, k, query_id, vector))
        return int(np.flatnonzero(curve >= wanted)[0]) + 1 if curve[-1] > 0 else max(1, len(self.centroids))
