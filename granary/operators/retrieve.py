"""Fusion of ranked lists, and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors
from .text_index import TextIndex

VECTOR_WEIGHT, LEXICAL_WEIGHT, K = 0.6, 0.4, 60


def candidates(n: int) -> int:
    """How many of each list are fused for n results."""
    return min(4 * n, 20)


def fuse(by_vector: DataFrame, by_words: DataFrame, n: int | None = None, vector_weight: float = VECTOR_WEIGHT, lexical_weight: float = LEXICAL_WEIGHT, k: int = K, digits: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of two lists with ``text``, ``metadata`` and ``rank`` (from 1).

    Results are one if their texts begin with the same 100 characters: all their
    contributions add up, text and metadata are the first one's (the vector list
    comes first), ``vector_rank`` is the best and ``bm25_rank`` the worst. Equal
    scores: what came first.
    """
    w = lambda df, weight, place: df.select(F.substring("text", 1, 100).alias("key"), "text", "metadata", "rank", F.lit(place).alias("place"), (F.lit(weight) / (k + F.col("rank"))).alias("part"))
    both = w(by_vector, vector_weight, 0).unionByName(w(by_words, lexical_weight, 1))
    order = F.struct("place", "rank")
    fused = both.groupBy("key").agg(
        F.min_by(F.struct("text", "metadata"), order).alias("first"), F.sum("part").alias("score"), F.min(order).alias("seq"),
        F.min(F.when(F.col("place") == 0, F.col("rank"))).cast("int").alias("vector_rank"), F.max(F.when(F.col("place") == 1, F.col("rank"))).cast("int").alias("bm25_rank"),
    )
    if digits is not None:
        fused = fused.withColumn("score", F.round("score", digits))
    out = fused.orderBy(F.desc("score"), "seq")
    out = out if n is None else out.limit(n)
    out = out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "seq")))
    return out.select("first.text", "first.metadata", "score", "vector_rank", "bm25_rank", "rank")


def hybrid_search(index: TextIndex | None, collection: DataFrame, query: str, n: int = 5, vector: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """The n best results for a question: the ``index``'s by words and the ``collection``'s by embedding, fused.

    Both are read as they were stored; only the question is tokenized and embedded.
    ``vector`` is its embedding (one row, ``query``); without one it is the hashed
    one, whose collection has unit vectors. Without an index, by embedding alone.
    The index keeps rows with equal ids apart, each with its own text and metadata.
    """
    k = candidates(n)
    near = vectors.search(collection, vectors.embedded_query(collection.sparkSession, query) if vector is None else vector, k, digits=digits, unit=vector is None)
    words = index.search(query, k, digits) if index is not None else near.where("false")
    return fuse(near, words, n, digits=digits)


def vector_only_search(collection: DataFrame, query: str | list[float] | DataFrame, n: int = 5, digits: int | None = None) -> DataFrame:
    """The n results nearest to a question, or to its embedding."""
    plain = isinstance(query, str)
    return vectors.search(collection, vectors.embedded_query(collection.sparkSession, query) if plain else query, n, digits=digits, unit=plain)
