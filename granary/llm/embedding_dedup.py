"""Near-duplicate embeddings by randomised-rotation binary codes with correction factors.

A unit vector x is turned by random rotations; the code keeps the signs. Per half
A and B of the rotations the code is a unit vector q in the turned space, and the
stored factor f = <q, x> corrects it: turned back, q / f equals x plus noise that
is orthogonal to x and has mean zero over the rotations. The halves turn
independently, so <q_A(x) / f, q_B(y) / f> estimates <x, y> without bias, and its
error is below EPSILON times a known deviation but for one pair in some 30,000.

1. Equal vectors are one class, so copies cost no comparison.
2. Classes meet in buckets: bands of bits of their codes. The bits of a band grow
   with the logarithm of the rows, the number of bands is what the wanted recall at
   the threshold takes, and as many rotations are made as give those bits.
3. Within a bucket, the estimate and its bound decide which pairs could reach the
   threshold; these tie classes into candidate groups. In a large bucket pivots
   settle what is near them (``graph.linked``).
4. Each candidate group gets its vectors once, and the pairs whose bound reaches
   the threshold are computed anew in double precision. Only these link. Links are
   counted where they are found and never written pair by pair; what lies within
   half the angle of one vector is counted without being compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, table, written
from .graph import Relation, components, linked, settle

#: Rotations of a stored code, and deviations of its bound.
ROTATIONS, EPSILON = 8, 4.0
_FRAMES: dict = {}


def frames(dim: int, many: int = ROTATIONS, seed: int = 7) -> np.ndarray:
    """``many`` random rotations of ``dim`` dimensions, one below the other; more of them begin with the same ones."""
    if (dim, many, seed) not in _FRAMES:
        rng = np.random.default_rng([seed, dim])
        turned = [np.linalg.qr(rng.standard_normal((dim, dim))) for _ in range(many)]
        _FRAMES[dim, many, seed] = np.concatenate([q * np.sign(np.diag(r)) for q, r in turned])
    return _FRAMES[dim, many, seed]


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, ROTATIONS * dim / 8 bytes, padded) and factors (n, 2: one a half) of unit vectors."""
    dim = unit.shape[1]
    turned = unit @ frames(dim).T
    half = turned.shape[1] // 2
    factors = np.abs(turned).reshape(len(unit), 2, half).sum(2) / (math.sqrt(half) * math.sqrt(ROTATIONS / 2))
    return np.packbits(turned > 0, axis=1), factors


def decode(codes: np.ndarray, factors: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the vectors from either half of their codes."""
    signs = np.unpackbits(codes, axis=1, count=ROTATIONS * dim).astype(np.float32) * 2 - 1
    half = signs.shape[1] // 2
    frame = frames(dim).astype(np.float32) / np.float32(math.sqrt(half) * math.sqrt(ROTATIONS / 2))
    f = np.maximum(factors, 1e-6).astype(np.float32)
    return signs[:, :half] @ frame[:half] / f[:, :1], signs[:, half:] @ frame[half:] / f[:, 1:]


def may_reach(a: np.ndarray, b: np.ndarray, factors: np.ndarray, threshold: float, other: tuple | None = None) -> np.ndarray:
    """Pairs whose estimate plus bound reaches the threshold (of rows among themselves, or with ``other``'s)."""
    a2, b2, factors2 = other or (a, b, factors)
    dim = a.shape[1]
    noise = lambda f: (1 - np.minimum(f, 1) ** 2).mean(1) / np.maximum(f, 1e-6).mean(1) ** 2
    u, v = noise(factors).astype(np.float32), noise(factors2).astype(np.float32)
    estimate = (a @ b2.T + b @ a2.T) / 2
    return estimate + EPSILON * np.sqrt((u[:, None] + v[None, :] + u[:, None] * v[None, :]) / max(1, dim - 1) / 2) >= threshold


def bands_for(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits a band and bands: buckets of about eight strangers, ``recall`` for a pair at the threshold."""
    agree = 1 - math.acos(min(1.0, threshold)) / math.pi
    bits = max(1, min(30, round(math.log2(max(2, rows) / 8))))
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-(min(agree, 1 - 1e-9) ** bits))))


def buckets(unit: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """The bucket of each unit vector in each band."""
    dim = unit.shape[1]
    many = max(ROTATIONS, -(-bits * bands // dim))
    plain = (unit @ frames(dim, many)[: bits * bands].T > 0).reshape(len(unit), bands, bits)
    return plain @ (1 << np.arange(bits, dtype=np.int64)) + (np.arange(bands, dtype=np.int64) << 31) + (np.int64(dim) << 44)


class Estimated:
    """Codes of a group, near if the bound of the estimate reaches ``threshold``; with ``unit`` only if the vectors do."""

    def __init__(self, codes: np.ndarray, factors: np.ndarray, dim: int, threshold: float, unit: np.ndarray | None = None):
        self.factors, self.threshold, self.unit = factors, threshold, unit
        self.halves = decode(codes, factors, dim)

    def near(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        a, b = self.halves
        out = may_reach(a[left], b[left], self.factors[left], self.threshold, (a[right], b[right], self.factors[right]))
        if self.unit is not None:  # compute anew what the bound doesn't settle
            one, two = out.any(1), out.any(0)
            out[np.ix_(one, two)] &= self.unit[left[one]] @ self.unit[right[two]].T >= self.threshold
        return out

    def close(self, one: int, right: np.ndarray) -> np.ndarray:
        """Half the angle away: angles obey the triangle inequality."""
        return self.unit[right] @ self.unit[one] >= math.cos(math.acos(min(1.0, self.threshold)) / 2) + 1e-9


@dataclass(frozen=True)
class Codes(Relation):
    """Rows with ``code`` and ``factors``, and for ``exact`` the vector (``raw``)."""

    threshold: float
    exact: bool

    def read(self, frame: pd.DataFrame) -> tuple[pd.Series, ...]:
        return tuple(frame[c].to_numpy() for c in ("code", "factors", "raw" if self.exact else "code"))

    def space(self, items: tuple[np.ndarray, ...], s: int, e: int) -> Estimated:
        codes, factors, raw = (b"".join(x[s:e]) for x in items)
        dim = len(items[0][s]) * 8 // ROTATIONS
        unit = None
        if self.exact:
            unit = np.frombuffer(raw, "<f8").reshape(e - s, -1)
            unit = unit / np.abs(unit).max(1, keepdims=True)
            unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        return Estimated(np.frombuffer(codes, np.uint8).reshape(e - s, -1), np.frombuffer(factors, "<f4").reshape(e - s, 2), dim, self.threshold, unit)


def _matrix(values: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95, recall: float = 0.995) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row: links are other rows of cosine >= ``threshold``.

    ``recall`` is the wanted share of pairs at the threshold that meet in some
    bucket; pairs above it meet more surely. No pair below the threshold links.
    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing, nor do vectors of unlike length. Rows without a vec_id
    link with nothing and have a null component; rows that repeat a vec_id count
    one by one. An empty table gives an empty one. Other columns don't matter.
    """

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, raw = [], []
            for i, x in zip(b["i"], b["x"], strict=True):
                v = None if x is None or pd.isna(i) else np.asarray(x, np.float64) + 0.0  # None becomes nan, -0.0 becomes 0.0
                ok = v is not None and len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any())
                raw.append(v.tobytes() if ok else None)
                keys.append(hashlib.blake2b(raw[-1], digest_size=16).digest() if ok else None)
            yield pd.DataFrame({"vec_id": b["i"].astype("Int64"), "key": keys, "raw": raw})

    rows = written(vectors.select(column(vectors, vec_id).cast("long").alias("i"), column(vectors, embedding).alias("x")).mapInPandas(prepare, "vec_id long, key binary, raw binary"), "vectors")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("raw").alias("raw"))
    classes = written(classes, "classes", rows.count(), 2_000)
    # Vectors of another length are another space; lengths after the most common hundred take the last one's plan.
    lengths = classes.groupBy(F.octet_length("raw").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(100).collect()
    plans = {r.size: bands_for(r.n, threshold, recall) for r in lengths}
    rare = bands_for(lengths[-1].n if lengths else 2, threshold, recall)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for size, own in b.groupby(b["raw"].map(len)):
                x = _matrix(own["raw"], "<f8").astype(np.float64)
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                codes, factors = encode(x)
                yield pd.DataFrame({"key": own["key"].to_numpy(), "code": [c.tobytes() for c in codes], "factors": [f.astype("<f4").tobytes() for f in factors], "buckets": list(buckets(x, *plans.get(size, rare)))})

    coded = written(classes.select("key", "raw").mapInPandas(code, "key binary, code binary, factors binary, buckets array<long>"), "codes")
    met = coded.select("key", "code", "factors", F.explode("buckets").alias("bucket"))
    sizes = coded.select(F.explode("buckets").alias("bucket"), F.octet_length("code").alias("w")).groupBy("bucket").agg(F.count("*").alias("rows_"), F.sum("w").alias("bytes_"))
    ties = linked(met, ["bucket"], ["code", "factors"], Codes(threshold, False), sizes)
    groups = components(written(ties.select(F.col("key").alias("a"), F.col("top").alias("b")).distinct(), "ties")).withColumnRenamed("node", "key")  # of classes that may link
    members = written(groups.join(classes.select("key", "n", "raw"), "key").join(coded.select("key", "code", "factors"), "key"), "members")
    sizes = members.groupBy("root").agg(F.count("*").alias("rows_"), F.sum(F.octet_length("raw")).alias("bytes_"))
    found = written(linked(members, ["root"], ["raw", "code", "factors"], Codes(threshold, True), sizes, True), "links")
    final = settle(classes, found)
    out = rows.select("vec_id", "key").join(final, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: Every pair, for tables of a few thousand vectors; the operator finds a pair at the threshold with probability 0.995.
OP5_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (SELECT k, vec_id, x, sqrt(list_dot_product(x, x)) AS size FROM v WHERE vec_id IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
l AS (SELECT a.k AS a, b.k AS b FROM ok a JOIN ok b ON a.k <> b.k AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / (a.size * b.size) >= 0.95e0),
walk AS (SELECT k AS a, k AS b FROM ok UNION SELECT walk.a, l.b FROM walk JOIN l ON walk.b = l.a),
c AS (SELECT a AS k, min(vec_id) AS component_id FROM walk JOIN ok ON ok.k = b GROUP BY a),
n AS (SELECT a AS k, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(vec_id = coalesce(component_id, vec_id), false) AS kept FROM v LEFT JOIN c USING (k) LEFT JOIN n USING (k)
"""
