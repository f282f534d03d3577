"""N-gram Jaccard join: chosen paths over min-wise embedded shingle sets.

The n-gram set of a text is embedded as SIZE tokens (i, v_i): v_i is the smallest
of its shingles under the i-th hash, so two sets share each token with their
Jaccard similarity as probability. A run of the join starts with all sets in one
node. A node samples each i with probability 1 / (threshold * SIZE), the same for
all its members, and a member goes to the child (i, v_i) for each i sampled: a
pair at the threshold has one common child on average. Small nodes are compared
by brute force, large ones go on splitting, however deep. Runs are repeated until
the wanted recall of a pair at the threshold.

Few pairs have to go below DEPTH levels, those of sets that share much with many
others, as pages of one template do. A common path gets rarer with each level, so there a
node splits in several ways at once, as many as keep ``DEEP`` of the pairs down to the
level at which halving would make it small. A node of which all but LIMIT
members are near to some pivots that hang together isn't split: pivots settle those
(``graph.linked``), and only the rest is compared. If they are half of the node
or more, the rest may be MANY times LIMIT: it is compared with all, as in a block.
Going on, the rows in nodes would grow with the square of a group of near copies
that has many stragglers.

1. Equal texts are one class, so copies cost no comparison.
2. Nodes are counted before anything but keys moves; nodes of one member end there.
3. Comparing is by a byte of each token; pairs that agree in as many as the
   threshold less FOUR deviations tie their classes into candidate groups. In a
   large node pivots settle what is near them (``graph.linked``).
4. Each candidate group gets its shingle sets once. They are intersected exactly,
   and only pairs at or above the threshold link. Links are counted where they are
   found and never written pair by pair; where only the classes are wanted, links
   to a pivot are enough.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, column, forget, table, written
from .graph import PIVOTS, Relation, components, linked, roots, settle, small

SIZE, DEPTH, LIMIT, MANY, FOUR = 128, 3, 256, 16, 4.0
#: The share of the pairs at the threshold that levels below DEPTH are to keep.
DEEP = 0.8
_WORD = regex.compile(WORD)
_MULTIPLY = np.random.default_rng(11).integers(1, 2**63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, n: int = 5) -> np.ndarray:
    """Hashes of the n-grams of words, in order. Fewer than n words are one shingle; none, no shingle."""
    words = _WORD.findall(text)
    if not words:
        return np.zeros(0, np.uint64)
    one = xxhash.xxh3_64_intdigest
    own = np.fromiter([one(w) for w in words], np.uint64, len(words))
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64) + np.uint64(n)
    for i in range(n):
        out = mix(out * _STEP + own[i : len(own) - n + 1 + i])
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """The SIZE smallest hashes, 32 bits each."""
    out = np.full(SIZE, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(hashes), 2048):
        part = hashes[i : i + 2048, None] * _MULTIPLY[None, :]
        part >>= np.uint64(32)
        out = np.minimum(out, part.min(0).astype(np.uint32))
    return out


def sampled(nodes: np.ndarray, threshold: float) -> np.ndarray:
    """Which i each node samples: a matrix (nodes, SIZE) of booleans."""
    coins = mix(nodes[:, None] + np.arange(1, SIZE + 1, dtype=np.uint64)[None, :] * _STEP)
    return coins < np.uint64(min(1.0, 1 / (threshold * SIZE)) * (2**64 - 1))


def children(nodes: np.ndarray, signatures: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) for each child that each row's set goes to."""
    row, i = np.nonzero(sampled(nodes, threshold))
    value = signatures[row, i].astype(np.uint64) | (i.astype(np.uint64) << np.uint64(32))
    return row, mix(mix(nodes[row] ^ _STEP) + value)


def survival(depth: int, below: float = 1.0) -> float:
    """The probability that a pair at the threshold has a common node after ``depth`` levels, and goes on from it with probability ``below``."""
    found = below
    for _ in range(depth):
        found = 1 - math.exp(-found)  # a common child lives on; their number is Poisson with mean 1
    return found


def repeats(wanted: float, each: float) -> int:
    """Independent trials of which one succeeds with probability ``wanted``."""
    return math.ceil(math.log(1 - wanted) / math.log(1 - each))


def runs_for(recall: float) -> int:
    """Runs that find a pair at the threshold with probability ``recall``, also if it has to go below DEPTH levels."""
    return repeats(recall, survival(DEPTH, DEEP))


def least_bytes(threshold: float) -> int:
    """Bytes in which two sketches agree at least, if their sets are at the threshold: FOUR deviations less than are expected."""
    return math.floor(SIZE * (threshold - FOUR * math.sqrt(threshold * (1 - threshold) / SIZE)))


class Agreeing:
    """Sketches of a group, near if at least ``least`` bytes agree."""

    def __init__(self, low: np.ndarray, least: int):
        self.low, self.least = low, least

    def near(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        a, b = self.low[left], self.low[right]
        if len(a) * len(b) <= 1024:
            return (a[:, None, :] == b[None, :, :]).sum(2) >= self.least
        same = np.zeros((len(a), len(b)), np.uint8)
        for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
            same += x[:, None] == y[None, :]
        return same >= self.least


@dataclass(frozen=True)
class Sketches(Relation):
    """Rows with a ``sketch``: a byte of each of SIZE tokens."""

    least: int

    def read(self, frame: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(len(frame), SIZE)

    def space(self, items: np.ndarray, s: int, e: int) -> Agreeing:
        return Agreeing(items[s:e], self.least)


class Intersecting:
    """Sets of a group as columns of an incidence matrix, near if their Jaccard similarity is at least ``threshold``."""

    def __init__(self, sets: list[np.ndarray], threshold: float):
        self.threshold, self.size = threshold, np.array([len(x) for x in sets])
        self.ends = np.r_[0, np.cumsum(self.size)]
        self.columns = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.width = int(self.columns.max()) + 1 if len(self.columns) else 0

    def _of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in rows, column) of each element of the sets at ``rows``."""
        sizes = self.size[rows]
        inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.repeat(np.arange(len(rows)), sizes), self.columns[np.repeat(self.ends[rows], sizes) + inner]

    def shared(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How many elements sets[left] and sets[right] share, exactly."""
        if len(left) <= 64:
            owner, columns = self._of(right)
            ends, mark, out = np.r_[0, np.cumsum(self.size[right])], np.zeros(self.width, bool), np.zeros((len(left), len(right)), np.int64)
            for k, i in enumerate(left):
                own = self.columns[self.ends[i] : self.ends[i + 1]]
                mark[own] = True
                total = np.r_[0, np.cumsum(mark[columns])]
                out[k] = total[ends[1:]] - total[ends[:-1]]
                mark[own] = False
            return out
        (one, a), (two, b) = self._of(left), self._of(right)
        here = np.zeros((2, self.width), bool)  # what only one side has is in no intersection
        here[0, a] = here[1, b] = True
        place, both = np.cumsum(here.all(0)) - 1, here.all(0)
        out, width = np.zeros((len(left), len(right)), np.float32), int(both.sum())
        sides = []
        for owner, columns in ((one, a), (two, b)):
            owner, columns = owner[both[columns]], place[columns[both[columns]]]
            order = np.argsort(columns, kind="stable")
            sides.append((owner[order], columns[order]))
        for start in range(0, width, 4096):
            parts = []
            for (owner, columns), n in zip(sides, out.shape, strict=True):
                s, e = np.searchsorted(columns, [start, start + 4096])
                part = np.zeros((n, min(4096, width - start)), np.float32)
                part[owner[s:e], columns[s:e] - start] = 1
                parts.append(part)
            out += parts[0] @ parts[1].T
        return out.astype(np.int64)

    def alike(self, left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
        both = self.shared(left, right)
        return both >= least * (self.size[left][:, None] + self.size[right][None, :] - both)

    def near(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.alike(left, right, self.threshold - 1e-12)

    def close(self, one: int, right: np.ndarray) -> np.ndarray:
        """Half the distance away: the Jaccard distance is a metric."""
        return self.alike(np.array([one]), right, (1 + self.threshold) / 2 + 1e-9)[0]


@dataclass(frozen=True)
class Sets(Relation):
    """Rows with ``shingles``: the distinct hashes of their n-grams."""

    threshold: float

    def read(self, frame: pd.DataFrame) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u8") for x in frame["shingles"]]

    def space(self, items: list[np.ndarray], s: int, e: int) -> Intersecting:
        return Intersecting(items[s:e], self.threshold)


def buckets(classes: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, list[DataFrame]]:
    """(key, node, size) of the nodes in which the members of ``classes`` (key, signature) are to meet, and the written tables that this reads."""
    members, sizes, tables = meetings(classes, threshold, recall)
    return members.join(sizes, "node"), tables


def meetings(classes: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(key, node) of the members of ``classes`` (key, signature) in the nodes in which they are to meet, (node, size) of these nodes, and the written tables that both read.

    A table of nodes only picks members (semi and anti joins), so no join makes more
    rows than it gets members.
    """
    spark, runs, least = classes.sparkSession, runs_for(recall), least_bytes(threshold)
    by_key = classes.select("key", "signature")

    def split(ways: int, first: bool):  # noqa: ANN202
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                signatures = np.frombuffer(b"".join(b["signature"]), "<u4").reshape(-1, SIZE)
                nodes = np.zeros(len(b), np.uint64) if first else b["node"].to_numpy().astype(np.int64).view(np.uint64)
                for way in range(ways):
                    own = mix(nodes + np.array([way + 1], np.uint64) * _STEP) if first or ways > 1 else nodes
                    row, node = children(own, signatures, threshold)
                    if len(row):
                        yield pd.DataFrame({"key": b["key"].to_numpy()[row], "node": node.view(np.int64)})

        return run

    @F.pandas_udf("binary")
    def hanging(found: pd.Series) -> pd.Series:
        """Of each node's pivots the largest set that hangs together, as sketches."""
        out = []
        for own in found:
            x = np.frombuffer(b"".join(own), "<u4").reshape(-1, SIZE)
            low = x.astype(np.uint8)
            root = roots(Agreeing(low, least).near, np.zeros(len(x), bool))
            out.append(low[root == np.bincount(root).argmax()].tobytes())
        return pd.Series(out, dtype=object)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own, size = np.frombuffer(b"".join(b["signature"]), "<u4").reshape(-1, SIZE).astype(np.uint8), b["pivots"].map(len).to_numpy()
            far = np.ones(len(b), bool)
            for bytes_ in np.unique(size):
                at = np.flatnonzero(size == bytes_)
                pivots = np.frombuffer(b"".join(b["pivots"].iloc[at]), np.uint8).reshape(len(at), -1, SIZE)
                far[at] = ~((own[at][:, None, :] == pivots).sum(2) >= least).any(1)
            yield pd.DataFrame({"node": b["node"], "open": far.astype(np.int64)})

    def sparse(large: DataFrame) -> DataFrame:
        """(node) of those in which more than LIMIT members, and half of all or MANY times LIMIT, aren't near to its pivots: PIVOTS members by hash, of which those count that hang together. Counts are summed before they move."""
        some = large.groupBy("node", F.pmod(F.xxhash64("key"), F.lit(PIVOTS))).agg(F.min_by("key", F.xxhash64("key", "node")).alias("key")).join(by_key, "key")
        chosen = small(written(some.groupBy("node").agg(F.collect_list("signature").alias("p")).select("node", hanging("p").alias("pivots")), "pivots_of_nodes"))
        told = large.select("key", "node").join(by_key, "key").join(chosen, "node").select("node", "signature", "pivots").mapInPandas(near, "node long, open long")
        counted = told.groupBy("node").agg(F.sum("open").alias("open"), F.count("*").alias("size"))
        return small(written(counted.where((F.col("open") > LIMIT) & ((F.col("open") > MANY * LIMIT) | (2 * F.col("open") > F.col("size")))).select("node"), "sparse"))

    nodes, tables, level = written(by_key.mapInPandas(split(runs, True), "key binary, node long"), "nodes"), [], 0
    met, sizes = [], []
    while True:
        level += 1
        at_most = nodes.count()
        counts = written(nodes.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "sizes", at_most // 2, 200_000)
        few, many = counts.where(F.col("size") <= LIMIT), counts.where(F.col("size") > LIMIT)
        done = written(nodes.join(small(few.select("node")), "node", "left_semi"), "members", at_most, 200_000)
        met, sizes, tables = [*met, done], [*sizes, few], [*tables, counts, done]
        if many.isEmpty():
            break
        large = written(nodes.join(small(many.select("node")), "node", "left_semi"), "large", at_most, 200_000)
        forget(spark, nodes)
        ways, deeper = 1, large
        if level >= DEPTH:
            wide = sparse(large)
            met, sizes, tables = [*met, large.join(wide, "node", "left_anti")], [*sizes, many.join(wide, "node", "left_anti")], [*tables, large]
            if wide.isEmpty():
                break
            deeper = large.join(wide, "node", "left_semi")
            if level == DEPTH:  # the first level below splits in several ways, for all levels that are to come if each halves
                largest = many.join(wide, "node", "left_semi").agg(F.max("size")).first()[0]
                ways = repeats(DEEP, survival(math.ceil(math.log2(largest / LIMIT)) + 2))
        nodes = written(deeper.select("key", "node").join(by_key, "key").mapInPandas(split(ways, False), "key binary, node long"), "nodes")
        if level < DEPTH:
            forget(spark, large)
    return reduce(DataFrame.unionByName, met).select("key", "node"), reduce(DataFrame.unionByName, sizes), tables


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.995, count: bool = True) -> DataFrame:
    """(doc_id, n_links, class_id, kept, text_key) for each row of ``docs``.

    Links are other rows whose sets of word ``n``-grams have a Jaccard similarity
    of ``threshold`` or more; class_id is the smallest doc_id reachable by links,
    itself included, and ``kept`` says that it is the row's own. ``recall`` is the
    wanted share of found pairs at the threshold; no pair below it links. Without
    ``count`` n_links is null: classes need fewer comparisons than counts.
    Texts of fewer than n words have one n-gram, all their words; null texts and
    texts without words link with nothing, not even with each other. Rows that
    repeat a doc_id count one by one. A null doc_id is the smallest only in a
    class that has no other, whose rows are then all kept. An empty table gives
    an empty one. Extra columns don't matter.
    """
    spark = docs.sparkSession
    own = docs.select(column(docs, doc_id).cast("long").alias("i"), column(docs, text).alias("t"))
    key = F.substring(F.unhex(F.sha2("t", 256)), 1, 16)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [signature(s).astype("<u4") if x and len(s := shingles(x, n)) else None for x in b["t"]]
            yield pd.DataFrame({"doc_id": b["i"].astype("Int64"), "key": [k if s is not None else None for k, s in zip(b["key"], found, strict=True)], "signature": [None if s is None else s.tobytes() for s in found], "sketch": [None if s is None else s.astype(np.uint8).tobytes() for s in found]})

    signed = written(own.withColumn("key", key).mapInPandas(sign, "doc_id long, key binary, signature binary, sketch binary"), "signatures")
    rows = written(signed.select("doc_id", "key"), "rows")
    classes = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch"))
    classes = written(classes, "classes", rows.count(), 2_000)
    forget(spark, signed)
    met, sizes, leaves = meetings(classes, threshold, recall)
    least = least_bytes(threshold)
    sizes = sizes.select("node", F.col("size").alias("rows_"), (F.col("size") * SIZE).alias("bytes_"))
    # Sorted, a class is tied to the smallest of its component in each node, mostly the same one: few distinct ties.
    ties = linked(met.join(classes.select("key", "sketch"), "key"), ["node"], ["sketch"], Sketches(least), sizes)
    ties = written(ties.select(F.col("key").alias("a"), F.col("top").alias("b")).distinct(), "ties")
    for table_ in leaves:
        forget(spark, table_)
    groups = components(ties).withColumnRenamed("node", "key")
    members = written(groups.join(classes.select("key", "n", "rep"), "key"), "groups", groups.count())

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"root": b["root"], "key": b["key"], "n": b["n"], "shingles": [np.unique(shingles(x, n)).astype("<u8").tobytes() for x in b["t"]]})

    # By key and doc_id, so that rows of a text with many copies go to many tasks.
    texts = own.withColumn("key", key).join(small(members).withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & F.col("i").eqNullSafe(F.col("rep")))
    sets = written(texts.select("root", "key", "n", "t").mapInPandas(gather, "root binary, key binary, n long, shingles binary"), "sets")
    if members.count() < sets.count():  # rows that repeat a doc_id and its text
        sets = written(sets.groupBy("root", "key", "n").agg(F.first("shingles").alias("shingles")), "sets")
    sizes = sets.groupBy("root").agg(F.count("*").alias("rows_"), F.sum(F.octet_length("shingles")).alias("bytes_"))
    found = written(linked(sets, ["root"], ["shingles"], Sets(threshold), sizes, count), "links")
    final = settle(classes, found)
    out = rows.join(final, "key", "left")
    class_id = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    links = F.coalesce("n_links", F.lit(0).cast("long")) if count else F.lit(None).cast("long")
    return out.select("doc_id", links.alias("n_links"), class_id.alias("class_id"), F.col("doc_id").eqNullSafe(class_id).alias("kept"), F.col("key").alias("text_key"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits: float) -> DataFrame:
    """``docs`` without the rows that ``jaccard_join`` doesn't keep: of each class its smallest doc_id stays, with all rows that repeat it."""
    gone = jaccard_join(docs, doc_id, text, count=False, **limits).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"))
    gone = small(written(gone, "gone"))
    return docs.join(gone, (F.substring(F.unhex(F.sha2(column(docs, text), 256)), 1, 16) == F.col("gone_key")) & column(docs, doc_id).cast("long").eqNullSafe(F.col("gone_id")), "left_anti")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("text_key")


#: By the texts' n-grams themselves, for tables whose groups of near copies are small; the operator finds a pair at the threshold with probability 0.995.
OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (SELECT row_number() OVER () AS k, * FROM (SELECT text, any_value(w) AS w, min(doc_id) AS rep, count(*) AS n FROM d WHERE len(w) > 0 GROUP BY text)),
s AS (SELECT DISTINCT k, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM c),
z AS (SELECT k, count(*) AS size FROM s GROUP BY k),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.k < b.k GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN z x ON x.k = a JOIN z y ON y.k = b WHERE 5 * shared >= 4 * (x.size + y.size - shared)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
walk AS (SELECT k AS a, k AS b FROM c UNION SELECT walk.a, u.b FROM walk JOIN u ON walk.b = u.a),
g AS (SELECT a AS k, min(rep) AS class_id FROM walk JOIN c ON c.k = b GROUP BY a),
m AS (SELECT a AS k, sum(n) AS n FROM u JOIN c ON c.k = b GROUP BY a),
f AS (SELECT text, (c.n - 1 + coalesce(m.n, 0))::BIGINT AS n_links, class_id FROM c JOIN g USING (k) LEFT JOIN m USING (k))
SELECT doc_id, coalesce(n_links, 0) AS n_links, coalesce(class_id, doc_id) AS class_id, doc_id IS NOT DISTINCT FROM coalesce(class_id, doc_id) AS kept FROM d LEFT JOIN f ON f.text = d.text
"""
