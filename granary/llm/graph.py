"""Groups and links without tasks that see a whole group: blocks, grouped maps, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Rows and bytes of a table that may be broadcast; larger ones are joined by sorting both sides.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8 << 20
#: Rows from which a group is split, rows and bytes of a block at most, pivots of a split group, rows compared at a time.
LEAST, MOST, MOST_BYTES, PIVOTS, TILE = 1024, 4096, 32 << 20, 16, 1024


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table of columns of bounded width, with a broadcast hint if it has few rows and bytes."""
    if df.isEmpty():
        return F.broadcast(df)
    wide = [F.octet_length(c) if kind in ("binary", "string") else F.lit(8) if not kind.startswith("array") else 8 * F.size(c) for c, kind in df.dtypes]
    rows, size = df.agg(F.count("*"), F.sum(sum([F.coalesce(w, F.lit(0)) for w in wide], F.lit(8)).cast("long"))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def grouped(df: DataFrame, keys: list[str], run: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame | None], schema: str, then: tuple[str, ...] = ()) -> DataFrame:
    """Rows of equal keys pass to ``run`` together, many small groups at a time.

    ``run`` gets a frame sorted by group, within it by ``then``, and the positions
    where groups begin (and the end), and returns rows of ``schema`` or None.
    """
    fields = [x.strip().split()[0] for x in schema.split(",")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            if held:
                same = all(b[k].iloc[-1] == held[-1][k].iloc[-1] for k in keys)
                if same and sum(map(len, held)) < 1_000_000:
                    held.append(b)  # a group may go on in the next batch
                    continue
                b = pd.concat([*held, b], ignore_index=True)
            change = np.zeros(len(b), bool)
            for k in keys:
                v = b[k].to_numpy()
                change[1:] |= v[1:] != v[:-1]
            starts = np.flatnonzero(change)
            cut = int(starts[-1]) if len(starts) else 0  # the last group may go on
            if cut:
                out = run(b.iloc[:cut].reset_index(drop=True), np.r_[0, starts[:-1], cut])
                if out is not None and len(out):
                    yield out[fields]
            held = [b.iloc[cut:]]
        if held:
            b = pd.concat(held, ignore_index=True)
            change = np.zeros(len(b), bool)
            for k in keys:
                v = b[k].to_numpy()
                change[1:] |= v[1:] != v[:-1]
            out = run(b, np.r_[0, np.flatnonzero(change), len(b)])
            if out is not None and len(out):
                yield out[fields]

    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *then).mapInPandas(each, schema)


class Relation:
    """Which rows link. ``read`` prepares a frame once, ``space`` one group's rows ``s`` to ``e`` of it.

    A space has ``near(left, right)``, the links between rows at those positions
    within the group as a matrix of booleans, and, where links are counted,
    ``close(one, right)``: which rows are so near to a row that any two of them link.
    """

    def read(self, frame: pd.DataFrame) -> Any:
        raise NotImplementedError

    def space(self, items: Any, s: int, e: int) -> Any:
        raise NotImplementedError


def roots(near: Callable[[np.ndarray, np.ndarray], np.ndarray], core: np.ndarray) -> np.ndarray:
    """The first row of each row's component; ``core`` rows are known to be in one.

    Rows that are reached serve as pivots against those that aren't yet, so where
    links are many a few pivots settle all, and rows settled are never compared with each other.
    """
    label, front, rest = np.arange(len(core)), np.flatnonzero(core), np.flatnonzero(~core)
    seed = int(front[0]) if len(front) else 0
    label[front] = seed
    while len(rest):
        take = 1
        while len(front) and len(rest):
            now, front = front[:take], front[take:]
            hit = near(now, rest).any(0)
            label[rest[hit]] = seed
            front, rest, take = np.r_[front, rest[hit]], rest[~hit], min(64, 2 * take)
        if len(rest):
            seed, front, rest = int(rest[0]), rest[:1], rest[1:]
            label[seed] = seed
    return label


def counted(space: Any, own: np.ndarray, cross: bool, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row how many copies it links with, and the first row of its component.

    Pairs are of different ``own`` if ``cross``, all else. TILE rows at a time are compared.
    """
    n = len(own)
    links, whole = np.zeros(n, np.int64), np.zeros((n, n), bool)
    left, right = (np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min())) if cross else (np.arange(n), np.arange(n))
    for a in range(0, len(left), TILE):
        one, two = left[a : a + TILE], right if cross else right[a:]
        if not len(two):
            break
        found = space.near(one, two)
        if not cross:
            found = np.triu(found, 1)
        links[one] += found @ copies[two]
        links[two] += copies[one] @ found
        whole[np.ix_(one, two)] |= found
    whole |= whole.T
    return links, roots(lambda x, y: whole[np.ix_(x, y)], np.zeros(n, bool))


def _blocks(rows: Column, bytes_: Column) -> Column:
    """Into how many blocks so many rows go: eight at most, until one would have more than MOST rows or MOST_BYTES."""
    return F.greatest(F.ceil(rows / MOST), F.ceil(bytes_ / MOST_BYTES), F.least(F.lit(8), F.ceil(rows / LEAST))).cast("int")


def linked(df: DataFrame, group: list[str], payload: list[str], relation: Relation, sizes: DataFrame, count: bool = False) -> DataFrame:
    """(key, top, links, split) for the members (group, key, n, payload) of groups: who links with whom within a group.

    Without ``count`` a row (key, top) ties a key to another of its component; rows
    that nothing ties are left out. With ``count`` there is a row for each meeting:
    ``links`` adds up the ``n`` of the linked members that were met, and ``split``
    says that top is only one member of its component. ``n`` is needed for that only.

    A group (``sizes`` has its rows_ and bytes_) of up to LEAST rows is compared in
    one task. In a larger one the members first meet up to PIVOTS of their number.
    Without ``count``, those linked to a set of pivots that hang together are tied
    to it; with it, those are settled that are so near to one pivot that any two of
    them link (distances obey the triangle inequality). Settled members, the core,
    needn't be compared with each other. What isn't settled is dealt into blocks, and
    a block meets every other, and the core's. So where copies are close the rows
    grow with the group; where none is, blocks of MOST rows are all compared.
    """
    spark = df.sparkSession
    names = [*group, "key", *["n"][: int(count)], *payload]
    df = df.select(*names)
    kinds = dict(df.dtypes)
    schema = lambda columns: ", ".join(f"{c} {kinds.get(c) or {'core': 'boolean', 'top': 'binary', 'own': 'int'}[c]}" for c in columns)

    def meet(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        items, keys, core, split = relation.read(frame), frame["key"].to_numpy(), frame["core"].to_numpy(), frame["split"].to_numpy()
        own, cross = frame["own"].to_numpy(), (frame["bi"] != frame["bj"]).to_numpy()
        copies = frame["n"].to_numpy() if count else None
        out = []
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            if e - s < 2:
                continue
            space = relation.space(items, s, e)
            if count:
                links, root = counted(space, own[s:e], cross[s], copies[s:e])
                out.append((keys[s:e], keys[s:e][root], links, split[s:e]))
            else:
                near = space.near
                if e - s <= 64:
                    every = np.arange(e - s)
                    whole = np.triu(near(every, every), 1)
                    if not whole.any():
                        continue
                    whole |= whole.T
                    near = lambda x, y: whole[np.ix_(x, y)]  # noqa: E731, B023
                root = roots(near, core[s:e])
                tied = np.flatnonzero((root != np.arange(e - s)) & ~core[s:e])
                if len(tied):
                    out.append((keys[s:e][tied], keys[s:e][root[tied]], np.zeros(len(tied), np.int64), split[s:e][tied]))
        return pd.DataFrame({c: np.concatenate([x[i] for x in out]) if out else [] for i, c in enumerate(("key", "top", "links", "split"))})

    def choose(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        items, take, top = relation.read(frame), [], []
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            space, every = relation.space(items, s, e), np.arange(e - s)
            if count:
                main = [int(np.argmax([space.close(i, every).sum() for i in every]))]
            else:
                root = roots(space.near, np.zeros(e - s, bool))
                main = np.flatnonzero(root == np.bincount(root).argmax()).tolist()
            take += [s + i for i in main]
            top += [frame["key"].iloc[s + main[0]]] * len(main)
        return frame.iloc[take].assign(top=top)

    def settled(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        items, pivot, keys = relation.read(frame), frame["top"].notna().to_numpy(), frame["key"].to_numpy()
        core, top = np.zeros(len(frame), bool), frame["top"].to_numpy().copy()
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            space, at = relation.space(items, s, e), np.flatnonzero(pivot[s:e])
            rows = np.flatnonzero(~pivot[s:e])
            if not len(rows):
                continue
            hit = space.close(at[0], rows) if count else space.near(at, rows).any(0)
            core[s + rows[hit]], top[s + rows] = True, top[s + at[0]]
        return frame.assign(core=core, top=top)[~pivot]

    plain = {"core": F.lit(False), "split": F.lit(False), "own": F.lit(0), "bi": F.lit(0), "bj": F.lit(0)}
    large = written(sizes.where((F.col("rows_") > LEAST) | (F.col("bytes_") > MOST_BYTES)).select(*group, _blocks(F.col("rows_"), F.col("bytes_")).alias("blocks_")), "large")
    fields = "key binary, top binary, links long, split boolean"
    if large.isEmpty():
        return grouped(df.withColumns(plain), [*group, "bi", "bj"], meet, fields, ("key",))
    large = small(large)
    weight = sum([F.octet_length(c) for c in payload], F.lit(0)).cast("long")
    big = written(df.join(large, group), "big")
    place = F.xxhash64("key")
    some = big.groupBy(*group, F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(PIVOTS)).alias("h")).agg(F.min_by(F.struct(*[c for c in [*names, "blocks_"] if c not in group]), place).alias("p")).select(*group, "p.*")
    some = written(grouped(some, group, choose, schema(names) + ", blocks_ int, top binary", ("key",)), "pivots")
    pivots = some.withColumn("own", F.explode(F.sequence(F.lit(0), F.col("blocks_") - 1))).select(*names, "own", "top")
    dealt = big.withColumns({"own": F.pmod(place, F.col("blocks_")).cast("int"), "top": F.lit(None).cast("binary")}).select(*names, "own", "top")
    known = written(grouped(dealt.unionByName(pivots), [*group, "own"], settled, schema([*names, "core", "top"]), ("key",)), "core")
    sums = {"u_": ~F.col("core"), "s_": F.col("core")}
    sized = known.groupBy(*group).agg(*[F.count_if(c).alias(k + "rows") for k, c in sums.items()], *[F.coalesce(F.sum(F.when(c, weight)), F.lit(0)).alias(k + "bytes") for k, c in sums.items()], *[F.sum(F.when(F.col("core"), F.col("n"))).alias("copies")] * int(count))
    sized = written(sized.select(*group, *[_blocks(F.col(k + "rows"), F.col(k + "bytes")).alias(k + "blocks") for k in sums], *["copies"][: int(count)]), "sized")
    known = known.join(small(sized), group)
    open_, all_ = F.col("u_blocks"), F.col("u_blocks") + F.col("s_blocks")
    own = F.when(F.col("core"), open_ + F.pmod(place, F.col("s_blocks"))).otherwise(F.pmod(place, open_)).cast("int")
    pairs = known.where("u_blocks > 0").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("core"), open_).otherwise(all_) - 1)))
    pairs = pairs.withColumns({"bi": F.least("own", "other"), "bj": F.greatest("own", "other"), "split": F.lit(True)})
    last = [*names, "core", "split", "own", "bi", "bj"]
    whole = df.join(large, group, "left_anti").withColumns(plain)
    met = grouped(whole.select(*last).unionByName(pairs.select(*last)), [*group, "bi", "bj"], meet, fields, ("key",))
    alone = (F.col("copies") - F.col("n")) if count else F.lit(0).cast("long")
    return met.unionByName(known.where("core").select("key", "top", alone.alias("links"), F.lit(True).alias("split")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): root is the smallest node reachable.

    Labels flow along edges and then jump to their label's label, so rounds are
    few (the logarithm of the longest path). Each round is a written table, and
    ``edges`` is one. Both
    joins have one row a key on one side, so a node with very many links is split
    by the adaptive skew join.
    """
    spark, n = edges.sparkSession, 2 * edges.count()
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges", n)
    label = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels", n)
    while True:
        near = both.join(label.select(F.col("node").alias("a"), "root"), "a").groupBy("b").agg(F.min("root").alias("near"))
        flown = label.join(near.withColumnRenamed("b", "node"), "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = written(flown.join(jump, "root", "left").select("node", F.coalesce("next", "root").alias("root"), "was"), "labels", n)
        changed = new.where("root <> was").head(1)
        forget(spark, label)
        label = new.select("node", "root")
        if not changed:
            forget(spark, both)
            return label


def settle(classes: DataFrame, linked: DataFrame) -> DataFrame:
    """(key, n_links, component_id) for each class.

    ``classes``: key, rep (the smallest id with that content), n (rows). ``linked``:
    key, links (rows linked directly, copies aside), top (a class of the same
    component, the same for all of a group that wasn't split) and split, once or
    more for each class that may link. A component's id is its smallest rep.
    """
    n = classes.count()
    tops = linked.where("not split").select("key", "top")
    split = linked.where("split")
    if split.head(1):
        tops = tops.union(components(written(split.where("key <> top").select(F.col("key").alias("a"), F.col("top").alias("b")).distinct(), "far")).select("node", "root"))
    counts = linked.groupBy("key").agg(F.sum("links").alias("links"))
    named = classes.select("key", "n", "rep").join(tops, "key", "left").join(counts, "key", "left")
    named = written(named.select("key", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("top", "key").alias("top")), "named", n)
    least = written(named.groupBy("top").agg(F.min("rep").alias("component_id")), "least", n)
    return written(named.join(least, "top").select("key", "n_links", "component_id"), "settled", n)
