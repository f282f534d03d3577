"""Cost-balanced packing: descending documents go to the sequence of the lowest cost that has room.

A piece of n tokens costs ``linear`` * n + n * n: what a model does a token, and attention
within the piece. Documents are cut at the capacity; what is left of each, a tail,
is dealt, longest first, to the sequence of the lowest cost among those with room for
it. As many sequences are open as all tokens fill, one of them in powers of two
(its remainder's binary digits), so there is exactly as much room as there are
tokens. Tails that no sequence takes whole are cut when all others have their
place: the largest room takes a head, and the rest is dealt again. Every sequence
ends full, at its power of two or at the capacity.

Lengths are integers up to the capacity, so the dealing needs only how many tails
each length has: equal tails and sequences in equal states are dealt as runs. The
histogram, at most ``capacity`` rows, comes to the driver and gives a table of some
thousand segments, whatever the number of documents. Ranks within a length, the
look-up of segments, cuts and checksums are done where the rows are.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, table, written
from .packing import encoder

#: Rows that one (length, cell) should have at most, if all rows had one length.
CELL_ROWS = 100_000
#: Tokens at which attention costs as much as all else: six times the width of a model of 1,024.
LINEAR = 6 * 1024
_ITEM = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost long, ids binary"
#: Of tails of ``source`` tokens, those ranked ``rank`` to ``rank + n - 1`` put their tokens from ``start`` on, ``length`` of them, into sequences ``sequence``, ``sequence + 1``, ... at ``offset``.
SEGMENT = ("source", "rank", "n", "start", "length", "sequence", "offset")


def rooms(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(capacity, how many): sequences that hold exactly ``tokens``."""
    full, rest = divmod(tokens, capacity)
    return [(capacity, full)] * bool(full) + [(1 << b, 1) for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def deal(lengths: dict[int, int], capacity: int, linear: int = LINEAR) -> np.ndarray:
    """Segments (see SEGMENT) for a histogram of lengths, each from 1 to ``capacity``.

    Runs of sequences in one state (room, cost) are kept by room. ``lowest`` has the
    lowest cost of each room, so the sequence that a length goes to is the minimum of
    a slice. Each step uses up a run of tails or a run of sequences.
    """
    states: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity + 1)]  # by room: (cost, first sequence, how many, size)
    lowest = np.full(capacity + 1, np.inf)
    waiting: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # by length: (source, rank, start, how many)
    found: list[tuple[int, ...]] = []

    def put(room: int, state: tuple[int, int, int, int]) -> None:
        heapq.heappush(states[room], state)
        lowest[room] = states[room][0][0]

    def give(room: int, length: int, source: int, rank: int, start: int, n: int) -> int:
        cost, first, many, size = heapq.heappop(states[room])
        lowest[room] = states[room][0][0] if states[room] else np.inf
        taken = min(n, many)
        found.append((source, rank, taken, start, length, first, size - room))
        if room > length:
            put(room - length, (cost + length * (linear + length), first, taken, size))
        if many > taken:
            put(room, (cost, first + taken, many - taken, size))
        return taken

    first = 0
    for size, many in rooms(sum(length * n for length, n in lengths.items()), capacity):
        put(size, (0, first, many, size))
        first += many
    for length, n in lengths.items():
        waiting[length].append((length, 0, 0, n))
    for cut in (False, True):
        left = []
        for length in range(capacity, 0, -1):
            while waiting[length]:
                source, rank, start, n = waiting[length].pop()
                while n:
                    room = length + int(np.argmin(lowest[length:]))
                    if lowest[room] < np.inf:
                        taken = give(room, length, source, rank, start, n)
                    elif cut:  # no room for all of it: the largest room takes a head
                        room = int(np.flatnonzero(lowest < np.inf)[-1])
                        taken = give(room, room, source, rank, start, n)
                        waiting[length - room].append((source, rank, start + room, taken))
                    else:
                        left.append((length, (source, rank, start, n)))
                        break
                    rank, n = rank + taken, n - taken
        for length, run in left:
            waiting[length].append(run)
    return np.array(sorted(found), np.int64).reshape(-1, len(SEGMENT))


def items(docs: DataFrame, tokenizer: str, capacity: int, end: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ids and ``end``, cut at ``capacity``: pieces of ``capacity`` tokens, and a shorter tail.

    Ids are little-endian, of 16 bits where the vocabulary allows it.
    """
    fields = [x.split()[0] for x in _ITEM.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, close = encoder(tokenizer), np.array([end], "<u4")
        for b in batches:
            rows = []
            for i, x in zip(b["i"], b["t"], strict=True):
                ids = np.concatenate([encode(x or "").astype("<u4"), close])
                for a in range(0, len(ids), capacity):
                    own = ids[a : a + capacity]
                    rows.append((None if pd.isna(i) else int(i), a, len(own), zlib.crc32(own.tobytes()), len(ids), own.tobytes() if own.max() > 0xFFFF else own.astype("<u2").tobytes()))
            out = pd.DataFrame(rows, columns=fields)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(column(docs, doc_id).cast("long").alias("i"), column(docs, text).alias("t")).mapInPandas(run, _ITEM)


def placed(rows: pd.DataFrame, segments: np.ndarray, linear: int, with_ids: bool) -> pd.DataFrame:
    """The pieces of ``rows`` (items with their ``rank`` among those of equal length): one for each segment that a row's rank lies in."""
    keys, bounds = np.unique(segments[:, 0], return_index=True)
    ends = np.r_[bounds[1:], len(segments)]
    at_, of_ = [], []  # rows, and their segments
    for length in np.unique(rows["length"].to_numpy()):
        k = np.searchsorted(keys, length)
        own = segments[bounds[k] : ends[k]]
        at = np.flatnonzero(rows["length"].to_numpy() == length)
        ranks = rows["rank"].to_numpy()[at]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        lo, hi = np.searchsorted(ranks, own[:, 1]), np.searchsorted(ranks, own[:, 1] + own[:, 2])
        for s, (a, z) in enumerate(zip(lo, hi, strict=True)):
            if z > a:
                at_.append(at[a:z])
                of_.append(np.full(z - a, bounds[k] + s))
    at, of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at_, of_))
    seg, own = segments[of], rows.iloc[at]
    out = pd.DataFrame({"doc_id": own["doc_id"].astype("Int64"), "start": own["start"] + seg[:, 3], "length": seg[:, 4], "ids_crc32": own["ids_crc32"], "doc_tokens": own["doc_tokens"]})
    out["sequence_id"], out["offset"] = seg[:, 5] + own["rank"].to_numpy() - seg[:, 1], seg[:, 6]
    out["cost"] = out["length"] * (linear + out["length"])
    ids = own["ids"].tolist() if with_ids else [None] * len(own)
    crcs = out["ids_crc32"].tolist()
    for i in np.flatnonzero((seg[:, 4] < seg[:, 0]) | with_ids):
        raw = own["ids"].iloc[i]
        whole = np.frombuffer(raw, "<u2" if len(raw) == 2 * seg[i, 0] else "<u4")[seg[i, 3] : seg[i, 3] + seg[i, 4]].astype("<u4").tobytes()
        crcs[i], ids[i] = zlib.crc32(whole), whole if with_ids else None
    out["ids_crc32"], out["ids"] = crcs, ids
    return out


def pack_balanced(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 0, linear: int = LINEAR, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost) of every piece of ``docs``; with ``with_ids`` its ids (binary).

    A null or empty text is one token, ``end``. Whole texts are encoded, however
    long. Rows that repeat a doc_id, and rows with a null one, are documents of their
    own. An empty table gives an empty one. Other columns of ``docs``, whatever
    their names, don't go on. Tails of equal length take their places in the order
    of a number that their rows are given when they are written, so another
    partitioning of the input may swap them.
    """
    spark = docs.sparkSession
    rows = written(items(docs, tokenizer, capacity, end, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "items")
    cells = max(64, -(-rows.count() // CELL_ROWS))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)).cast("int"))
    counts = written(rows.groupBy("length", "cell").agg(F.count("*").alias("n")), "counts")
    lengths = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length
    segments = deal(lengths, capacity, linear)
    whole = with_ids or [int(x) for x in np.unique(segments[segments[:, 4] < segments[:, 0], 0])]  # only tails that are cut take their ids along
    ids = F.col("ids") if with_ids else F.when(F.col("length").isin(whole), F.col("ids"))
    shift = counts.select("length", "cell", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("length", "cell").orderBy("row")) - 1
    ranked = rows.withColumn("ids", ids).join(shift, ["length", "cell"]).withColumn("rank", F.col("base") + inside)
    table_ = spark.sparkContext.broadcast(segments)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield placed(b, table_.value, linear, with_ids)

    found = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "rank").mapInPandas(place, _PIECE)
    return found if with_ids else found.drop("ids")


def op11_balanced_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None, capacity: int = 1024) -> DataFrame:
    import public_tokenizers

    return pack_balanced(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"), capacity)
