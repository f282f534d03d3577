"""Best-fit packing: bulk-synchronous best fit over runs of equal lengths.

Waiting documents and the gaps that sequences have left are two tables of runs:
documents of one length (by rank), gaps of one room (by sequence). Lengths are
integers up to the capacity, so the tables have some thousands of rows, whatever
the number of documents. They are packed in rounds, each a written table:

1. Documents and gaps are range-sorted by size together. Each of RANGES ranges is a
   task of its own and sweeps its runs from large to small: a run of documents takes
   its successor, the tightest gap that no longer document of the range has taken,
   and each gap takes as many of its documents as fit. Where more documents want the
   gaps of a run than it has, ranks decide: the first ranks get them, the others go
   on to the next successor. Gaps are updated, and the range is swept again until
   nothing moves.
2. What is left of all ranges, documents whose successor lies in another range, is
   swept in one range.
3. Documents that fit no gap open sequences, the longest first: all above half of
   the capacity, and if there are none, in OPEN of as many sequences as the rest
   takes at least. Then the next round begins. More at once would not wait for the
   gaps that the longest leave.

Ranks are found without a task that sees a whole run: rows are dealt by length and
a hash, ranked there, and shifted by the counts of the hashes before. What the
rounds find is a table of segments, which every row looks up by length and rank.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, fresh, table, written
from .token_counts import _byte_of

#: Rows that one (length, hash) cell should have at most, if all rows had one length.
CELL_ROWS = 100_000
#: Ranges of a round's first sweep, and the share of the sequences wanted for what is left that a round opens.
RANGES, OPEN = 8, 0.4
#: How byte-level BPE cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict = {}


def encoder(path: str):  # noqa: ANN201
    """A function from text to token ids (uint32), those of the tokenizers library for its .json file.

    A byte-level BPE whose merges are in the order of their ids runs in tiktoken,
    which gives the same ids some four times as fast; others run in tokenizers.
    """
    if path in _ENCODERS:
        return _ENCODERS[path]
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, special = spec["model"]["vocab"], {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
    plain = spec.get("pre_tokenizer") == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    plain = plain and not spec.get("normalizer") and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or not x["special"] for x in spec.get("added_tokens", ()))
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if plain and made == sorted(made) and not spec["model"].get("ignore_merges"):
        import tiktoken

        to_byte = _byte_of()
        ranks = {bytes(to_byte[c] for c in s): i for s, i in vocab.items() if s not in special}
        own = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        _ENCODERS[path] = lambda text: own.encode_to_numpy(text, allowed_special="all")
    else:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        slow.no_truncation()
        slow.no_padding()
        _ENCODERS[path] = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    return _ENCODERS[path]


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's ids and ``end``, in pieces of ``capacity`` of which the first may be shorter.

    Columns: doc_id, piece, start, length, ids_crc32, and with ``with_ids`` the
    piece's ids as little-endian 32-bit integers (binary). A null text is empty:
    one piece of one id. Whole texts are encoded, whatever their length.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    fields = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, close = encoder(tokenizer), np.array([end], "<u4")
        for b in batches:
            rows = []
            for i, x in zip(b["i"], b["t"], strict=True):
                ids = np.concatenate([encode(x or "").astype("<u4"), close])
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = ids[a:z].tobytes()
                    rows.append((None if pd.isna(i) else int(i), k, a, z - a, zlib.crc32(own), own)[: len(fields)])
            out = pd.DataFrame(rows, columns=fields)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(column(docs, doc_id).cast("long").alias("i"), column(docs, text).alias("t")).mapInPandas(run, schema)


GAP, DOCUMENT, SEGMENT, OPENED = range(4)
#: A gap's size is its room, first its sequence; a document's its length and rank. A segment's ``n`` documents of a length lie ``each`` to a sequence.
_RUNS = "kind int, size long, first long, n long, sequence long, offset long, each long"
Run = tuple[int, int]  # the first rank or sequence, and how many


def sweep(documents: dict[int, Run], gaps: dict[int, list[Run]], capacity: int) -> list[tuple]:
    """One sweep from large to small; both tables are updated. Returns the segments it found."""
    found, open_, new = [], [], defaultdict(list)
    for size in sorted({*documents, *gaps}, reverse=True):
        open_ += [(size, first, n) for first, n in gaps.get(size, ())]
        rank, waiting = documents.pop(size, (0, 0))
        while waiting and open_:
            room, first, n = open_.pop()  # the successor
            each = room // size
            taken = min(waiting, n * each)
            full, rest = divmod(taken, each)
            found.append((SEGMENT, size, rank, taken, first, capacity - room, each))
            if full:
                new[room - each * size].append((first, full))
            if rest:
                new[room - rest * size].append((first + full, 1))
            used = full + bool(rest)
            if n > used:
                open_.append((room, first + used, n - used))
            rank, waiting = rank + taken, waiting - taken
        if waiting:
            documents[size] = rank, waiting
    gaps.clear()
    for room, first, n in open_:
        new[room].append((first, n))
    new.pop(0, None)
    gaps.update(new)
    return found


def opened(documents: dict[int, Run], gaps: dict[int, list[Run]], capacity: int, sequences: int, share: float) -> tuple[list[tuple], int]:
    """Segments in new sequences, from number ``sequences`` on, and the number of the next one; both tables are updated."""
    wanted = max(1, int(-(-sum(size * n for size, (_, n) in documents.items()) // capacity) * share))
    found, start, long = [], sequences, 2 * max(documents) > capacity
    for size in sorted(documents, reverse=True):
        left = wanted - (sequences - start)
        if long and 2 * size <= capacity or not long and left <= 0:
            break
        rank, waiting = documents.pop(size)
        each = capacity // size
        n = -(-waiting // each) if long else min(left, -(-waiting // each))
        taken = min(waiting, n * each)
        full, rest = divmod(taken, each)
        found.append((SEGMENT, size, rank, taken, sequences, 0, each))
        for room, first, many in ((capacity - each * size, sequences, full), (capacity - rest * size, sequences + full, int(rest > 0))):
            if room and many:
                gaps.setdefault(room, []).append((first, many))
        sequences += n
        if waiting > taken:
            documents[size] = rank + taken, waiting - taken
    return found, sequences


def swept(runs: pd.DataFrame, capacity: int, sequences: int | None = None, share: float = OPEN) -> pd.DataFrame:
    """The runs of a range after sweeps until nothing moves, and the segments found; with ``sequences`` new ones are opened from that number on."""
    documents = {size: (first, n) for kind, size, first, n in zip(*(runs[c].tolist() for c in ("kind", "size", "first", "n")), strict=True) if kind == DOCUMENT}
    gaps: dict[int, list[Run]] = {}
    for kind, first, size, n in sorted(zip(*(runs[c].tolist() for c in ("kind", "first", "size", "n")), strict=True)):
        if kind == GAP:
            gaps.setdefault(size, []).append((first, n))
    found = [x for x in runs.itertuples(index=False, name=None) if x[0] == SEGMENT]  # of the sweeps before
    while documents and gaps and (moved := sweep(documents, gaps, capacity)):
        found += moved
    if sequences is not None and documents:
        new, after = opened(documents, gaps, capacity, sequences, share)
        found += [*new, (OPENED, 0, 0, after - sequences, 0, 0, 0)]
    found += [(DOCUMENT, size, first, n, 0, 0, 0) for size, (first, n) in documents.items()]
    found += [(GAP, size, first, n, 0, 0, 0) for size, own in gaps.items() for first, n in own]
    return pd.DataFrame(found, columns=[x.split()[0] for x in _RUNS.split(", ")])


def segments(runs: DataFrame, capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(length, first rank, documents, first sequence, offset, documents a sequence) of all documents, and the number of sequences.

    ``runs``: l, n, the number of documents by length, each from 1 to ``capacity``.
    """
    spark, sequences, found = runs.sparkSession, 0, []
    state = runs.select(F.lit(DOCUMENT).alias("kind"), F.col("l").cast("long").alias("size"), *[F.lit(0).cast("long").alias(c) for c in ("first", "sequence", "offset", "each")], F.col("n").cast("long").alias("n"))

    def by_ranges(state: DataFrame, ranges: int) -> DataFrame:
        start = sequences if ranges == 1 else None
        return state.groupBy(F.floor(F.col("size") * ranges / (capacity + 1)).alias("range")).applyInPandas(lambda own: swept(own, capacity, start), _RUNS)

    waiting = not state.isEmpty()
    while waiting:
        swept_ = by_ranges(state, RANGES) if found else state  # in the first round there are no gaps
        out = written(by_ranges(swept_, 1), "round")
        told = out.where(f"kind <> {GAP}").collect()  # what was found, some thousands in all rounds, and the lengths that wait
        sequences += sum(r.n for r in told if r.kind == OPENED)
        found += [(r.size, r.first, r.n, r.sequence, r.offset, r.each) for r in told if r.kind == SEGMENT]
        state, waiting = out.where(f"kind < {SEGMENT}"), any(r.kind == DOCUMENT for r in told)
    return found, sequences


def pack(items: DataFrame, keys: list[str], capacity: int, length: str = "length") -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset`` (long): about as few sequences of ``capacity`` as best fit decreasing makes.

    Every length is from 1 to ``capacity``; another one, or null, raises
    ValueError. ``keys`` order items of equal length; rows equal in all keys are
    interchangeable. An empty table gives an empty one. ``items`` is read more
    than once: give a written table. Where ``items`` has columns of the new
    names, the new ones get a ``_``.
    """
    spark = items.sparkSession
    size = column(items, length)
    seq, off, cell, rank, base = fresh(items, "sequence_id", "offset", "cell", "rank", "base")
    wrong, n = items.agg(F.count_if(size.isNull() | (size < 1) | (size > capacity)), F.count("*")).first()
    if wrong:
        raise ValueError(f"{wrong} lengths aren't from 1 to {capacity}")
    cells = max(64, -(-n // CELL_ROWS))
    items = items.withColumn(cell, F.pmod(F.xxhash64(*[column(items, k) for k in keys]), F.lit(cells)).cast("int"))
    counts = written(items.groupBy(size.alias("l"), F.col(cell).alias("c")).agg(F.count("*").alias("n")), "runs")
    found, _ = segments(counts.groupBy("l").agg(F.sum("n").alias("n")), capacity)
    before = Window.partitionBy("l").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("l", "c", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    inside = Window.partitionBy(size, F.col(cell)).orderBy(*[column(items, k) for k in keys])
    ranked = items.withColumn(rank, F.row_number().over(inside) - 1)
    ranked = ranked.join(shift, (column(ranked, length) == F.col("l")) & (F.col(cell) == F.col("c"))).withColumn(rank, F.col(rank) + F.col(base)).drop("l", "c", base, cell)
    table_ = spark.sparkContext.broadcast(np.array(found, np.int64).reshape(-1, 6))

    @F.pandas_udf("s long, o long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        own = table_.value[np.lexsort((table_.value[:, 1], table_.value[:, 0]))]
        wide = np.int64(1) << 44  # lengths and ranks in one sortable number
        at = np.searchsorted(own[:, 0] * wide + own[:, 1], lengths.to_numpy() * wide + ranks.to_numpy(), side="right") - 1
        _, first, _, sequence, offset, each = own[at].T
        inner = ranks.to_numpy() - first
        return pd.DataFrame({"s": sequence + inner // each, "o": offset + inner % each * lengths.to_numpy()})

    where = fresh(ranked, "where")[0]
    out = ranked.withColumn(where, place(column(ranked, length).cast("long"), F.col(rank)))
    return out.withColumns({seq: F.col(where)["s"], off: F.col(where)["o"]}).drop(where, rank)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """All documents, cut and packed; see ``tokenized_pieces`` and ``pack``.

    Rows with the same doc_id are documents of their own; a null doc_id stays null.
    """
    pieces = written(tokenized_pieces(docs, tokenizer, capacity, end, doc_id, text, with_ids), "pieces")
    return pack(pieces, ["doc_id", "piece", "ids_crc32"], capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None, capacity: int = 2048) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"), capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
