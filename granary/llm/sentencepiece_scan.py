"""SentencePiece encoding and decoding: a max-plus parallel scan over giant documents.

An encoding is a best path of pieces through the text. In a unigram model a step
costs its piece's score. In a BPE model an encoding is the only sequence of pieces
in which each tolerates the next: merged anew, the two give back themselves; so a
step costs nothing if tolerated and minus infinity if not. Best paths can be found
piecewise. A giant document is split into chunks of CHUNK characters, a row each. A
boundary's states are the pieces that could lie across or end at it.

1. Each chunk yields a matrix of the best path from each state at its left boundary
   to each at its right one, under (max, +).
2. The matrices' products are associative: FAN neighbours at a time are combined,
   then FAN of these, until a document is one row, which says where its best path ends.
3. Back down this tree, each row knows its first and last state and finds those of
   the boundaries between its parts.
4. Each chunk is traced back by itself between its two states.

Inside a chunk only the stretches up to its first and from its last word beginning
need this: no piece goes on over a word beginning, so what lies between is encoded
as it is by the library. A document of at most CHUNK characters is one chunk
without boundaries, and is encoded by the library in one call.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, fresh, table, written
from .graph import grouped

CHUNK, FAN = 1 << 15, 16
MINUS = np.float32(-np.inf)
SPACE = "▁"
_MODELS: dict = {}
State = tuple[int, int]  # a piece's beginning and end, as positions of the document


class Pieces:
    """A SentencePiece BPE model whose normalizer is the identity, with a space put before the text."""


    def __init__(self, path: str, spec):  # noqa: ANN001
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == 1}
        self.scores = {p.piece: p.score for p in spec.pieces if p.type == 1}
        self.names = [p.piece for p in spec.pieces]
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.longest = max(map(len, self.ids))
        self.worded = not any(SPACE in p.lstrip(SPACE) for p in self.ids)  # whether a space after something else begins a word
        self.joins: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Plain BPE: the best-scored neighbours that make a piece join, the leftmost of equals first."""
        out = list(text)
        while len(out) > 1:
            best = max(((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(out, out[1:], strict=False)) if a + b in self.scores), default=None)
            if best is None:
                break
            i = -best[1]
            out[i : i + 2] = [out[i] + out[i + 1]]
        return out

    def tolerates(self, u: str, t: str) -> bool:
        """Whether piece t may follow piece u (empty: the beginning)."""
        if (found := self.joins.get((u, t))) is None:
            if len(self.joins) > 500_000:
                self.joins.clear()
            found = self.joins[u, t] = self.merged(u + t) == ([u, t] if u else [t])
        return found

    def piece_ids(self, piece: str) -> list[int]:
        return [self.ids[piece]] if piece in self.ids else [self.byte[b] for b in piece.encode()]

    def paths(self, text: str, lo: int, hi: int, entries: list[tuple[str, int]], beyond: int) -> dict[int, list[tuple[int, int, int]]]:
        """Pieces that paths from ``entries`` (the piece before, the position where it ends) reach.

        By the position of their end: (beginning, set of entries as bits, place of
        the piece before in the list of its end). Pieces begin from ``lo`` on and
        before ``hi``, and end at ``beyond`` at the latest. Beginning -1 - k stands
        for entry k itself.
        """
        live: dict[int, list[tuple[int, int, int]]] = {}
        for k, (_, end) in enumerate(entries):
            live.setdefault(end, []).append((-1 - k, 1 << k, -1))
        for at in range(lo, hi):
            if at not in live:
                continue
            before = [(entries[-1 - s][0] if s < 0 else text[s:at], mask) for s, mask, _ in live[at]]
            for size in range(1, min(self.longest, beyond - at) + 1):
                piece = text[at : at + size]
                if size > 1 and piece not in self.ids:
                    continue
                for k, (u, mask) in enumerate(before):
                    if self.tolerates(u, piece):
                        live.setdefault(at + size, []).append((at, mask, k))
        return live

    def trace(self, text: str, live: dict[int, list[tuple[int, int, int]]], end: int, start: int | None = None) -> list[str]:
        """Pieces of the one path that ends at ``end`` (with a piece that begins at ``start``)."""
        out: list[str] = []
        found = [k for k, x in enumerate(live.get(end, ())) if start is None or x[0] == start]
        if len(found) != 1:
            raise ValueError("the path isn't unique")
        k = found[0]
        while True:
            begin, _, before = live[end][k]
            if begin < 0:
                return out[::-1]
            out.append(text[begin:end])
            end, k = begin, before


    def route(self, text: str, lo: int, hi: int, entry: tuple[str, int], beyond: int, end: int, start: int | None = None) -> list[str]:
        """Pieces of the best path from ``entry`` to ``end`` (with a piece that begins at ``start``)."""
        return self.trace(text, self.paths(text, lo, hi, [entry], beyond), end, start)

    def packed(self, matrix: np.ndarray) -> bytes:
        return (matrix == 0).tobytes()

    def unpacked(self, matrix: bytes, left: int) -> np.ndarray:
        return np.where(np.frombuffer(matrix, bool).reshape(left, -1), np.float32(0), MINUS)

    def chosen(self, scores: np.ndarray) -> int:
        """The state of the one path."""
        found = np.flatnonzero(scores == 0)
        if len(found) != 1:
            raise ValueError("the path isn't unique")
        return int(found[0])


class Unigram(Pieces):
    """A SentencePiece unigram model, likewise: the best path has the largest sum of scores.

    Of equally good paths one is taken, within a chunk that of the library. Sums are
    double; the library's are single, so paths that differ by less than their
    rounding may differ.
    """


    def __init__(self, path: str, spec):  # noqa: ANN001
        super().__init__(path, spec)
        self.unknown = min(self.scores.values()) - 10.0  # fixed value: the library's penalty

    def step(self, piece: str) -> float | None:
        found = self.scores.get(piece)
        return self.unknown if found is None and len(piece) == 1 else found

    def sums(self, text: str, lo: int, hi: int, ends: list[int], beyond: int) -> tuple[np.ndarray, list[int]]:
        """Best sums at each position from ``lo`` on, from each entry (by its end), and where the best last piece begins (of one entry)."""
        best, back = np.full((beyond - lo + 1, len(ends)), -np.inf), [-1] * (beyond - lo + 1)
        best[np.array(ends) - lo, np.arange(len(ends))] = 0
        for at in range(lo, hi):
            row = best[at - lo]
            if row.max() == -np.inf:
                continue
            for size in range(1, min(self.longest, beyond - at) + 1):
                if (score := self.step(text[at : at + size])) is None:
                    continue
                to, new = at + size - lo, row + score
                if (new > best[to]).any():
                    best[to], back[to] = np.maximum(best[to], new), at
        return best, back

    def transfers(self, chunk: Chunk) -> np.ndarray:
        w, o = chunk.window, chunk.offset
        ends, lo = [e - o for _, e in chunk.left], chunk.lo

        def into(best: np.ndarray, start: int) -> np.ndarray:
            return np.stack([best[s - o - start] + self.step(w[s - o : e - o]) for s, e in chunk.right], 1)

        if chunk.first is None or max(ends) > chunk.first:
            return into(self.sums(w, lo, chunk.hi, ends, chunk.end)[0], lo)
        head = self.sums(w, lo, chunk.first, ends, chunk.first)[0][-1]
        tail = into(self.sums(w, chunk.last, chunk.hi, [chunk.last], chunk.end)[0], chunk.last)
        return head[:, None] + tail  # what lies between is the same for all

    def route(self, text: str, lo: int, hi: int, entry: tuple[str, int], beyond: int, end: int, start: int | None = None) -> list[str]:
        _, back = self.sums(text, lo, hi, [entry[1]], beyond)
        out, at = [], end
        if start is not None:
            out, at = [text[start:end]], start
        while at > entry[1]:
            out.append(text[back[at - lo] : at])
            at = back[at - lo]
        return out[::-1]

    def packed(self, matrix: np.ndarray) -> bytes:
        return matrix.astype("<f8").tobytes()

    def unpacked(self, matrix: bytes, left: int) -> np.ndarray:
        return np.frombuffer(matrix, "<f8").reshape(left, -1)

    def chosen(self, scores: np.ndarray) -> int:
        return int(np.argmax(scores))


def model(path: str) -> Pieces:
    """The model of a file; ValueError for one that chunks can't express."""
    if path not in _MODELS:
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        n, t = spec.normalizer_spec, spec.trainer_spec
        if t.model_type not in (1, 2) or n.name != "identity" or not n.add_dummy_prefix or n.remove_extra_whitespaces or not t.byte_fallback or any(p.type in (4, 5) for p in spec.pieces):
            raise ValueError(f"{path}: only BPE and unigram models with byte fallback, an identity normalizer and plain pieces are supported")
        _MODELS[path] = (Unigram if t.model_type == 1 else Pieces)(path, spec)
    return _MODELS[path]


def normalized(text: str) -> str:
    """What the pieces cover: spaces as U+2581, one before the text; the empty text stays empty."""
    return (SPACE + text.replace(" ", SPACE)) if text else ""


def boundary_states(own: Pieces, text: str, at: int, n: int) -> list[State]:
    """Pieces that could cover the last character before ``at`` in a text of n characters."""
    return [(s, e) for s in range(max(0, at - own.longest), at) for e in range(at, min(n, s + own.longest) + 1) if e - s == 1 or text[s:e] in own.ids]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two transfer matrices under (max, +)."""
    if not a.shape[1]:
        return np.full((a.shape[0], b.shape[1]), MINUS)
    return (a[:, :, None] + b[None, :, :]).max(1)


class Chunk:
    """Characters lo..hi of a normalized document of n, with a margin of the longest piece on either side."""

    def __init__(self, own: Pieces, window: str, offset: int, lo: int, hi: int, n: int):
        self.own, self.window, self.offset, self.n = own, window, offset, n
        self.lo, self.hi = lo - offset, hi - offset  # in the window
        end = min(len(window), self.hi + own.longest)
        self.left = [(s + offset, e + offset) for s, e in boundary_states(own, window[:end], self.lo, n - offset)] if lo else [(-1, 0)]
        self.right = [(s + offset, e + offset) for s, e in boundary_states(own, window[:end], self.hi, n - offset)] if hi < n else [(s, n) for s in range(max(0, n - own.longest), n) if n - s == 1 or window[s - offset :] in own.ids]
        self.end = end
        words = [i for i in range(self.lo + 1, self.hi) if window[i] == SPACE and window[i - 1] != SPACE] if own.worded else []
        self.first, self.last = (words[0], words[-1]) if words else (None, None)

    def entries(self, only: State | None = None) -> list[tuple[str, int]]:
        states = self.left if only is None else [only]
        return [(self.window[s - self.offset : e - self.offset] if s >= 0 else "", e - self.offset) for s, e in states]

    def transfers(self) -> np.ndarray:
        """0 from each left state to each right state that a path joins, else minus infinity."""
        out = np.full((len(self.left), len(self.right)), MINUS)

        def fill(live: dict, rows: np.ndarray | None) -> None:
            for j, (s, e) in enumerate(self.right):
                for begin, mask, _ in live.get(e - self.offset, ()):
                    if begin == s - self.offset:
                        for i in range(len(self.left)):
                            if (mask >> i & 1) if rows is None else rows[i]:
                                out[i, j] = 0

        own, w = self.own, self.window
        if isinstance(own, Unigram):
            return own.transfers(self)
        if self.first is None:
            fill(own.paths(w, self.lo, self.hi, self.entries(), self.end), None)
        else:
            a = own.paths(w, self.lo, self.first, self.entries(), self.first)
            mask = 0
            for _, m, _ in a.get(self.first, ()):
                mask |= m
            rows = np.array([bool(mask >> i & 1) for i in range(len(self.left))])
            fill(own.paths(w, self.last, self.hi, [("", self.last)], self.end), rows)
        return out

    def ids(self, left: State, right: State) -> tuple[list[int], str]:
        """The chunk's ids, after the left state's piece up to and with the right one's, and the text they cover."""
        own, w, o = self.own, self.window, self.offset
        entry = self.entries(left)
        begin, end = entry[0][1], right[1] - o
        if self.first is None or begin >= self.last or begin > self.first:
            parts = own.route(w, begin, self.hi, entry[0], self.end, end, right[0] - o) if end > begin else []
            return [i for p in parts for i in own.piece_ids(p)], w[begin:end]
        head = own.route(w, begin, self.first, entry[0], self.first, self.first)
        middle = own.library.encode(w[self.first + 1 : self.last].replace(SPACE, " ")) if self.last > self.first else []
        tail = own.route(w, self.last, self.hi, ("", self.last), self.end, end, right[0] - o)
        return [i for p in head for i in own.piece_ids(p)] + list(middle) + [i for p in tail for i in own.piece_ids(p)], w[begin:end]


def product(matrices: list[np.ndarray]) -> np.ndarray:
    out = matrices[0]
    for m in matrices[1:]:
        out = combine(out, m)
    return out


def between(own: Pieces, matrices: list[np.ndarray], first: int, last: int) -> list[int]:
    """The state at the end of each matrix, on the best path from state ``first`` of the first to ``last`` of the last."""
    ahead = [matrices[0][first]]
    for m in matrices[1:-1]:
        ahead.append(combine(ahead[-1][None], m)[0])
    out = [last]
    for k in range(len(matrices) - 1, 0, -1):
        out.append(own.chosen(ahead[k - 1] + matrices[k][:, out[-1]]))
    return out[::-1]


def chunks_of(own: Pieces, text: str, size: int) -> list[Chunk]:
    """Chunks of a whole text (for a document that is in one place)."""
    s, n, m = normalized(text), len(normalized(text)), own.longest
    bounds = [*range(0, n, size), n]
    if len(bounds) > 2 and bounds[-1] - bounds[-2] < 2 * m:
        del bounds[-2]
    return [Chunk(own, s[max(0, a - m) : min(n, b + m)], max(0, a - m), a, b, n) for a, b in zip(bounds, bounds[1:], strict=False)]


def encode_by_scan(own: Pieces, text: str, size: int = CHUNK) -> list[int]:
    """The ids of one text by chunks, on one machine; the distributed form is ``encode``."""
    chunks = chunks_of(own, text, size)
    if not chunks:
        return []
    matrices = [c.transfers() for c in chunks]
    at = between(own, matrices, 0, own.chosen(product(matrices)[0]))
    out: list[int] = []
    for k, c in enumerate(chunks):
        out += c.ids(chunks[k - 1].right[at[k - 1]] if k else c.left[0], c.right[at[k]])[0]
    return out


def pieces_text(own: Pieces, ids: list[int]) -> str:
    """The normalized text of ids; bytes that make no text become U+FFFD."""
    out, held = [], bytearray()
    for i in ids:
        if i in own.byte_of:
            held.append(own.byte_of[i])
        else:
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            out.append(own.names[i])
    return "".join(out) + held.decode("utf-8", "replace")


def decode_ids(own: Pieces, ids: list[int]) -> str:
    return own.library.decode([int(i) for i in ids])


def crc_shift(crc: int, n: int) -> int:
    """What a CRC-32 becomes when n bytes of another text follow (to be xored with theirs)."""
    poly, power, x = 0xEDB88320, 0x00800000, 0x80000000  # power: x^8, x: 1, in reflected form

    def times(a: int, b: int) -> int:
        out = 0
        for i in range(31, -1, -1):
            if a >> i & 1:
                out ^= b
            b = (b >> 1) ^ (poly if b & 1 else 0)
        return out

    while n:
        if n & 1:
            x = times(x, power)
        power = times(power, power)
        n >>= 1
    return times(x, crc)


SCHEMA = "hash binary, chunk int, n_tokens long, ids binary, ids_crc32 long, round_trip boolean"


def _encoded(docs: DataFrame, tokenizer: str, doc_id: str, text: str, size: int, with_ids: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of the documents of one chunk; (doc_id, hash) of the giants; rows (SCHEMA) of the giants' distinct texts."""
    own = docs.select(column(docs, doc_id).cast("long").alias("doc_id"), F.coalesce(column(docs, text), F.lit("")).alias("t"))
    long = F.char_length("t") > size

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = model(tokenizer)
        for b in batches:
            texts = list(b["t"])
            found = pieces.library.encode(texts, num_threads=1)
            raw = [np.array(x, "<u4").tobytes() for x in found]
            back = pieces.library.decode(found)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "chunk": 0, "n_tokens": [len(x) for x in found], "ids": raw if with_ids else None, "ids_crc32": [zlib.crc32(x) for x in raw], "round_trip": [x == y.replace(SPACE, " ") for x, y in zip(back, texts, strict=True)]})

    plain = own.where(~long).mapInPandas(whole, "doc_id long, chunk int, n_tokens long, ids binary, ids_crc32 long, round_trip boolean")
    giants = own.where(long).withColumn("hash", F.unhex(F.sha2("t", 256)))

    longest = model(tokenizer).longest
    distinct = giants.groupBy("hash").agg(F.first("t").alias("t"))
    covered, n = F.concat(F.lit(SPACE), F.translate("t", " ", SPACE)), F.char_length("t") + 1
    many = F.ceil(n / size).cast("int")
    many = F.when((many > 1) & (n - (many - 1) * size < 2 * longest), many - 1).otherwise(many)  # as chunks_of

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The windows of each text, some at a time: one pass over it, however many chunks it has."""
        for b in batches:
            for h, s, n_, many_ in zip(b["hash"], b["s"], b["n"], b["many"], strict=True):
                for i in range(0, int(many_), 64):
                    rows = []
                    for k in range(i, min(i + 64, int(many_))):
                        lo, hi = k * size, n_ if k == many_ - 1 else (k + 1) * size
                        at, to = max(lo - longest, 0), min(hi + longest, n_)
                        rows.append((h, k, at, lo, hi, n_, s[at:to]))
                    yield pd.DataFrame(rows, columns=["hash", "chunk", "at", "lo", "hi", "n", "window"])

    windows = distinct.select("hash", covered.alias("s"), n.alias("n"), many.alias("many"))
    windows = windows.mapInPandas(cut, "hash binary, chunk int, at long, lo long, hi long, n long, window string")

    def transfer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = model(tokenizer)
        for b in batches:
            for i in range(0, len(b), 64):
                part = b.iloc[i : i + 64]
                found = [Chunk(pieces, *r).transfers() for r in part[["window", "at", "lo", "hi", "n"]].itertuples(index=False, name=None)]
                yield part.assign(left=[m.shape[0] for m in found], matrix=[pieces.packed(m) for m in found])

    windows = windows.repartition("hash", "chunk")  # a document's chunks go to all tasks
    chunks = written(windows.mapInPandas(transfer, "hash binary, chunk int, at long, lo long, hi long, n long, window string, left int, matrix binary"), "chunks")

    def up(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        pieces, rows = model(tokenizer), []
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            own_ = frame.iloc[s:e]
            out = product([pieces.unpacked(m, k) for m, k in zip(own_["matrix"], own_["left"], strict=True)])
            rows.append((own_["hash"].iloc[0], own_["group"].iloc[0], out.shape[0], pieces.packed(out)))
        return pd.DataFrame(rows, columns=["hash", "i", "left", "matrix"])

    def down(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        pieces, parts = model(tokenizer), []
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            own_ = frame.iloc[s:e]
            first = int(own_["from"].iloc[0])
            at = between(pieces, [pieces.unpacked(m, k) for m, k in zip(own_["matrix"], own_["left"], strict=True)], first, int(own_["to"].iloc[0]))
            parts.append(pd.DataFrame({"hash": own_["hash"], "i": own_["i"], "from": [first, *at[:-1]], "to": at}))
        return pd.concat(parts, ignore_index=True)

    def end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = model(tokenizer)
        for b in batches:
            yield pd.DataFrame({"hash": b["hash"], "i": b["i"], "from": 0, "to": [pieces.chosen(pieces.unpacked(m, k)[0]) for m, k in zip(b["matrix"], b["left"], strict=True)]})

    tree = [chunks.select("hash", F.col("chunk").alias("i"), "left", "matrix")]
    top = chunks.agg(F.max("chunk")).first()[0] or 0
    group = (F.col("i") / FAN).cast("int").alias("group")
    while top > 0:
        tree.append(written(grouped(tree[-1].select("*", group), ["hash", "group"], up, "hash binary, i int, left int, matrix binary", ("i",)), "products"))
        top //= FAN
    states = tree[-1].mapInPandas(end, "hash binary, i int, from int, to int")
    for level in tree[-2::-1]:
        above = states.withColumnRenamed("i", "group")
        states = grouped(level.select("*", group).join(above, ["hash", "group"]), ["hash", "group"], down, "hash binary, i int, from int, to int", ("i",))
        states = written(states, "states")
    states = states.withColumnRenamed("i", "chunk")

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = model(tokenizer)
        for b in batches:
            rows = []
            for h, k, at, lo, hi, n, window, left, right in zip(*(b[c] for c in ("hash", "chunk", "at", "lo", "hi", "n", "window", "from", "to")), strict=True):
                c = Chunk(pieces, window, int(at), int(lo), int(hi), int(n))
                ids, covered = c.ids(c.left[left], c.right[right])
                raw = np.array(ids, "<u4").tobytes()
                rows.append((h, k, len(ids), raw if with_ids else None, zlib.crc32(raw), pieces_text(pieces, ids) == covered))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    traced = written(chunks.drop("matrix", "left").join(states, ["hash", "chunk"]).mapInPandas(trace, SCHEMA), "traced")
    return plain, giants.select("doc_id", "hash"), traced


def encode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = CHUNK) -> DataFrame:
    """Rows (doc_id, chunk, n_tokens, ids, ids_crc32, round_trip): the ids of each document, in chunks from 0.

    ``ids`` (little-endian 32-bit integers) of a document's chunks, one after the
    other, are the library's for its text. ``round_trip`` says that they decode to
    the text they cover (U+2581 counts as a space, which the library makes of it). A null text is empty: one chunk of no ids. Rows that
    repeat a doc_id are documents of their own, with rows of their own; a null
    doc_id stays null. An empty table gives an empty one. Extra columns don't matter.
    """
    plain, giants, traced = _encoded(docs, tokenizer, doc_id, text, size, True)
    return plain.unionByName(giants.join(traced, "hash").drop("hash"))


def digests(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = CHUNK) -> DataFrame:
    """A row for each document: doc_id, n_tokens, n_chunks, ids_crc32 (of all its ids) and round_trip; see ``encode``."""
    plain, giants, traced = _encoded(docs, tokenizer, doc_id, text, size, False)

    def fold(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        rows = []
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            own = frame.iloc[s:e].sort_values("chunk")
            crc = 0
            for n, x in zip(own["n_tokens"], own["ids_crc32"], strict=True):
                crc = crc_shift(crc, 4 * int(n)) ^ int(x)
            rows.append((own["hash"].iloc[0], int(own["n_tokens"].sum()), len(own), crc, bool(own["round_trip"].all())))
        return pd.DataFrame(rows, columns=["hash", "n_tokens", "n_chunks", "ids_crc32", "round_trip"])

    folded = grouped(traced.select("hash", "chunk", "n_tokens", "ids_crc32", "round_trip"), ["hash"], fold, "hash binary, n_tokens long, n_chunks long, ids_crc32 long, round_trip boolean")
    columns = ["doc_id", "n_tokens", "n_chunks", "ids_crc32", "round_trip"]
    return plain.withColumn("n_chunks", F.lit(1).cast("long")).select(*columns).union(giants.join(folded, "hash").select(*columns))


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the library's text of the ids of each row (null for null). A later chunk's text lacks no space that begins it."""

    @F.pandas_udf("string")
    def run(rows: pd.Series, later: pd.Series) -> pd.Series:
        own = model(tokenizer)
        out = []
        for x, k in zip(rows, later, strict=True):
            found = None if x is None else np.frombuffer(x, "<u4").tolist()
            out.append(None if found is None else pieces_text(own, found).replace(SPACE, " ") if k else decode_ids(own, found))
        return pd.Series(out, dtype=object)

    chunk = F.col("chunk") > 0 if "chunk" in encoded.columns else F.lit(False)
    return encoded.withColumn(fresh(encoded, "decoded")[0], run(column(encoded, ids), chunk))


def op9_sentencepiece(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("piece_bpe_32k.model"))
