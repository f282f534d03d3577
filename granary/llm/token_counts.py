"""Token counts: prefix dynamic programming over a byte-level BPE.

A BPE encoding has the prefix property: the encoding of a prefix without its last
token is the encoding of the shorter prefix. So one pass suffices: the last token
of a prefix is the only token t that ends there and that the last token u before
it tolerates, which is when u and t, joined and merged again, give back u and t.
The pass stores the count at every prefix, one signed byte a code point (the
difference to the prefix before). Truncation and budget questions read the store.

States are shared: words with a common beginning walk the same states, and a word
seen before is looked up. Both tables are emptied at CACHE entries; that costs
time and changes no count.

Prefix counts are those of the tokenizer library for the prefix as a text of its
own, also where cutting changes how the text falls into words (white space before
a word, contractions, a special token's string that is cut).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, fresh, table

CACHE = 400_000
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: How byte-level BPE cuts a text into words.
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_ODD = regex.compile(rf"[{SPACE}][{SPACE}]|'(?:re|ve|ll)")
_BLANK = regex.compile(rf"[{SPACE}]+")
_COUNTERS: dict = {}


def _byte_of() -> dict[str, int]:
    """The bytes that byte-level BPE writes as printable characters: itself, or from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _byte_level(pre: dict | None) -> bool:
    return bool(pre) and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)


class PrefixCounter:
    """Counts for one tokenizers .json file with a byte-level BPE model; ValueError for another."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"].get("type") != "BPE" or not _byte_level(spec.get("pre_tokenizer")) or spec.get("normalizer") or spec["model"].get("ignore_merges"):
            raise ValueError(f"{path}: only byte-level BPE without a normalizer or a prefix space is supported")
        to_byte = _byte_of()
        raw = lambda s: bytes(to_byte[c] for c in s)
        special = [x["content"] for x in spec.get("added_tokens", ())]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.specials = tuple(special)
        vocab = spec["model"]["vocab"]
        self.ids = {raw(s): i for s, i in vocab.items() if s not in special}
        self.bytes = {i: s for s, i in self.ids.items()}
        self.ends = {s[-n:]: -1 for s in self.ids for n in range(1, len(s))} | self.ids  # a token's id; -1: only the end of a longer one
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(pairs)}
        self.joins: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.states: dict[bytes, tuple[int, int]] = {b"": (-1, 0)}
        self.words: dict[str, tuple[bytes, int]] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE of a few bytes."""
        out = [self.ids[data[i : i + 1]] for i in range(len(data))]
        while len(out) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(out, out[1:], strict=False)) if p in self.merges), default=None)
            if best is None:
                break
            i = best[1]
            out[i : i + 2] = [self.merges[out[i], out[i + 1]][1]]
        return out

    def tolerates(self, u: int, t: int) -> bool:
        """Whether token t may follow token u (u = -1: the beginning)."""
        found = self.merged(self.bytes[t]) == [t] if u < 0 else self.merged(self.bytes[u] + self.bytes[t]) == [u, t]
        if len(self.joins) > 4 * CACHE:
            self.joins.clear()
        self.joins[u << 20 | t] = found
        return found

    def counts(self, data: bytes) -> list[int]:
        """Tokens of data[:i] for each i from 1 on; data is one word."""
        ends, joins, n = self.ends.get, self.joins, len(data)
        shared = n <= 32
        states, last, out = self.states, [-1], [0]
        for i in range(1, n + 1):
            if shared and (state := states.get(data[:i])):
                t, c = state
            else:
                j = i
                while True:  # from the shortest token that ends here to the longest
                    j -= 1
                    if (t := ends(data[j:i])) >= 0:
                        fits = joins.get(last[j] << 20 | t)
                        if self.tolerates(last[j], t) if fits is None else fits:
                            break
                c = out[j] + 1
                if shared:
                    states[data[:i]] = t, c
            last.append(t)
            out.append(c)
        return out[1:]

    def word(self, word: str) -> tuple[bytes, int]:
        """The store of one word and its count."""
        if (found := self.words.get(word)) is None:
            data = word.encode()
            at = self.counts(data)
            if len(data) != len(word):
                at = [c for i, c in enumerate(at) if i + 1 == len(data) or data[i + 1] & 0xC0 != 0x80]
            steps = [b - a for a, b in zip([0, *at], at, strict=False)]
            narrow = -128 < min(steps) and max(steps) < 128
            found = bytes([x & 255 for x in steps]) if narrow else pack(np.array(steps)), at[-1]
            if len(self.words) >= CACHE or len(self.states) >= 2 * CACHE:
                self.forget()
            self.words[word] = found
        return found

    def prefixes(self, text: str) -> tuple[bytes, int]:
        """The store of a whole text and its count."""
        words, word = self.words, self.word
        if _ODD.search(text) or (self.special and self.special.search(text)):
            return self._odd(text)
        found = [words.get(x) or word(x) for x in _SPLIT.findall(text)]
        return b"".join([x[0] for x in found]), sum([x[1] for x in found])

    def _odd(self, text: str) -> tuple[bytes, int]:
        """As ``prefixes``, for texts in which a cut changes the words before it."""
        out, total, at = [], 0, 0
        n = lambda s: sum(self.word(x)[1] for x in _SPLIT.findall(s))
        specials = [*self.special.finditer(text)] if self.special else []
        for m in [*specials, None]:
            before, was, base = "", 0, total  # the last word, its count, the total before it
            for w in _SPLIT.findall(text[at : m.start() if m else len(text)]):
                values = np.cumsum(unpack(self.word(w)[0])) + total
                if before and _BLANK.fullmatch(before) and _BLANK.match(w):
                    values[0] = base + n(before + w[0])
                elif w in ("'re", "'ve", "'ll"):
                    values[1] = total + n("'") + n(w[1])
                out.append(values)
                before, was, base = w, self.word(w)[1], total
                total += was
            if m:
                out.append(np.array([base + n(before + m[0][:i]) for i in range(1, len(m[0]))] + [total + 1]))
                total, at = total + 1, m.end()
        return pack(np.diff(np.concatenate(out), prepend=0)), total


def pack(steps: np.ndarray) -> bytes:
    """One signed byte a step; -128 and four bytes more for a step beyond 127."""
    if not len(steps) or np.abs(steps).max() <= 127:
        return steps.astype(np.int8).tobytes()
    return b"".join(int(x).to_bytes(1, "little", signed=True) if -127 <= x <= 127 else b"\x80" + int(x).to_bytes(4, "little", signed=True) for x in steps)


def unpack(store: bytes) -> np.ndarray:
    if b"\x80" not in store:
        return np.frombuffer(store, np.int8).astype(np.int64)
    out, i = [], 0
    while i < len(store):
        wide = store[i] == 0x80
        out.append(int.from_bytes(store[i + wide : i + 1 + 4 * wide], "little", signed=True))
        i += 5 if wide else 1
    return np.array(out, np.int64)


def tokens_at(store: bytes, n_chars: int) -> int:
    """Tokens of the first ``n_chars`` code points."""
    return int(unpack(store)[:n_chars].sum())


def longest_within(store: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    fits = np.flatnonzero(np.cumsum(unpack(store)) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` and ``n_tokens`` (long) and ``prefix_counts`` (binary, the store).

    ``tokenizer`` is the path of a tokenizers .json file on every machine. A null
    text counts as empty: no bytes, no tokens, an empty store. Texts of any
    length take time and memory in proportion. Rows are counted one by one:
    repeated rows get equal counts, an empty table an empty result. Where
    ``docs`` has columns of these names, the new ones get a ``_``.
    """
    names = fresh(docs, "n_bytes", "n_tokens", "prefix_counts")
    whole = fresh(docs, "counted")[0]

    @F.pandas_udf("n_bytes long, n_tokens long, store binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = counter(tokenizer)
        for texts in batches:
            found = [own.prefixes(x) if x else (b"", 0) for x in texts]
            yield pd.DataFrame({"n_bytes": [len(x.encode()) if x else 0 for x in texts], "n_tokens": [n for _, n in found], "store": [s for s, _ in found]})

    c = F.col(f"`{whole}`")
    out = docs.withColumn(whole, run(column(docs, text)))
    return out.withColumns({names[0]: c["n_bytes"], names[1]: c["n_tokens"], names[2]: c["store"]}).drop(whole)


def within_budget(counted: DataFrame, budget: int, store: str = "prefix_counts") -> DataFrame:
    """``counted`` with ``fits_chars`` (code points of the longest prefix within ``budget`` tokens), read from the store."""

    @F.pandas_udf("long")
    def run(stores: pd.Series) -> pd.Series:
        return pd.Series([longest_within(bytes(s), budget) if s is not None else 0 for s in stores], dtype="int64")

    return counted.withColumn(fresh(counted, "fits_chars")[0], run(column(counted, store)))


def op3_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None, limit: int = 512) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
