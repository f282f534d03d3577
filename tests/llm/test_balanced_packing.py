"""Operator 11."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from granary.llm import balanced_packing as B
from granary.llm.queries import QUERIES

BPE = public_tokenizers.path("byte_bpe_50k.json")


def one_by_one(lengths, capacity, linear):
    """Costs of the sequences when tails are dealt one at a time, as the method says, before any is cut; and what is left."""
    seqs = [[0, size, k] for k, size in enumerate(size for size, many in B.rooms(sum(lengths), capacity) for _ in range(many))]
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [s for s in seqs if s[1] >= n]
        if not fits:
            left.append(n)
            continue
        best = min(fits, key=lambda s: (s[0], s[1]))  # of equal costs the tightest
        best[0] += n * (linear + n)
        best[1] -= n
    return sorted(s[0] for s in seqs), sorted(left)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60), st.sampled_from([0, 3, 100]))
def test_runs_are_dealt_as_documents_one_by_one(lengths, linear):
    found = B.deal(dict(Counter(lengths)), 16, linear)
    whole = found[found[:, 3] == 0]
    whole = whole[whole[:, 4] == whole[:, 0]]
    costs, left = one_by_one(lengths, 16, linear)
    own = defaultdict(int)
    for source, _, n, _, length, sequence, _ in whole:
        for i in range(n):
            own[sequence + i] += length * (linear + length)
    assert sum(n for _, many in B.rooms(sum(lengths), 16) for n in [many]) == len(costs)
    assert sorted([*own.values(), *[0] * (len(costs) - len(own))]) == costs
    assert sorted(np.repeat(whole[:, 0], whole[:, 2]).tolist() + left) == sorted(lengths)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 50), max_size=12))
def test_every_token_lies_in_one_place_and_every_sequence_is_full(lengths):
    found = B.deal(lengths, 32)
    tokens, places = Counter(), defaultdict(list)
    for source, rank, n, start, length, sequence, offset in found.tolist():
        for i in range(n):
            tokens.update((source, rank + i, x) for x in range(start, start + length))
            places[sequence + i].append((offset, length))
    assert tokens == Counter((s, r, x) for s, n in lengths.items() for r in range(n) for x in range(s))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at & (at - 1) == 0
    full = sum(s * n for s, n in lengths.items()) // 32
    assert sum(sum(n for _, n in own) == 32 for own in places.values()) >= full


def test_runs_stay_few_however_many_documents():
    """A third of all documents empty, and ten million of them."""
    rng = np.random.default_rng(1)
    lengths = Counter(np.minimum(1024, 1 + rng.lognormal(5.5, 1.2, 100_000)).astype(int).tolist())
    lengths[1] += 50_000
    few, many = len(B.deal(lengths, 1024)), len(B.deal({k: 100 * n for k, n in lengths.items()}, 1024))
    assert many < 3 * few < 100_000


def checked(docs, rows, capacity, tokenizer=BPE):
    """Whether the pieces are those of the documents' ids, by the library."""
    own = Tokenizer.from_file(tokenizer)
    own.no_truncation()
    want = Counter()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, text in docs:
        want[i, len(own.encode(text or "", add_special_tokens=False).ids) + 1] += 1
    ids = defaultdict(list)
    for i, text in docs:
        ids[i].append(np.array([*own.encode(text or "", add_special_tokens=False).ids, 0], "<u4"))
    for i, pieces in by_doc.items():
        assert sum(p.length for p in pieces) == sum(map(len, ids[i]))
        for p in pieces:
            assert any(len(x) == p.doc_tokens and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in ids[i])
        if len(ids[i]) == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at
                at += p.length
    for own_ in by_seq.values():
        at = 0
        for offset, length in sorted(own_):
            assert offset == at and length > 0
            at += length
        assert at <= capacity and at & (at - 1) == 0
    assert set(by_doc) == set(ids)


def test_documents_of_all_kinds(spark):
    texts = ["", None, "a", "<|endoftext|> in it", "é漢字🙂 " * 40, "word " * 700, "two words", "two words", " ", "x" * 3000]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, "no id"), (3, "again 3"), (3, "again 3")]
    df = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, length int, sequence_id string").repartition(3)
    for capacity in (16, 128):
        found = B.pack_balanced(df, BPE, capacity, with_ids=True).collect()
        checked(docs, found, capacity)
        assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.cost == r.length * (B.LINEAR + r.length) for r in found)
    assert B.pack_balanced(df.limit(0), BPE, 16).count() == 0


def test_equal_documents_are_dealt_over_cells(spark, monkeypatch):
    monkeypatch.setattr(B, "CELL_ROWS", 3)
    docs = [(None, "same")] * 300 + [(7, None)] * 200
    found = B.pack_balanced(spark.createDataFrame(docs, "doc_id long, text string"), BPE, 8).collect()
    checked(docs, found, 8)
    assert len(found) >= 500


def test_costs_are_balanced(spark, data):
    rows = QUERIES["op11_balanced_packing"](spark, data).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    checked(docs, rows, 1024)
    cost = Counter()
    for r in rows:
        cost[r.sequence_id] += r.cost
    size = Counter()
    for r in rows:
        size[r.sequence_id] += r.length
    full = [c for s, c in cost.items() if size[s] == 1024]
    assert max(full) <= 1.2 * min(full)
    assert len(size) <= sum(size.values()) // 1024 + 10
    cut = {(r.doc_id, r.doc_tokens) for r in rows if r.length < min(r.doc_tokens, 1024) and r.length != r.doc_tokens % 1024}
    assert len(cut) < 0.15 * len(docs)


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
def test_rooms_hold_all_tokens(n):
    assert sum(size * many for size, many in B.rooms(n, 1024)) == n
