"""Operators on many rows: 5, 6, 8, 9 and the pipeline."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import embedding_dedup, graph, ngram_join, packing, sentencepiece_scan
from granary.llm.common import written
from granary.llm.queries import QUERIES

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def union_find(n, links):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(300, 400)]
    edges = written(spark.createDataFrame(links, "a long, b long"), "edges")
    want = union_find(401, links)
    found = {r.node: r.root for r in graph.components(edges).collect()}
    assert all(found.get(i, i) == want[i] for i in range(401))
    assert graph.components(edges.limit(0)).count() == 0


class Steps(graph.Relation):
    """Numbers, near if they are at most ``reach`` apart."""

    def __init__(self, reach):
        self.reach = reach

    def read(self, frame):
        return np.frombuffer(b"".join(frame["x"]), "<i8")

    def space(self, items, s, e):
        from types import SimpleNamespace

        own, reach = items[s:e], self.reach
        return SimpleNamespace(near=lambda a, b: np.abs(own[a][:, None] - own[b][None, :]) <= reach, close=lambda i, b: np.abs(own[b] - own[i]) <= reach / 2)


@pytest.mark.parametrize(("reach", "count"), [(40, True), (40, False), (3, True), (3, False), (100_000, True), (100_000, False)])
def test_large_groups_lose_no_link(spark, monkeypatch, reach, count):
    """A split group's links and components are those of brute force, whether nearly all or few rows settle at the pivots."""
    monkeypatch.setattr(graph, "LEAST", 60)
    monkeypatch.setattr(graph, "MOST", 150)
    rng = np.random.default_rng(reach)
    value = np.r_[rng.integers(0, 2500, 700), rng.integers(0, 2500, 30), 10_000]
    group = np.r_[np.zeros(700, int), np.ones(30, int), 2]
    copies = rng.integers(1, 4, len(value))
    rows = [(int(g), i.to_bytes(4, "big"), int(n), int(v).to_bytes(8, "little")) for i, (g, n, v) in enumerate(zip(group, copies, value, strict=True))]
    df = written(spark.createDataFrame(rows, "g long, key binary, n long, x binary"), "rows")
    sizes = df.groupBy("g").agg(F.count("*").alias("rows_"), F.sum(F.octet_length("x")).alias("bytes_"))
    found = written(graph.linked(df, ["g"], ["x"], Steps(reach), sizes, count), "found")
    near = (np.abs(value[:, None] - value[None, :]) <= reach) & (group[:, None] == group[None, :]) & ~np.eye(len(value), dtype=bool)
    want = union_find(len(value), [(a, b) for a, b in zip(*np.nonzero(near), strict=True)])
    classes = df.select("key", F.col("n"), F.col("key").alias("rep"))
    settled = {int.from_bytes(r.key, "big"): (r.n_links, int.from_bytes(r.component_id, "big")) for r in graph.settle(classes, found).collect()}
    assert [settled[i][1] for i in range(len(value))] == want
    if count:
        assert [settled[i][0] for i in range(len(value))] == (near @ copies + copies - 1).tolist()


def test_a_close_group_meets_in_few_rows(spark, monkeypatch):
    """Rows given to a task beyond the first are in proportion to the group where copies are close."""
    monkeypatch.setattr(graph, "LEAST", 50)
    monkeypatch.setattr(graph, "MOST", 100)
    given = {}
    for n in (1000, 4000):
        df = written(spark.range(n).select(F.lit(0).alias("g"), F.unhex(F.hex("id")).alias("key"), F.lit(1).cast("long").alias("n"), F.unhex(F.lit("00" * 8)).alias("x")), "rows")
        sizes = df.groupBy("g").agg(F.count("*").alias("rows_"), F.sum(F.octet_length("x")).alias("bytes_"))
        given[n] = graph.linked(df, ["g"], ["x"], Steps(1), sizes, True).count()
    assert given[4000] <= 4.1 * given[1000]


# 5: embeddings


def vectors(seed=0, n=400, dim=32):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for i in range(0, n // 2, 4):  # near copies at many distances
        x[i + 1] = x[i] * 3
        x[i + 2] = x[i] + rng.standard_normal(dim) * 0.05 * np.linalg.norm(x[i]) / np.sqrt(dim) * rng.integers(1, 9)
    x[300:360] = x[300] + rng.standard_normal((60, dim)) * 0.02
    return x


def test_links_are_those_of_brute_force(spark):
    x = vectors()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    rows = spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, n_links int")
    found = sorted(map(tuple, embedding_dedup.near_duplicates(rows).collect()))
    want = union_find(len(x), [(a, b) for a, b in zip(*np.nonzero(near), strict=True)])
    links = sum(r[1] for r in found)
    assert links <= near.sum() - len(x) and links >= 0.99 * (near.sum() - len(x))
    assert np.mean([r[2] == w for r, w in zip(found, want, strict=True)]) > 0.97 and all(r[3] == (r[0] == r[2]) for r in found)


def test_estimates_have_no_bias_and_keep_their_bounds():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = embedding_dedup.decode(*embedding_dedup.encode(x), 64)
    off = ((a @ b.T + b @ a.T) / 2 - x @ x.T)[~np.eye(300, dtype=bool)]
    assert abs(off.mean()) < 0.002 and off.std() < 0.06
    f = embedding_dedup.encode(x)[1]
    assert embedding_dedup.may_reach(a, b, f, 0.0)[x @ x.T >= 0.05].mean() > 0.9999


def test_vectors_of_any_kind(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, []), (9, [1.0]), (None, [1.0, 0.0]), (10, [1.0, -0.0])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, key string")
    found = sorted(map(tuple, embedding_dedup.near_duplicates(frame).collect()), key=str)
    assert found == sorted([(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (10, 3, 1, False), *((i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)), (None, 0, None, False)], key=str)
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_one_hot_group_of_near_copies(spark):
    x = np.ones(16) + np.random.default_rng(0).standard_normal((600, 16)) * 0.01
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = embedding_dedup.near_duplicates(rows).groupBy("component_id", "n_links").count().collect()
    assert [tuple(r) for r in found] == [(0, 599, 600)]


# 6: packing


def brute_plan(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= n]
        if fits:
            i = min(fits, key=lambda k: gaps[k])
            gaps[i] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def rounds(counts, capacity):
    """The operator's rounds without Spark: segments and the number of sequences."""
    state, found, sequences, ranges = [(packing.DOCUMENT, l, 0, n, 0, 0, 0) for l, n in counts.items()], [], 0, 1
    names = [x.split()[0] for x in packing._RUNS.split(", ")]
    while any(x[0] == packing.DOCUMENT for x in state):
        by = defaultdict(list)
        for x in state:
            by[x[1] * ranges // (capacity + 1)].append(x)
        out = [tuple(r) for own in by.values() for r in packing.swept(pd.DataFrame(own, columns=names), capacity, sequences if ranges == 1 else None).itertuples(index=False)]
        sequences += sum(x[3] for x in out if x[0] == packing.OPENED)
        found += [x[1:] for x in out if x[0] == packing.SEGMENT]
        state, ranges = [x for x in out if x[0] < packing.SEGMENT], packing.RANGES if ranges == 1 else 1
    return found, sequences


@settings(deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_rounds_need_hardly_more_sequences_than_best_fit_decreasing(lengths):
    counts = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    found, n = rounds(counts, 50)
    assert n <= max(brute_plan(lengths, 50) * 1.05, brute_plan(lengths, 50) + 1)
    room, ranks = defaultdict(int), defaultdict(list)
    for length, rank, docs, first, offset, each in sorted(found, key=lambda x: x[4]):
        ranks[length] += range(rank, rank + docs)
        for i in range(docs):
            assert room[first + i // each] == offset + i % each * length
            room[first + i // each] += length
    assert all(sorted(x) == list(range(counts[k])) for k, x in ranks.items()) and len(ranks) == len(counts)
    assert max(room.values(), default=0) <= 50 and len(room) == n and sum(room.values()) == sum(lengths)


def test_the_tables_take_as_few_sequences_as_best_fit_decreasing(spark, data):
    found = QUERIES["op6_best_fit_packing"](spark, data).collect()
    assert gapless(found, 2048) == brute_plan([r.length for r in found], 2048)


def gapless(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_documents_are_cut_and_packed(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    texts = [None, "", "hello world <|endoftext|> x", "word " * 100, "word " * 100, "wörd" * 30]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1)], "doc_id long, text string, length int")
    found = packing.pack_documents(rows, BPE, 64, with_ids=True).collect()
    assert gapless(found, 64) <= brute_plan([r.length for r in found], 64)
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted((r.piece, r.start, r.length, r.ids, r.ids_crc32) for r in found if r.doc_id == i)[:: 2 if i == 3 else 1]
        assert np.frombuffer(b"".join(r[3] for r in own), "<u4").tolist() == ids and all(r[4] == zlib.crc32(r[3]) for r in own)
        assert [r[1] for r in own] == list(np.cumsum([0, *(r[2] for r in own)])[:-1]) and all(r[2] == 64 for r in own[1:])
    assert packing.pack_documents(rows.limit(0), BPE, 64).count() == 0


def test_a_hot_length_and_wrong_lengths(spark):
    items = written(spark.range(5000).select("id", F.when(F.col("id") < 4000, 7).otherwise(F.col("id") % 30 + 1).alias("length"), F.lit(1).alias("rank")), "items")
    found = packing.pack(items, ["id"], 30).collect()
    assert len(found) == 5000 and gapless(found, 30) == brute_plan([r.length for r in found], 30)
    for bad in (0, 31, None):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(1, bad)], "id int, length int"), ["id"], 30)


def test_encoders_agree_with_the_library():
    from tokenizers import Tokenizer

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        lib, own = Tokenizer.from_file(path), packing.encoder(path)
        for text in ("Hello, it's 1,234 <|endoftext|> é中\n\n  x\t\t", "", "x" * 5000, "\u2028a\x85b\x1cc"):
            assert own(text).tolist() == lib.encode(text, add_special_tokens=False).ids


# 8: n-gram join


def brute_join(texts, n=5, threshold=0.8):
    sets = []
    for t in texts:
        w = ngram_join._WORD.findall(t or "")
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]


def near_texts(seed=2):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    out = []
    for _ in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randint(4, 150))]
        out.append(" ".join(words))
        for _ in range(r.randint(0, 5)):
            other = words[:]
            for _ in range(r.randint(0, 4)):
                other[r.randrange(len(other))] = "new"
            out.append(" ".join(other))
        if r.random() < 0.4:
            out.append(passage + " " + " ".join(words))
    words = [r.choice(vocabulary) for _ in range(200)]
    out += [" ".join([*words[:i], "changed", *words[i + 1 :]]) for i in range(100)]
    return out + [None, "", "  \n", "one two", "one two", "one  two"]


def test_joins_are_those_of_brute_force(spark):
    texts = near_texts()
    pairs = brute_join(texts)
    links = np.bincount([x for p in pairs for x in p], minlength=len(texts))
    roots = union_find(len(texts), pairs)
    rows = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    found = sorted(map(tuple, ngram_join.jaccard_join(rows).drop("text_key").collect()))
    assert all(f[1] <= n for f, n in zip(found, links, strict=True)) and sum(f[1] for f in found) >= 0.99 * links.sum()
    assert np.mean([f[2] == r for f, r in zip(found, roots, strict=True)]) > 0.99
    stays = {r.doc_id for r in ngram_join.one_of_each(rows).collect()}
    assert stays == {f[0] for f in found if f[3]}


def test_joins_of_any_rows(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = spark.createDataFrame([(1, long), (2, long + " end"), (2, long + " end"), (None, long), (None, None), (3, None)], "doc_id long, text string")
    found = sorted(map(tuple, ngram_join.jaccard_join(rows).drop("text_key").collect()), key=str)
    assert found == sorted([(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (None, 3, 1, False), (None, 0, None, True), (3, 0, 3, True)], key=str)
    assert ngram_join.jaccard_join(rows.limit(0)).count() == 0 and ngram_join.one_of_each(rows.limit(0)).count() == 0


def test_large_nodes_go_on_splitting(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIMIT", 4)
    texts = near_texts(5)
    want = sum(2 for _ in brute_join(texts))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert want >= ngram_join.jaccard_join(rows).agg(F.sum("n_links")).first()[0] >= 0.98 * want


def test_runs_grow_with_recall_and_depth():
    assert ngram_join.repeats(0.9, ngram_join.survival(1)) == 3 and ngram_join.runs_for(0.99) > ngram_join.runs_for(0.9) > 3


@given(st.lists(st.lists(st.integers(0, 30), max_size=20), min_size=1, max_size=8))
def test_intersections_are_exact(lists):
    sets = [np.unique(np.array(x, np.uint64)) for x in lists]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    at = np.arange(len(sets))
    assert ngram_join.Intersecting(sets, 0.8).shared(at, at).tolist() == want
    many = np.arange(65) % len(sets)  # as a product of matrices
    assert (ngram_join.Intersecting(sets, 0.8).shared(many, at) == np.array(want)[many]).all()


# 9: SentencePiece

SOME = ["a", "the", "ing", " ", "  ", "    ", "\t", "\n", "é", "中", "23", "!", "'", "ion", "🎉", "▁", "<s>", "xxxxx", "==", "----"]


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """A unigram model made by rule from the pieces of the BPE model: the score falls with the rank, unevenly, so that sums don't tie."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    with open(PIECES, "rb") as f:
        spec.ParseFromString(f.read())
    spec.trainer_spec.model_type = 1
    for k, p in enumerate(spec.pieces):
        if p.type == 1:
            p.score = -2 - 0.0005 * k - 0.37 * np.sin(k * k)
    path = tmp_path_factory.mktemp("unigram") / "unigram.model"
    path.write_bytes(spec.SerializeToString())
    return str(path)


@settings(deadline=None, max_examples=150)
@given(parts=st.lists(st.sampled_from(["a", "the", "ing", " ", "  ", "\t", "\n", "é", "中", "23", "!", "ion", "🎉", "▁", "xxxxx", "==", "tion", "qu", "er"]), max_size=80), size=st.sampled_from([33, 50, 90]))
def test_unigram_scans_are_as_good_as_the_library_s(unigram, parts, size):
    """Runs of one character have paths of equal sums, which the library's single rounding tells apart; else ids are equal."""
    own, text = sentencepiece_scan.model(unigram), "".join(parts)
    assert isinstance(own, sentencepiece_scan.Unigram)
    found, want = sentencepiece_scan.encode_by_scan(own, text, size), own.library.encode(text)
    total = lambda ids: sum(own.library.get_score(i) for i in ids)
    assert np.isclose(total(found), total(want), rtol=1e-6) and sentencepiece_scan.pieces_text(own, found) == sentencepiece_scan.normalized(text)
    if all(a != b for a, b in zip(text, text[1:], strict=False)):
        assert found == want


def test_deep_trees_give_the_library_s_ids(spark, unigram, monkeypatch):
    """Documents of many chunks, over several levels of the tree, by both kinds of model."""
    monkeypatch.setattr(sentencepiece_scan, "FAN", 3)
    rng = random.Random(4)
    words = ["the", "of", "information", "xq", "中文字", "é", "--", "a1b2", "🎉", "reading"]
    texts = ["".join(rng.choices(words, k=6000)), " ".join(rng.choices(words, k=3000)), "x" * 5000, "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for path in (PIECES, unigram):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = {}
        for r in sorted(sentencepiece_scan.encode(rows, path, size=300).collect(), key=lambda r: r.chunk):
            ids[r.doc_id] = ids.get(r.doc_id, []) + np.frombuffer(r.ids, "<u4").tolist()
            assert r.round_trip
        want = {i: library.encode(t or "") for i, t in enumerate(texts)}
        if path == unigram:  # many paths through equal letters are equally good: one of them is taken
            total = lambda own: sum(library.get_score(i) for i in own)
            assert np.isclose(total(ids[2]), total(want[2])) and library.decode(ids[2]) == texts[2]
            ids[2] = want[2]
        assert ids == want


@settings(deadline=None, max_examples=200)
@given(st.lists(st.sampled_from(SOME), max_size=80), st.sampled_from([33, 50, 90]))
def test_scans_give_the_library_s_ids(parts, size):
    own, text = sentencepiece_scan.model(PIECES), "".join(parts)
    assert sentencepiece_scan.encode_by_scan(own, text, size) == own.library.encode(text)


def test_products_are_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random(s) < 0.4, np.float32(0), sentencepiece_scan.MINUS) for s in ((3, 4), (4, 5), (5, 2)))
    assert (sentencepiece_scan.combine(sentencepiece_scan.combine(a, b), c) == sentencepiece_scan.combine(a, sentencepiece_scan.combine(b, c))).all()


@given(st.binary(max_size=50), st.binary(max_size=50))
def test_checksums_are_joined(a, b):
    assert sentencepiece_scan.crc_shift(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_giant_documents(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(4)
    texts = [None, "", "hello world", " two  spaces ", "a▁b", "".join(r.choice(SOME[:-5]) for _ in range(3000)), "ab" * 2000, "".join(r.choice(SOME[:-5]) for _ in range(3000))]
    rows = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(5, texts[5], 0)], "doc_id long, text string, chunk int")
    found = sentencepiece_scan.decode(sentencepiece_scan.encode(rows, PIECES, size=500), PIECES).collect()
    for i, t in enumerate(texts):
        own = sorted((x.chunk, x.ids, x.decoded) for x in found if x.doc_id == i)[:: 2 if i == 5 else 1]
        assert np.frombuffer(b"".join(x[1] for x in own), "<u4").tolist() == lib.encode(t or "") and "".join(x[2] for x in own) == (t or "").replace("▁", " ")
    whole = {x.doc_id: x for x in sentencepiece_scan.digests(rows, PIECES, size=500).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "")
        assert whole[i].n_tokens == len(ids) and whole[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and whole[i].round_trip
    assert whole[6].n_chunks == 8 and sentencepiece_scan.digests(rows.limit(0), PIECES).count() == 0


# the pipeline


def test_pipeline_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], data), "stage"))
    columns = [d.columns for d in kept]
    assert columns[1] == columns[2] == columns[3] == docs.columns and "sequence_id" in columns[4]
    verdicts = {r.doc_id for r in QUERIES["op2_quality_rules"](spark, data).where("kept").collect()}
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    assert ids[1] == verdicts and ids[2] <= ids[1] and len(ids[2]) > 0.98 * len(ids[1]) and ids[4] == ids[3]
    rows = sorted((r.doc_id, r.text) for r in kept[2].collect())
    pairs = brute_join([t for _, t in rows])
    roots = union_find(len(rows), pairs)
    assert ids[3] == {rows[i][0] for i in set(roots)}
    assert all(r.n_chars == len(r.text) for r in kept[3].collect())
    assert corpus_pipeline.run(spark, data).count() == kept[4].count()
    packed = kept[4].collect()
    assert gapless(packed, 2048) == brute_plan([r.length for r in packed], 2048)


def odd_documents(spark, n=60):
    """Documents with nulls in every column, empty, very long and repeated rows, and a column of a clashing name."""
    r = random.Random(2)
    sounds = ("th er on an re he in ed nd ha".split(), "sch ung ein ich der und auf zu ber ver".split())
    word = lambda g, k: "".join(g.choices(sounds[k], k=g.choice((2, 3, 3))))
    sentence = lambda g, k, n: " ".join(word(g, k) for _ in range(n)) + "."
    good = lambda seed: " ".join(sentence(random.Random(seed * 20 + j), seed % 2, 15) for j in range(6))
    rows = []
    for i in range(n):
        seed = i % (n // 2) if i % 3 else i
        rows.append((i, good(seed), r.choice([("en", "de")[seed % 2], ("en", "de")[seed % 2], None, ""]), r.choice(["a.com", None, ""]), r.choice([None, 5])))
    rows += [(None, good(2), "en", "a.com", 1), (None, None, None, None, None), (100, "", "en", "a.com", 0), (101, None, "en", "a.com", 0), (7, rows[7][1], "de", "a.com", 1), (7, rows[7][1], "de", "a.com", 1)]
    rows += [(102, "\n".join(sentence(random.Random(i), 0, 12) for i in range(5000, 13_000)), "en", "a.com", 1)]
    return spark.createDataFrame([(*x, "m") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, key string")


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_rows_of_any_kind(spark, data, stage):
    docs = written(odd_documents(spark), "odd")
    found = stage(spark, docs, data)
    rows = found.collect()
    if stage is corpus_pipeline.packed:
        assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
        gapless(rows, 2048)
    else:
        assert found.columns == corpus_pipeline.COLUMNS
        kept = [r.doc_id for r in rows]
        assert 102 in kept
        if stage is corpus_pipeline.near_duplicates:
            assert {100, 101} <= set(kept) and kept.count(7) in (0, 3) and len(kept) < docs.count()
        else:
            assert not {100, 101} & set(kept) and kept.count(7) in (0, 3)
            assert all(r.text for r in rows)
        if stage is corpus_pipeline.quality_rules:
            assert all(r.n_chars == len(r.text) for r in rows)
    empty = stage(spark, docs.limit(0), data)
    assert empty.count() == 0 and empty.columns == found.columns
