"""The segmented index against a scan, and against an index that is built at once."""

import os
import random

import pytest
from pyspark.sql import functions as F

from granary.operators import lexical
from granary.operators import text_index as T
from granary.operators.text_index import TextIndex

WORDS = [f"w{i}" for i in range(400)]


def made(n, seed=1, start=0):
    """Documents in which a few words are everywhere and most are rare, with copies and odd texts."""
    rng = random.Random(seed)
    weight = [1 / (i + 1) for i in range(len(WORDS))]
    texts = [" ".join(rng.choices(WORDS, weight, k=rng.randrange(5, 60))) for _ in range(n)]
    for i in range(0, n - 7, 11):
        texts[i + 7] = texts[i]
    texts[1], texts[2] = "", None
    return [(start + i, t, f"m{i % 3}") for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, metadata string")


def ranked(df):
    return [(r["rank"], r.id, r.score) for r in df.orderBy("rank").collect()]


def by_scan(spark, rows, query, k):
    return ranked(lexical.top_k(lexical.scan_scores(frame(spark, rows), query).select("id", "score"), k, 6))


QUERIES = ["w0 w300 w1 w0", "w0", "w0 w1 w2", "w399 w250", "nothing here", "", "w5 w80 w0 W200"]


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 8)
    monkeypatch.setattr(T, "MOST", 12)
    monkeypatch.setattr(T, "SEEDS", 6)
    monkeypatch.setattr(T, "FEW", 50)


@pytest.fixture(scope="module")
def rows():
    return made(1500)


def test_search_is_that_of_a_scan(spark, tmp_path, monkeypatch, rows):
    index = TextIndex(spark, str(tmp_path / "a")).add(frame(spark, rows))
    for query in QUERIES:
        assert ranked(index.search(query, 10, 6)) == by_scan(spark, rows, query, 10)
    scan = {r.id: r.score for r in lexical.scan_scores(frame(spark, rows), QUERIES[0]).where("score > 0").collect()}
    found = index.scores(QUERIES[0]).join(index.documents(), ["segment", "row"])
    assert {r.id: pytest.approx(r.score) for r in found.collect()} == scan
    assert max(r.n for r in index.blocks.collect()) <= T.MOST


def test_a_question_with_a_frequent_word_reads_few_of_its_blocks(spark, tmp_path, rows):
    index = TextIndex(spark, str(tmp_path / "a")).add(frame(spark, rows))
    query, k = "w0 w350", 5
    q = index.question(query)
    reached = index.threshold(q, k)
    true = by_scan(spark, rows, query, k)
    assert 0 < reached <= true[-1][2] + 1e-6
    blocks, looked_up = index.needed(q, reached)
    assert looked_up == ["w0"] and blocks.where("term = 'w0'").count() == 0
    every, read = index.bounds(q).where("term = 'w350'").count(), blocks.count()
    assert read <= every and index.bounds(q).where("term = 'w0'").count() > 50
    # the frequent word's blocks that are looked up are those of the few documents found
    found = index._summed(blocks, q)
    found.write.parquet(str(tmp_path / "found"))
    found = spark.read.parquet(str(tmp_path / "found"))
    assert index.lookups(found, q, ["w0"]).count() <= found.count() < 40
    # alone, the frequent word is read by its blocks' bounds
    alone = index.question("w0")
    some, _ = index.needed(alone, index.threshold(alone, k))
    assert some.count() < index.bounds(alone).count() / 2


def test_many_questions_are_answered_as_one_by_one(spark, tmp_path, monkeypatch, rows):
    """Also over several segments, with documents replaced."""
    index = TextIndex(spark, str(tmp_path / "a")).add(frame(spark, rows[:900])).add(frame(spark, rows[900:] + [(i, "w0 w350 w7", "m") for i in range(30)]), replace=True)
    asked = [(f"q{i}", q) for i, q in enumerate(QUERIES)] + [("w350", "w350 w0"), ("null", None)]
    found = {}
    for r in index.search_many(spark.createDataFrame(asked, "question_id string, text string"), 7, 6).collect():
        found.setdefault(r.question_id, []).append((r["rank"], r.id, r.score))
    for name, query in asked:
        assert sorted(found.get(name, [])) == ranked(index.search(query or "", 7, 6)), query


def contents(index):
    terms = sorted(map(tuple, index.terms.collect()))
    postings = sorted((r.id, r.term, r.tf, r.dl) for r in index.postings.join(index.documents().select("segment", "row", "id"), ["segment", "row"]).collect())
    documents = sorted(((r.id, r.text or "", r.metadata) for r in index.documents().collect()))
    return index.n, index.length, round(index.mean_idf, 9), terms, postings, documents


def test_increments_are_an_index_built_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "SEGMENTS", 2)
    rows = made(160)
    index = TextIndex(spark, str(tmp_path / "a"))
    for k in range(4):
        index = index.add(frame(spark, rows[40 * k : 40 * k + 40]))
    assert len(index.segments) <= 2
    whole = TextIndex(spark, str(tmp_path / "b")).add(frame(spark, rows))
    assert contents(index) == contents(whole)
    for query in QUERIES[:2]:
        assert ranked(index.search(query, 10, 6)) == ranked(whole.search(query, 10, 6)) == by_scan(spark, rows, query, 10)


def test_replaced_and_removed_documents_no_longer_count(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "SEGMENTS", 2)
    rows = made(120)
    index = TextIndex(spark, str(tmp_path / "a")).add(frame(spark, rows))
    new = made(30, 5, 100)
    index = index.add(frame(spark, new), replace=True, removed=spark.createDataFrame([(3,), (4,), (999,)], "id long"))
    now = [r for r in rows if r[0] < 100 and r[0] not in (3, 4)] + new
    assert contents(index) == contents(TextIndex(spark, str(tmp_path / "b")).add(frame(spark, now)))
    newer = made(10, 6, 95)
    index = index.add(frame(spark, newer), replace=True)  # three segments: the smallest become one
    now = [r for r in now if not 95 <= r[0] < 105] + newer
    assert len(index.segments) == 2 and contents(index) == contents(TextIndex(spark, str(tmp_path / "c")).add(frame(spark, now)))
    for query in QUERIES[:2]:
        assert ranked(index.search(query, 10, 6)) == by_scan(spark, now, query, 10)
    index.vacuum()
    assert sorted(x for x in os.listdir(tmp_path / "a") if x.startswith("s")) == sorted(f"s{s}" for s in index.segments)
    assert index.search("w0", 3).count() == 3


def test_readers_see_an_index_before_or_after_a_change(spark, tmp_path, monkeypatch):
    rows = made(60)
    path = str(tmp_path / "a")
    index = TextIndex(spark, path).add(frame(spark, rows[:40]))
    before = contents(index)
    with monkeypatch.context() as m:
        m.setattr(TextIndex, "_marked", lambda self, segments: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError, match="stopped"):
            index.add(frame(spark, rows[40:50]))
    assert contents(TextIndex(spark, path)) == before
    later = TextIndex(spark, path).add(frame(spark, rows[40:]))
    assert contents(index) == before  # a reader that began before goes on with what it saw
    assert contents(later) == contents(TextIndex(spark, str(tmp_path / "b")).add(frame(spark, rows)))


def test_empty_indexes(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "a"))
    assert index.segments == [] and index.terms.count() == 0 and index.scores("w0").count() == 0
    index = index.add(frame(spark, []))
    assert index.search("w0", 5).count() == 0 and index.n == 0
    index = index.add(frame(spark, [(1, "w0 w1", "m"), (1, "w0", "again"), (2, None, "m")]))
    assert [(r.id, r.metadata) for r in index.search("w0", 5).collect()] == [] or index.n == 3  # both have it: its idf is negative
    assert {r.metadata for r in index.search("w1", 5).collect()} <= {"m"}


def test_blocks_are_sorted_in_parts_and_texts_are_tokenized_once(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(T, "SORTED", 2000)
    index = TextIndex(spark, str(tmp_path / "a")).add(frame(spark, rows))
    files = [x for x in os.listdir(tmp_path / "a" / "s1" / "blocks") if x.endswith(".parquet")]
    assert len(files) > 4  # as the postings ask for, more than the session's partitions
    assert not os.path.exists(tmp_path / "a" / "s1" / "counted")
    monkeypatch.setattr(T, "SORTED", 10**6)
    assert contents(index) == contents(TextIndex(spark, str(tmp_path / "b")).add(frame(spark, rows)))


def test_many_questions_meet_documents_in_groups(spark, tmp_path, monkeypatch, rows):
    """Frequent terms and copies: a group keeps k rows a question, and no plan has a row for each question and document."""
    monkeypatch.setattr(T, "DOCUMENTS", 400)
    monkeypatch.setattr(T, "QUESTIONS", 15)
    copies = rows + [(10_000 + i, "w0 w1 w300", "m") for i in range(500)]
    index = TextIndex(spark, str(tmp_path / "a")).add(frame(spark, copies))
    asked = [(f"q{i}", f"w0 w1 w2 w{i % 3} w{200 + i % 2}") for i in range(30)] + [("c", "w300 w1")]
    out = index.search_many(spark.createDataFrame(asked, "question_id string, text string"), 7, 6)
    found = {}
    for r in out.collect():
        found.setdefault(r.question_id, []).append((r["rank"], r.id, r.score))
    for name, query in (asked[0], asked[1], asked[-1]):
        assert sorted(found[name]) == by_scan(spark, copies, query, 7)
    plan = out._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" in plan and len(found) == 31
