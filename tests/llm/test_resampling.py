"""Operator 12."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.llm import resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def runs(text, n):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, percent, buckets, n, least):
    at = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = (Counter(at(x) for text in texts for x in runs(text, n)) for texts in ([d[1] for d in docs], target))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        own = runs(text, n)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[at(x)] for x in own)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least])
    may = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): k + 1 for k, r in enumerate(may[: percent * len(may) // 100])}
    return Counter((*r[:4], rank.get(id(r))) for r in rows)


TEXTS = ["", None, "one two three", "One  TWO; three", "é漢字 ÀB a-b a_b `x` {y}", "benchmark words here " * 8, "the same words again " * 6, "0 1 2 3 4 5 6 7 8 9 :;<=>?@[]^~\x7f\x00 a", "other words entirely", "long " * 5000]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_draws_are_those_of_brute_force(spark, n):
    docs = [(i, TEXTS[i % len(TEXTS)]) for i in range(60)] + [(None, TEXTS[5]), (None, TEXTS[6]), (5, TEXTS[5]), (5, TEXTS[5]), (-4, TEXTS[6])]
    target = ["benchmark words here", None, "", "Other é漢字"]
    df = spark.createDataFrame([(*d, "x", 0) for d in docs], "doc_id long, text string, rank string, n int").repartition(3)
    found = R.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), 40, 97, n, 4)
    assert Counter(map(tuple, found.collect())) == brute(docs, target, 40, 97, n, 4)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(i, "a b c d e " * 5) for i in range(30)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert R.resample(none, docs).count() == 0
    assert R.resample(docs, none).where("rank is not null").count() == 3
    assert R.resample(docs, docs, least=100).where("rank is not null").count() == 0
    assert R.resample(docs, docs, percent=100).where("rank is not null").count() == 30


@pytest.mark.parametrize("hot", [0, 40, 100_000])
def test_a_score_that_most_documents_have(spark, hot):
    """Repeated ids, nulls and distant ids of one score, numbered by parts or in one window."""
    ids = [None] * 50 + [7] * 60 + [i * (1 << 40) - 5 for i in range(-20, 20)] + list(range(-30, 30))
    rows = [(i, 30, 5, 100, True, k % 3) for k, i in enumerate(ids)] + [(i, 25, 1, 200 - i, True, 0) for i in range(30)] + [(1, 1, 0, 5000, False, 0)]
    df = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long, may boolean, salt long")
    for n in (0, 10, 95, 200, 1000):
        found = [r for r in R.ranked(df, n, hot).collect()]
        assert len(found) == len(rows)
        want = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))[:n]
        drawn = sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])
        assert [r["rank"] for r in drawn] == list(range(1, len(want) + 1))
        assert [(r.doc_id, r.score) for r in drawn] == [(r[0], r[3]) for r in want]


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.integers(-(1 << 46), 1 << 46) | st.integers(-200, 200), st.integers(1, 9), max_size=40), st.booleans())
def test_sums_by_digits(spark, counts, small):
    if small:
        counts = {k: n for k, n in counts.items() if abs(k) < 256}
    df = spark.createDataFrame(list(counts.items()), "k long, n long").coalesce(1)
    found = {r.k: r.before for r in (R.before(df, "k", "n", 9, digit=3) if small else R.before(df, "k", "n")).collect()}
    assert found == {k: sum(n for j, n in counts.items() if j < k) for k in counts}
