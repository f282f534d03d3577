"""Operator 8 on sets that share much with many others and are near to few."""

import numpy as np
import pytest

from granary.llm import ngram_join as J
from granary.llm.common import written


def template_pages(n, shared, own, twins=0, seed=1):
    """Signatures of ``n`` sets of ``shared`` common elements and ``own`` ones of each; the last ``twins`` have all but a tenth of their elements from the first ones."""
    rng = np.random.default_rng(seed)
    common = rng.integers(0, 2**63, shared).astype(np.uint64)
    sets = [np.r_[common, rng.integers(0, 2**63, own).astype(np.uint64)] for _ in range(n - twins)]
    for i in range(twins):
        own_ = sets[i].copy()
        own_[-max(1, len(own_) // 20) :] = rng.integers(0, 2**63, max(1, len(own_) // 20)).astype(np.uint64)
        sets.append(own_)
    return [J.signature(x) for x in sets]


def classes(spark, signatures):
    rows = [(i.to_bytes(8, "big"), s.astype("<u4").tobytes()) for i, s in enumerate(signatures)]
    return written(spark.createDataFrame(rows, "key binary, signature binary"), "classes")


def compared(spark, signatures):
    """Rows and pairs of the nodes in which all meet."""
    met, _ = J.buckets(classes(spark, signatures), 0.8, 0.995)
    sizes = [r.size for r in met.select("node", "size").distinct().collect()]
    return sum(sizes), sum(s * (s - 1) // 2 for s in sizes), max(sizes)


@pytest.mark.parametrize(("shared", "own"), [(100, 100)])  # a similarity of 1/3
def test_pairs_grow_with_the_pages_of_a_template(spark, monkeypatch, shared, own):
    """Measured without Spark for LIMIT 32 and 500, 2,000 and 8,000 pages: 21, 59 and 108 thousand pairs of 125, 1,999 and 31,996 thousand at 1/3; 94, 284 and 786 thousand at 1/2."""
    monkeypatch.setattr(J, "LIMIT", 32)
    few, many = (compared(spark, template_pages(n, shared, own)) for n in (400, 1600))
    assert many[1] <= 6 * few[1] and many[1] < 1600 * 1600 / 2 / 3  # four times the pages; all pairs would be sixteen times as many
    assert max(few[2], many[2]) <= 64  # nodes are left with at most LIMIT members that pivots don't settle


def test_near_pages_of_a_template_are_found(spark, monkeypatch):
    """Pairs at 0.9 among pages that share a half, below the third level, and a group of near copies beside them."""
    monkeypatch.setattr(J, "LIMIT", 32)
    signatures = template_pages(300, 100, 50, twins=50, seed=3)
    base = np.random.default_rng(9).integers(0, 2**63, 150).astype(np.uint64)
    for i in range(100):  # near copies of one page: pivots settle them
        own = base.copy()
        own[i % 150] = np.uint64(i + 1)
        signatures.append(J.signature(own))
    met, _ = J.buckets(classes(spark, signatures), 0.8, 0.995)
    together = set()
    nodes = {}
    for r in met.collect():
        nodes.setdefault(r.node, []).append(int.from_bytes(r.key, "big"))
    for members in nodes.values():
        own = set(members)
        together |= {i for i in members if i < 50 and 250 + i in own}
    assert len(together) >= 49
    copies = [m for m in nodes.values() if len(m) > 32]
    assert all(sum(300 <= i for i in m) >= len(m) - 64 for m in copies)  # large nodes are near copies but for LIMIT members, and pages that are near to a pivot


def test_nodes_grow_with_a_group_of_near_copies_and_stragglers(spark, monkeypatch):
    """Four times a group of copies, a third of which is far from the page they are made of: simulated without Spark, 3,600 and 70,636 rows in nodes before, 3,147 and 12,660 now."""
    monkeypatch.setattr(J, "LIMIT", 32)

    def rows(n):
        rng = np.random.default_rng(0)
        base, signatures = rng.integers(0, 2**63, 100).astype(np.uint64), []
        for _ in range(n):
            own, k = base.copy(), rng.integers(1, 30)
            own[rng.choice(100, k, False)] = rng.integers(0, 2**63, k).astype(np.uint64)
            signatures.append(J.signature(own))
        met, _ = J.buckets(classes(spark, signatures), 0.8, 0.995)
        return met.count()

    assert rows(600) <= 6 * rows(150)
