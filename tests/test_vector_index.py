"""The inverted-file index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import vectors as V
from granary.operators import vectors
from granary.operators.vector_index import NOWHERE, VectorIndex, default_lists, fit


def made(spark, n, dimensions=16, groups=40, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dimensions))
    x = centers[rng.integers(0, groups, n)] + 0.35 * rng.normal(size=(n, dimensions))
    return spark.createDataFrame([(i, [float(y) for y in v], i % 5) for i, v in enumerate(x)], "id long, embedding array<double>, kind int"), x


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows, x = made(spark, 6000)
    odd = spark.createDataFrame([(10_000, None, 0), (10_001, [0.0] * 16, 1), (10_002, [float("nan")] * 16, 1), (10_003, [None] + [1.0] * 15, 2), (10_004, [float("inf")] + [1.0] * 15, 2)], rows.schema)
    path = str(tmp_path_factory.mktemp("index"))
    return VectorIndex.build(rows.unionByName(odd), path, 64), rows.unionByName(odd), x


def pairs(df):
    return [(r.id, round(r.distance, 9), r["rank"]) for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize("k", [1, 20, 100])
def test_exact_search_is_that_of_the_whole_table(index, k):
    found, rows, x = index
    for q in (x[5], x[77] * 100, -x[3], np.eye(16)[2]):
        q = [float(v) for v in q]
        assert pairs(found.search(q, k)) == pairs(vectors.search(rows.where("id <= 10001"), q, k))
    where = (F.col("kind") == 3) & (F.col("id") < 10_000)
    q = [float(v) for v in x[9]]
    assert pairs(found.search(q, k, where=where)) == pairs(vectors.search(rows, q, k, where))


def test_a_search_reads_only_what_it_probes(spark, index):
    found, _, x = index
    q = [float(v) for v in x[5]]
    files = lambda lists: found.of(lists).select(F.input_file_name()).distinct().count()
    near = np.argsort(found._distances(q)).tolist()
    one, four, every = files(near[:1]), files(near[:4]), files([*range(64), NOWHERE])
    assert one <= 3 and four <= 4 * 3 and every >= 60
    assert "PartitionFilters: [isnotnull(list" in (plan := found.search(q, 20, 4)._jdf.queryExecution().toString()) or "PartitionFilters: [list" in plan
    needed = found._needed(found._distances(q), q, 20, None)
    assert len(needed) < 32  # bounds leave out most lists of clustered vectors


def test_recall_of_few_probes(spark, index):
    found, rows, x = index
    queries = rows.where("id % 50 = 0 and id < 10000").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    curve = found.recall(queries, 20)
    assert len(curve) == 64 and curve == sorted(curve) and curve[7] >= 0.95 and curve[63] == 1
    probes = found.probes_for(queries, 20, 0.95)
    assert curve[probes - 1] >= 0.95 > (curve[probes - 2] if probes > 1 else 0) and probes <= 8
    some = {(r.query_id, r.id) for r in found.search_many(queries, 20, probes).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    exact = {(r.query_id, r["rank"]): (r.id, r.distance) for r in found.search_many(queries, 20).collect()}
    assert len(exact) == 120 * 20
    for q in range(0, 6000, 50):
        d = 1 - unit @ unit[q]
        for r, i in enumerate(np.lexsort((np.arange(6000), d))[:20]):
            assert abs(exact[q, r + 1][1] - d[i]) < 1e-9
    true = {(q, i) for (q, _), (i, _) in exact.items()}
    assert abs(len(true & some) / len(true) - curve[probes - 1]) < 1e-9


def test_large_lists_and_many_queries_go_in_blocks(spark, tmp_path, monkeypatch):
    """Most vectors equal, and all queries at their list: the same rows whatever the blocks."""
    from granary.operators import vector_index as I

    rows, x = made(spark, 300, 8)
    copies = spark.range(1000, 1600).select("id", F.array(*[F.lit(float(v)) for v in x[0]]).alias("embedding"), F.lit(0).alias("kind"))
    found = VectorIndex.build(rows.unionByName(copies), str(tmp_path / "a"), 12)
    queries = rows.where("id < 40").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    whole = sorted(map(tuple, found.search_many(queries, 7, 3, 9).collect()))
    monkeypatch.setattr(I, "BLOCK", 50)
    monkeypatch.setattr(I, "QUERIES", 7)
    assert sorted(map(tuple, found.search_many(queries, 7, 3, 9).collect())) == whole
    assert [r[1] for r in whole if r[0] == 0] == [0, 1000, 1001, 1002, 1003, 1004, 1005]


def test_little_of_a_fit_goes_to_the_driver(spark):
    """A sum for each list and round, and not the distances of all pairs of lists."""
    sent = lambda: sum(x.resultSize() for x in (stages.apply(i) for i in range(stages.size())))
    store = lambda: spark.sparkContext._jsc.sc().statusStore()
    rows, _ = made(spark, 3000, 64)
    stages = store().stageList(None, False, False, getattr(store(), "stageList$default$4")(), None)
    before = sent()
    centers = fit(rows, 150, 3000)
    stages = store().stageList(None, False, False, getattr(store(), "stageList$default$4")(), None)
    assert centers.shape == (150, 64) and len(np.unique(centers, axis=0)) == 150
    assert sent() - before < 150 * 64 * 8 * 20 + 1_500_000


def test_fit_of_equal_vectors(spark):
    rows = spark.range(500).select("id", F.array(F.lit(3.0), (F.col("id") % 3).cast("double")).alias("embedding"))
    assert len(fit(rows, 20, 500)) == 3


def test_an_exact_search_has_no_row_for_each_query_and_list(index):
    found, rows, _ = index
    queries = rows.where("id % 50 = 0 and id < 10000").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    plan = lambda probes: found.search_many(queries, 20, probes)._jdf.queryExecution().toString()
    assert "probed" in plan(3) and "probed" not in plan(None)


def test_a_norm_is_computed_once_a_vector(spark):
    rows = spark.range(3).select(F.array(F.col("id").cast("double"), F.lit(4.0)).alias("x")).repartition(2)
    unit = rows.select(V.normalized(F.col("x")).alias("u"))
    assert unit._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    assert sorted(r.u for r in unit.collect()) == [[0.0, 1.0], [1 / 17**0.5, 4 / 17**0.5], [2 / 20**0.5, 4 / 20**0.5]]
    assert spark.range(1).select(V.normalized(F.array(F.lit(0.0), F.lit(0.0))).alias("u")).first().u == [0.0, 0.0]


def test_vectors_that_are_added_are_found(spark, tmp_path):
    rows, x = made(spark, 900, 8)
    found = VectorIndex.build(rows.where("id < 500"), str(tmp_path / "a"), 10)
    found.add(rows.where("id >= 500"))
    for i in (3, 700):
        q = [float(v) for v in x[i]]
        assert pairs(found.search(q, 15)) == pairs(vectors.search(rows, q, 15))
    assert found.rows().count() == 900 and sum(n for n, _ in found.sizes().values()) == 900


def test_small_and_empty_tables(spark, tmp_path):
    rows, x = made(spark, 3, 4)
    none = VectorIndex.build(rows.limit(0), str(tmp_path / "none"))
    assert none.search([1.0, 0.0, 0.0, 0.0], 5).count() == 0
    few = VectorIndex.build(rows, str(tmp_path / "few"))
    q = [float(v) for v in x[0]]
    assert pairs(few.search(q, 5)) == pairs(vectors.search(rows, q, 5)) and few.search([0.0] * 4, 5).count() == 3
    assert default_lists(0) == 1 and default_lists(10**12) == 16_384
