import math
import random
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary import schemas
from granary.config import Settings, Site
from granary.operators import answer, lexical, retrieve, vectors
from granary.operators.text_index import TextIndex
from granary.plans import api
from granary.plans.refresh import index_changes, refresh
from granary.streaming.incremental import upsert_stream

TEXTS = ["the cat sat", "the dog sat on the mat", "a cat and a dog", "", "!!", "the the the end"]


def brute_bm25(texts, query):
    docs = [re.findall(r"\w+", t.lower()) for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    idf = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in idf.items()}
    return [sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in re.findall(r"\w+", query.lower()) if w in idf) for d in docs]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


@pytest.mark.parametrize("query", ["cat", "the cat the", "nothing known", "?!", "dog mat cat"])
def test_bm25_is_the_formula(spark, query, tmp_path):
    docs, want = frame(spark, TEXTS), brute_bm25(TEXTS, query)
    found = {r.id: r.score for r in lexical.scan_scores(docs, query).collect()}
    assert all(math.isclose(found[i], want[i], abs_tol=1e-12) for i in found)
    index = TextIndex(spark, str(tmp_path / "i")).add(docs)
    indexed = {r.id: r.score for r in index.scores(query).join(index.documents(), ["segment", "row"]).collect()}
    assert all(math.isclose(indexed.get(i, 0), want[i], abs_tol=1e-12) for i in found)


def test_top_k_breaks_ties_and_leaves_out_zero(spark):
    scores = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 2.0), (4, 0.0), (5, -1.0)], "id int, score double")
    assert [(r.id, r["rank"]) for r in lexical.top_k(scores, 10).orderBy("rank").collect()] == [(2, 1), (1, 2), (3, 3)]


def ranked(spark, texts):
    return spark.createDataFrame([(t, f"m{i}", i + 1) for i, t in enumerate(texts)], "text string, metadata string, rank int")


def brute_fusion(near, words):
    out = {}
    for place, (weight, texts) in enumerate(((0.6, near), (0.4, words))):
        for i, t in enumerate(texts):
            r = out.setdefault(t[:100], {"text": t, "score": 0.0, "v": None, "b": None})
            if place == 0 and r["v"] is None:
                r["v"] = i + 1
            if place == 1:
                r["b"] = i + 1
            r["score"] += weight / (61 + i)
    return [(r["text"], round(r["score"], 12), r["v"], r["b"]) for r in sorted(out.values(), key=lambda r: -round(r["score"], 12))]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "b", "c", "x" * 100 + "1", "x" * 100 + "2"]), max_size=6), st.lists(st.sampled_from(["a", "c", "d", "x" * 100 + "2"]), max_size=5))
def test_fusion(spark, near, words):
    found = retrieve.fuse(ranked(spark, near), ranked(spark, words), digits=12).orderBy("rank").collect()
    assert [(r.text, r.score, r.vector_rank, r.bm25_rank) for r in found] == brute_fusion(near, words)


def test_hybrid_search(spark, tmp_path):
    docs = frame(spark, TEXTS).withColumn("metadata", F.struct(F.lit("u").alias("url")))
    index = TextIndex(spark, str(tmp_path / "i")).add(docs)
    rows = docs.withColumn("embedding", vectors.hashed_embedding(F.col("text")))
    both = retrieve.hybrid_search(index, rows, "cat dog", 3).orderBy("rank").collect()
    assert both[0].text == "a cat and a dog" and both[0].vector_rank and both[0].bm25_rank
    alone = retrieve.hybrid_search(None, rows, "cat dog", 3).collect()
    assert all(r.bm25_rank is None for r in alone) and len(alone) == 3
    assert [r.text for r in retrieve.vector_only_search(rows, "cat dog", 3).orderBy("rank").collect()] == [r.text for r in sorted(alone, key=lambda r: r["rank"])]
    assert retrieve.hybrid_search(index, rows, "?!", 3).count() == 3 and index.search("?!", 3).count() == 0
    assert retrieve.candidates(5) == 20 and retrieve.candidates(2) == 8 and retrieve.candidates(50) == 20


def test_chunks_with_one_id_stay_apart(spark, tmp_path):
    docs = spark.createDataFrame([("a", "the cat sat", "m1"), ("a", "a cat ran off", "m2"), ("b", "no such animal", "m3"), ("c", "nor here", "m4"), ("d", "nor there", "m5")], "id string, text string, metadata string")
    index = TextIndex(spark, str(tmp_path / "i")).add(docs, ("id", "text"))
    found = {r.text: (r.metadata, r.score) for r in index.search("cat", 5).collect()}
    want = brute_bm25([r.text for r in docs.collect()], "cat")
    assert {t: m for t, (m, _) in found.items()} == {"the cat sat": "m1", "a cat ran off": "m2"}
    assert math.isclose(found["the cat sat"][1], want[0]) and math.isclose(found["a cat ran off"][1], want[1])
    rows = docs.withColumn("embedding", vectors.hashed_embedding(F.col("text"))).where("metadata <> 'm2'")
    both = {r.text: (r.metadata, r.vector_rank, r.bm25_rank, round(r.score, 6)) for r in retrieve.hybrid_search(index, rows, "cat", 5).collect()}
    assert both["the cat sat"] == ("m1", 1, 1, round(1 / 61, 6)) and both["a cat ran off"] == ("m2", None, 2, round(0.4 / 62, 6))


def test_stored_searches_read_little(spark, tmp_path):
    """Words and rows reach the scans as filters."""
    index = TextIndex(spark, str(tmp_path / "i")).add(frame(spark, TEXTS))
    plan = index_plan = index.scores("cat dog")._jdf.queryExecution().toString()
    assert "In(term, [" in plan.split("PushedFilters", 1)[1] and "lengths" not in index_plan
    assert "PushedFilters: [In(row, [" in index.search("cat dog", 2)._jdf.queryExecution().toString()


def test_vector_search(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b"), (3, [1.0, 1.0], "b"), (4, [2.0, 0.0], "b")], "id int, embedding array<double>, kind string")
    found = vectors.search(rows, [1.0, 0.0], 3).orderBy("rank").collect()
    assert [r.id for r in found] == [1, 4, 3] and found[0].similarity == 1
    assert [r.id for r in vectors.search(rows, [1.0, 0.0], 2, F.col("kind") == "b").orderBy("rank").collect()] == [4, 3]
    odd = rows.select("id", "embedding").union(spark.createDataFrame([(5, [0.0, 0.0]), (6, None)], "id int, embedding array<double>"))
    assert [(r.id, r.similarity) for r in vectors.search(odd, [1.0, 0.0], 9).orderBy("rank").collect()][3:] == [(2, 0), (5, 0)]
    assert [r.similarity for r in vectors.search(odd, [0.0, 0.0], 9).collect()] == [0] * 5


def test_embedders(spark):
    docs = frame(spark, ["a b", "", None])
    hashed = docs.withColumn("embedding", vectors.hashed_embedding(F.col("text"))).orderBy("id").collect()
    assert math.isclose(sum(x * x for x in hashed[0].embedding), 1) and not any(hashed[1].embedding) and not any(hashed[2].embedding)
    found = vectors.embed_with(docs, lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], "length", batch=2).orderBy("id").collect()
    assert found[1].embedding == [0.0, 1.0] and math.isclose(found[0].embedding[0], 3 / math.sqrt(10))


def vector_rows(spark, *rows):
    return spark.createDataFrame([(i, t, (f"u{i}", "t", "", "", 0, None), [1.0], s) for i, t, s in rows], f"{schemas.VECTOR}, seq int")


def test_collection(spark, tmp_path):
    c = vectors.Collection(spark, str(tmp_path))
    assert c.read().count() == 0
    assert c.upsert(vector_rows(spark, ("a", "1", 0), ("b", "1", 0), ("a", "2", 1))) == 2
    assert c.upsert(vector_rows(spark, ("b", "3", 0), ("c", "1", 0))) == 3
    assert {r.id: r.text for r in c.read().collect()} == {"a": "2", "b": "3", "c": "1"}
    assert c.upsert(vector_rows(spark, ("b", "3", 0), ("c", "1", 0))) == 3  # again
    s = c.stats().first()
    assert s.total_chunks == 3 and s.sample_urls == ["ua", "ub", "uc"] and c.peek(2).count() == 2
    c.vacuum()
    assert c.read().count() == 3
    c.clear()
    assert c.read().count() == 0


def written_bytes(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_upserts_write_their_own_rows_only(spark, tmp_path):
    """What 200 rows write doesn't depend on how many there are; what is rewritten later stays in proportion."""
    sizes = {}
    for n in (1000, 10_000):
        c = vectors.Collection(spark, str(tmp_path / str(n)), schema="id string, text string")
        new = lambda a, z, say: spark.range(a, z).select(F.col("id").cast("string").alias("id"), F.concat(F.lit(say), F.sha2(F.col("id").cast("string"), 256)).alias("text"), F.lit(0).alias("seq"))  # noqa: E731, B023
        assert c.upsert(new(0, n, "old")) == n
        assert c.upsert(new(n - 100, n + 100, "new").coalesce(1)) == n + 100
        sizes[n] = written_bytes(tmp_path / str(n) / "pages/d2")
        assert c.read().where("text like 'new%'").count() == 200
    assert abs(sizes[1000] - sizes[10_000]) < 0.1 * sizes[1000]


def test_many_upserts_become_few_deltas(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors.Collection, "DELTAS", 3)
    c = vectors.Collection(spark, str(tmp_path), schema="id int, text string")
    rng, want = random.Random(4), {}
    for k in range(9):
        rows = [(rng.randrange(60 * (k == 0) + 30), f"{k} {i}", i) for i in range(40 if k == 0 else 6)]
        for i, t, s in rows:
            want[i] = t
        assert c.upsert(spark.createDataFrame(rows, "id int, text string, seq int")) == len(want)
        assert len(c._manifest()[1]) <= 3
    assert {r.id: r.text for r in c.read().collect()} == want
    c.vacuum()
    assert {r.id: r.text for r in c.read().collect()} == want and len(list((tmp_path / "pages").glob("d*"))) <= 3


def test_a_stopped_upsert_leaves_the_collection(spark, tmp_path, monkeypatch):
    c = vectors.Collection(spark, str(tmp_path), schema="id int, text string")
    frame = lambda *rows: spark.createDataFrame([(*r, 0) for r in rows], "id int, text string, seq int")
    c.upsert(frame((1, "a"), (2, "b")))
    with monkeypatch.context() as m:
        m.setattr(vectors.Collection, "_name", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError, match="stopped"):
            c.upsert(frame((1, "c"), (3, "d")))
    assert {tuple(r) for r in c.read().collect()} == {(1, "a"), (2, "b")}
    assert c.upsert(frame((2, "e"))) == 2 and {tuple(r) for r in c.read().collect()} == {(1, "a"), (2, "e")}


@pytest.mark.parametrize("turn", [0, 1])
def test_ties_do_not_depend_on_the_order_of_rows(spark, turn):
    rows = [("a", "one", 0), ("a", "two", 0), ("b", None, None), ("b", "x", None)][:: -1 if turn else 1]
    new = spark.createDataFrame(rows, "id string, text string, seq int").coalesce(1)
    got = sorted(map(tuple, vectors.upserted(spark.createDataFrame([("a", "old")], "id string, text string"), new).collect()))
    again = sorted(map(tuple, vectors.upserted(spark.createDataFrame([("a", "old")], "id string, text string"), new.orderBy("text")).collect()))
    assert got == again and len(got) == 2


META = "struct<url:string,title:string,section_heading:string>"


def test_prompt_and_sources(spark):
    rows = spark.createDataFrame([("text two", ("u1", "T1b", ""), 2), ("text one", ("u1", "T1", "H"), 1), ("three", ("", "x", None), 3)], f"text string, metadata {META}, rank int")
    prompt = answer.context_prompt(rows, "why?").first().prompt
    assert prompt.startswith("CONTEXT:\n[Source 1] T1 — H\nURL: u1\ntext one\n\n---\n\n[Source 2] T1b\nURL: u1\ntext two\n\n---\n\n[Source 3] x\nURL: \nthree") and "QUESTION: why?" in prompt
    assert [tuple(r) for r in answer.unique_sources(rows).collect()] == [("u1", "T1", 1)]
    told = answer.ask("why?", lambda q, n: rows, answer.Extractive())
    assert told["chunks_used"] == 3 and told["sources"] == [{"url": "u1", "title": "T1"}] and "[T1 — H](u1): text one" in told["answer"]
    assert answer.cited_urls("see [a](u1) and [b](u9)", ["u1"]) == ["u9"]
    assert answer.ask("why?", lambda q, n: rows.limit(0), answer.Extractive())["sources"] == []


def test_models_fall_back(monkeypatch, caplog):
    monkeypatch.setenv("LOCAL_LLM_URL", "http://127.0.0.1:9")
    monkeypatch.delenv("LLM_API_KEY", raising=False)
    with pytest.raises(ValueError):
        answer.language_model("none of these")
    for provider in ("cloud", "local"):
        assert isinstance(answer.language_model(provider), answer.Extractive)
        assert provider in caplog.text
    monkeypatch.setattr(answer, "MODELS", {"local": answer.local_endpoint})
    with pytest.raises(RuntimeError):
        answer.language_model("local")


def test_endpoints(monkeypatch):
    """Both providers against a server of our own."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, self.headers.get("Authorization"), body))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"response": "local"} if self.path == "/api/generate" else {"choices": [{"message": {"content": "cloud"}}]}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    local = answer.local_endpoint({"LOCAL_LLM_URL": url, "LOCAL_LLM_MODEL": "m"})
    cloud = answer.chat_endpoint({"LLM_URL": f"{url}/v1", "LLM_API_KEY": "k", "LLM_MODEL": "m"})
    assert local.is_available() and cloud.is_available() and not answer.chat_endpoint({}).is_available()
    assert local.generate("p", "s") == "local" and cloud.generate("p", "s") == "cloud"
    assert asked[0][2]["system"] == "s" and asked[1][1] == "Bearer k" and [m["role"] for m in asked[1][2]["messages"]] == ["system", "user"]
    server.shutdown()


def test_service(spark, tmp_path):
    empty = api.Service(None, None)
    assert empty.health() == {"status": "degraded", "llm_provider": "not initialized", "knowledge_base_size": 0} and empty.stats()["total_chunks"] == 0
    for question, status in (("x", 422), ("x" * 1001, 422), ("what?", 503)):
        with pytest.raises(api.ServiceError) as e:
            empty.chat(question)
        assert e.value.status == status
    c = vectors.Collection(spark, str(tmp_path))
    c.upsert(vector_rows(spark, ("a", "the cat", 0)))
    s = api.Service(c, lambda q, n: retrieve.hybrid_search(None, c.read(), q, n))
    assert s.chat("the cat?")["chunks_used"] == 1 and s.health()["knowledge_base_size"] == 1 and s.stats()["sample_urls"] == ["ua"]
    with pytest.raises(api.ServiceError) as e:
        api.Service(c, lambda q, n: 1 / 0).chat("what?")
    assert e.value.status == 500


def test_refresh_and_stream(spark, tmp_path):
    site = Site()
    fetched = spark.createDataFrame([("https://www.example.edu/a", "<title>A</title><main><h1>Head</h1><p>" + "Some words here. " * 40 + "</p></main>"), ("https://www.example.edu/b#x", "<main>skipped</main>")], "url string, html string")
    s = Settings(raw_dir=str(tmp_path / "raw"), processed_dir=str(tmp_path / "p"), index_dir=str(tmp_path / "i"), site=site)
    first = refresh(spark, fetched, s)
    assert first["n_pages"] == 1 and first["n_chunks"] == first["collection"] > 1
    assert refresh(spark, fetched, s)["collection"] == first["collection"]
    index = TextIndex(spark, str(tmp_path / "i/bm25"))
    assert index.n == first["n_chunks"] and index.version == 1  # the second refresh had nothing to add
    c = vectors.Collection(spark, str(tmp_path / "streamed"))
    upsert_stream(spark, str(tmp_path / "raw/all_pages"), c, str(tmp_path / "ck"), s).awaitTermination()
    assert c.read().count() == first["collection"]
    upsert_stream(spark, str(tmp_path / "raw/all_pages"), c, str(tmp_path / "ck"), s).awaitTermination()
    assert c.read().count() == first["collection"]


def test_the_index_takes_changed_chunks_only(spark, tmp_path):
    """Ids with several chunks change together; chunks that are gone go if asked."""
    frame = lambda rows: spark.createDataFrame([(i, t, (t[:1],)) for i, t in rows], "id string, text string, metadata struct<url:string>")
    index = index_changes(TextIndex(spark, str(tmp_path / "i")), frame([("a", "one cat"), ("a", "two cats"), ("b", "three dogs"), ("c", "four")]))
    held = lambda x: sorted((r.id, r.text) for r in x.documents().collect())
    now = [("a", "one cat"), ("a", "2 cats"), ("b", "three dogs"), ("d", "five")]
    index = index_changes(index, frame(now))
    assert held(index) == sorted([*now, ("c", "four")])
    new = spark.read.parquet(f"{index.path}/s{index.segments[-1]}/documents")
    assert sorted(r.id for r in new.collect()) == ["a", "a", "d"]
    index = index_changes(index, frame(now), full_rebuild=True)
    assert held(index) == sorted(now) and index.n == 4
    assert index_changes(index, frame(now), full_rebuild=True).version == index.version


def test_refresh_takes_usable_responses(spark, tmp_path):
    from granary.plans import search as commands

    page = lambda i: f"<title>A</title><main><h1>Head</h1><p>{'Some words here. ' * 10}</p><p>Number {i} of them all</p></main>"
    rows = [("https://www.example.edu/a", page(1), "text/html; charset=utf-8", 200, 1), ("https://www.example.edu/a", page(2), "text/html", 200, 2), ("https://www.example.edu/b", page(3), "text/html", 404, 1), ("https://www.example.edu/c", page(4), "application/pdf", 200, 1), ("https://www.example.edu/d", page(5), None, None, 1)]
    fetched = spark.createDataFrame(rows, "url string, html string, content_type string, status int, t int").withColumn("fetched_at", F.timestamp_seconds("t")).drop("t")
    s = Settings(raw_dir=str(tmp_path / "raw"), processed_dir=str(tmp_path / "p"), index_dir=str(tmp_path / "i"), site=Site())
    assert refresh(spark, fetched, s)["n_pages"] == 1
    collection, search = commands.open_search(spark, s)
    assert any("Number 2" in r.text for r in collection.read().collect()) and search("words", 3).count() > 0
    assert refresh(spark, fetched, s, fresh_hours=1)["n_pages"] == 0


def test_refresh_takes_all_fetched_pages(spark, tmp_path):
    text = "<title>A</title><main><h1>Head</h1><p>" + "Some words here. " * 10 + "</p></main>"
    fetched = spark.createDataFrame([(f"https://www.example.edu/p{i}", text + f"<p>Number {i} of them all</p>") for i in range(7)], "url string, html string")
    s = Settings(raw_dir=str(tmp_path / "raw"), processed_dir=str(tmp_path / "p"), index_dir=str(tmp_path / "i"), site=Site(), max_pages=3)
    assert refresh(spark, fetched, s)["n_pages"] == 7


def test_a_vector_search_builds_no_index_of_words(spark, data, tmp_path, monkeypatch):
    from granary import queries as Q

    monkeypatch.setattr(Q, "_STORED", {})
    assert Q.QUERIES["vector_only_search"](spark, data).count() == 5
    assert [key[2] for key in Q._STORED] == ["collection"]


def test_an_upsert_of_distinct_ids_shuffles_no_rows(spark, tmp_path):
    from granary.operators.vectors import Collection

    c = Collection(spark, str(tmp_path), "c", "id bigint, text string")
    rows = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (None, "c", 0)], "id bigint, text string, seq int")
    assert "Aggregate" not in c._latest(rows, "seq", f"{tmp_path}/x")._jdf.queryExecution().toString()
    assert c.upsert(rows) == 3
    twice = rows.unionByName(spark.createDataFrame([(2, "z", 1), (2, "y", 1), (None, "d", 1)], "id bigint, text string, seq int"))
    assert sorted(map(tuple, c._latest(twice, "seq", f"{tmp_path}/y").collect()), key=repr) == [(1, "a"), (2, "z"), (None, "d")]


def test_queries_hand_bounded_batches_to_python(spark, data):
    from granary import queries as Q

    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}
    before = {x: spark.conf.get(x, None) for x in names}
    try:
        for x in names:
            spark.conf.unset(x)
        Q.QUERIES["chunk_documents"](spark, data)
        assert all(0 < int(spark.conf.get(x)) <= most for x, most in names.items())
    finally:
        for x, v in before.items():
            spark.conf.unset(x) if v is None else spark.conf.set(x, v)
