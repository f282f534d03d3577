"""The jobs: their queries against SQL, and runs over growing copies of the tables."""

import json
import os
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from granary.operators import changes as D
from jobs import chunk_documents, refresh_pages
from jobs.common import config
from jobs.queries import ORACLE, QUERIES
from tests.test_entry import same_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, data, name):
    same_rows(QUERIES[name](spark, data), ORACLE[name], data)


def rows(df, *leave):
    return Counter(tuple(r) for r in df.drop(*leave).select(*sorted(set(df.columns) - set(leave))).collect())


def test_the_stream_takes_only_new_files(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    parts = [docs.where(F.col("doc_id") % 3 == k).coalesce(1) for k in range(3)]
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    run = lambda c=chunk_documents.Config(): chunk_documents.run(spark, source, target, checkpoint, c)
    parts[0].write.parquet(source)
    first = run()
    assert first["documents"] == parts[0].where("length(text) >= 0").count() and first["chunks"] == chunk_documents.read_chunks(spark, target).count() > 0
    assert run() == {"batches": 0, "documents": 0, "bytes": 0, "chunks": 0}
    assert rows(chunk_documents.read_chunks(spark, target)) == rows(chunk_documents.chunks(parts[0]))
    parts[1].write.mode("append").parquet(source)
    parts[2].write.mode("append").parquet(source)
    second = run(chunk_documents.Config(files_per_batch=1))
    assert second["batches"] == 2 and first["documents"] + second["documents"] == docs.count()
    found = chunk_documents.read_chunks(spark, target)
    assert rows(found) == rows(chunk_documents.chunks(docs))
    assert found.count() == first["chunks"] + second["chunks"] and {f"lang={r.lang}" for r in found.select("lang").distinct().collect()} <= set(os.listdir(target))


def test_documents_of_all_kinds(spark, tmp_path):
    odd = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "short", None, "s", 5), (None, "words " * 30, None, None, 180), (5, "é漢🙂 " * 400, "x=/y", "", 9), (6, "z" * 1200, "", "s", 1200), (5, "é漢🙂 " * 400, "x=/y", "", 9)]
    spark.createDataFrame(odd, chunk_documents.DOCUMENT).withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "in"))
    run = lambda: chunk_documents.run(spark, *(str(tmp_path / x) for x in ("in", "out", "checkpoint")))
    run()
    run()
    found = chunk_documents.read_chunks(spark, str(tmp_path / "out")).collect()
    assert {r.doc_id for r in found} == {None, 5, 6} and all(50 <= r.n_chars <= 500 for r in found)
    assert {r.lang for r in found if r.doc_id == 5} == {"x=/y"} and {r.lang for r in found if r.doc_id is None} == {None}
    assert {r.lang for r in found if r.doc_id == 6} <= {None, ""}


def page(words, title="T"):
    return f"<html><title>{title}</title><body><article><h1>{title}</h1><p>{words * 12}</p></article></body></html>"


def stored(spark, path, found):
    spark.createDataFrame(found, "page_id long, url string, html string").coalesce(2).write.mode("overwrite").parquet(path)


def test_only_what_changed_is_refreshed(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda **c: refresh_pages.run(spark, source, out, refresh_pages.Config(**c))
    say = lambda: {(r.url, r.run): r.text for r in refresh_pages.read_current(spark, out).collect()}
    u = "http://a.example.org/"
    before = [(1, f"{u}1", page("alpha beta ")), (2, f"{u}2", page("gamma delta ")), (3, f"{u}3", page("epsilon zeta ")), (4, None, page("no url ")), (5, f"{u}none", None)]
    stored(spark, source, before)
    assert {k: v for k, v in run().items() if k != "chunks"} == {"run": 1, "read": 4, "new": 4, "changed": 0, "gone": 0, "same": 0}
    first = say()
    assert {k for k, _ in first} == {f"{u}{i}" for i in (1, 2, 3)}
    again = run()
    assert (again["run"], again["same"], again["new"]) == (2, 4, 0) and not os.path.exists(f"{out}/pages/run=2") and say() == first
    # one page changed, one new, one gone; of rows with one url the last counts, and equal rows count once
    stored(spark, source, [before[0], before[4], (6, f"{u}2", page("old again ")), (7, f"{u}2", page("changed text ")), (8, f"{u}4", page("eta theta ")), (8, f"{u}4", page("eta theta "))])
    kept = run()
    assert (kept["run"], kept["new"], kept["changed"], kept["gone"], kept["same"]) == (2, 1, 1, 0, 2)
    assert {k for k in say()} == {(f"{u}1", 1), (f"{u}2", 2), (f"{u}3", 1), (f"{u}4", 2)} and "changed text" in say()[f"{u}2", 2]
    gone = run(keep_gone=False)
    assert (gone["run"], gone["gone"], gone["same"]) == (3, 1, 4) and {k for k, _ in say()} == {f"{u}1", f"{u}2", f"{u}4"}
    assert run(keep_gone=False)["gone"] == 0
    whole = str(tmp_path / "whole")
    refresh_pages.run(spark, source, whole)
    assert rows(refresh_pages.read_current(spark, whole), "run") == rows(refresh_pages.read_current(spark, out), "run")
    stored(spark, source, before)  # it comes back
    assert run(keep_gone=False)["new"] == 1 and say()[f"{u}3", 4] == first[f"{u}3", 1]


def test_a_run_that_was_stopped_is_run_again(spark, tmp_path, monkeypatch):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    course = "https://h.example.edu/undergraduate/courses/2026/COMP1511"
    stored(spark, source, [(1, "http://a.example.org/1", page("alpha beta ")), (2, course, page("course words "))])
    refresh_pages.run(spark, source, out)
    first = rows(refresh_pages.read_current(spark, out))
    stored(spark, source, [(1, "http://a.example.org/1", page("other words ")), (2, course, page("more course words "))])
    with monkeypatch.context() as m:
        m.setattr(refresh_pages, "_fields", lambda schema: (_ for _ in ()).throw(RuntimeError("stopped")) if schema == refresh_pages.MARK else _real(schema))
        with pytest.raises(RuntimeError, match="stopped"):
            refresh_pages.run(spark, source, out)
    assert os.path.exists(f"{out}/chunks/run=2/type=course") and rows(refresh_pages.read_current(spark, out)) == first  # not seen before its mark
    stored(spark, source, [(1, "http://a.example.org/1", page("third words ")), (2, course, page("course words "))])
    assert refresh_pages.run(spark, source, out)["changed"] == 1
    assert not os.path.exists(f"{out}/chunks/run=2/type=course")  # what the stopped run left is gone
    found = refresh_pages.read_current(spark, out)
    assert {(r.url, r.run, r.type) for r in found.collect()} == {("http://a.example.org/1", 2, "general"), (course, 1, "course")}
    assert refresh_pages.marks(spark, out).count() == 2


_real = refresh_pages._fields


def test_unchanged_pages_are_neither_moved_nor_parsed(spark, tmp_path):
    """The refresh of few pages reads html, but shuffles fingerprints only."""
    stored(spark, str(tmp_path / "in"), [(i, f"http://a.example.org/{i}", page(f"word{i} ")) for i in range(200)])
    pages_ = spark.read.parquet(str(tmp_path / "in"))
    version = D.latest_version(pages_, ("page_id",))
    version.where("page_id < 3").write.parquet(str(tmp_path / "wanted"))
    found = D.content_of(pages_, spark.read.parquet(str(tmp_path / "wanted")), ("page_id",))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and found.count() == 3
    narrow = version._jdf.queryExecution().executedPlan().toString()
    assert "html" not in narrow[: narrow.index("Exchange")]


def test_settings(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"chunk_size": 400}))
    assert config(str(path), "x", ("chunk_size",)) == {"chunk_size": 400}
    with pytest.raises(ValueError, match="unknown"):
        config(str(path), "x", ("other",))
    assert set(config(None, "refresh_pages.json", tuple(refresh_pages.Config.__dataclass_fields__))) == set(refresh_pages.Config.__dataclass_fields__)
    assert chunk_documents.Config(**config(None, "chunk_documents.json", tuple(chunk_documents.Config.__dataclass_fields__))) == chunk_documents.Config()


@pytest.mark.parametrize("job", ["chunk_documents", "refresh_pages"])
def test_command_lines(data, tmp_path, job):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = {"chunk_documents": ["--documents", f"{data}/documents.parque?", "--chunks", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "checkpoint")], "refresh_pages": ["--pages", f"{data}/pages.parquet", "--out", str(tmp_path / "out")]}[job]
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}
    done = subprocess.run([sys.executable, os.path.join(root, "jobs", f"{job}.py"), *paths], cwd=str(tmp_path), env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "granary.jobs" in done.stderr and os.path.exists(tmp_path / "out")
