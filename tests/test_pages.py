import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary import schemas
from granary.config import Settings, Site
from granary.functions import html as H
from granary.functions.splitter import split_text
from granary.operators import chunks, crawl, pages
from granary.sources import files

PAGE = """<html><head><title>Enrol | Example Uni</title><meta name="description" content="How to"></head><body><header><h1>Lost</h1></header><nav>menu here</nav>
<div class="page-breadcrumbs"><a>Home</a><a> Study </a></div><main><h1>Enrol now</h1><p>First paragraph of it<p>Second <b>paragraph</b> of it<h2>Dates</h2><div><p>Begins in the autumn</p></div>
<div class="sidebar">not this one</div><script>var x = 1;</script></main></body></html>"""


def test_general_page():
    p = H.read_page(PAGE, "Example")
    assert (p["title"], p["h1"], p["meta_description"], p["breadcrumbs"]) == ("Enrol", "Enrol now", "How to", ["Home", "Study"])
    assert p["content"] == "Enrol now\nFirst paragraph of it\nSecond\nparagraph\nof it\nDates\nBegins in the autumn"
    assert p["sections"] == [{"heading": "Enrol now", "content": "First paragraph of it\nSecondparagraphof it"}, {"heading": "Dates", "content": "Begins in the autumn"}]


CUT = """<title>Bread &amp; butter&amp</title><body><nav>menu</nav><div class="ad">Buy now &am</div><article><h1>Bread &amp; butter&amp</h1><p>Of R&D &lt;b&gt; and &notit; &copy &#38; more, long enough to be a chunk of its own.</p></article></body>"""


def test_a_cut_reference_is_text():
    p = H.read_page(CUT, "")
    assert p["title"] == p["h1"] == "Bread & butter&amp" and p["sections"][0]["content"].startswith("Of R&D <b> and &notit; &copy & more")
    assert H.parse('<a href="?a=1&lt=2&amp;b=3">x</a><script>a&amp b</script>').text() == "xa&amp b"
    assert H.parse('<a href="?a=1&lt=2&amp;b=3">').children[0].attributes == {"href": "?a=1&lt=2&b=3"}


@pytest.mark.parametrize("name", ["page_heads", "html_extract", "typed_page_parse", "chunk_pages", "job2_refresh_pages"])
def test_pages_with_cut_references_are_those_of_the_sql(spark, tmp_path, name):
    import duckdb

    import __spark_entry__

    page = CUT.replace(" and &notit; &copy &#38;", " and")
    spark.createDataFrame([(1, "http://a.example/x", page), (2, "http://a.example/y", page.replace("butter&amp<", "butter&l<"))], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = __spark_entry__.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    columns = ", ".join(sorted(found.columns))
    want = con.sql(f"SELECT {columns} FROM ({__spark_entry__.oracle_sql()[name]}) ORDER BY ALL").fetchall()
    assert sorted(map(repr, map(tuple, found.select(*sorted(found.columns)).collect()))) == sorted(map(repr, want)) != []


def test_nested_text_is_taken_once_in_leaf_mode():
    page = "<main><div>some words <p>a longer paragraph</p> more words</div></main>"
    assert H.read_page(page, "")["sections"][0]["content"] != H.read_page(page, "", "leaf")["sections"][0]["content"] == "a longer paragraph"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "</p></p>", "<!--", "<table><td>a<td>b</table>", "<p><div></p>", "x" * 10000])
def test_broken_html_does_not_raise(page):
    H.read_page(page, "x")
    H.read_typed_page(page, "course")


COURSE = """<title>Handbook - Programming</title><h2 data-testid="ai-header">Programming Basics</h2><p>6 Units of Credit</p>
<div class="AccordionItem"><h3>Overview</h3><p>An introduction to programming in C.</p></div>
<div class="Card"><h3>Conditions for Enrolment</h3><p>Prerequisite: none at all, really.</p></div>
<section data-testid="Fees"><p>About a thousand dollars.</p></section><div><strong>Faculty</strong><span>Engineering</span></div><div><b>Offering Terms</b><i>Term 1</i></div>"""


def test_course_page(spark):
    url = "https://h.example.edu/postgraduate/courses/2026/COMP1511"
    r = pages.typed_pages(spark.createDataFrame([(url, COURSE), ("https://h.example.edu/x", COURSE)], "url string, html string"), Site()).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.type, r.course_code, r.level, r.uoc, r.faculty, r.offering_terms) == ("course", "COMP1511", "postgraduate", "6", "Engineering", "Term 1")
    assert r.title == "COMP1511 — Programming Basics" and r.breadcrumbs == ["Example Handbook", "Postgraduate", "Courses", "COMP1511"]
    assert r.content.split("\n\n") == ["Overview: An introduction to programming in C.", "Conditions for Enrolment / Prerequisites: Prerequisite: none at all, really.", "Fees: About a thousand dollars."]
    assert r.sections[1].heading == "Conditions for Enrolment / Prerequisites" and r.meta_description == "COMP1511 Programming Basics - 6 UOC - Example Postgraduate"


def test_program_page_falls_back_to_its_body(spark):
    url = "https://h.example.edu/undergraduate/programs/2026/3778"
    html = "<title>Handbook – Computing</title><body><nav>menu menu</nav><p>A whole program of study.</p><div><b>Duration</b><i>3 Years</i></div></body>"
    r = pages.typed_pages(spark.createDataFrame([(url, html)], "url string, html string"), Site()).first()
    assert (r.program_code, r.title, r.duration, r.uoc) == ("3778", "Program 3778 — Computing", "3 Years", None)
    assert r.content == "Handbook – Computing\nA whole program of study.\nDuration\n3 Years" or r.content.startswith("A whole program")


@given(st.text(alphabet="ab .,;!?\n中", max_size=1500))
def test_pieces_cover_a_text(text):
    found = split_text(text, 50, 12)
    assert all(0 < len(x) <= 50 for x in found) and found == split_text(text, 50, 12)
    at = 0
    for x in found:  # each piece is a part of the text, and they leave out white space only
        i = text.find(x, max(0, at - 50))
        assert i >= 0 and not text[at:i].strip()
        at = max(at, i + len(x))
    assert not text[at:].strip()


def test_splitter_prefers_paragraphs():
    assert split_text("a" * 30 + "\n\n" + "b" * 30, 40, 0) == ["a" * 30, "b" * 30]
    assert split_text("", 10, 2) == [] and split_text("x" * 25, 10, 2) == ["x" * 10, "x" * 10, "x" * 9]


def make(spark, *rows):
    names = [x.split()[0] for x in schemas.PAGE.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.PAGE)


def test_chunks_of_sections_count_over_the_page(spark):
    long = "word " * 150
    found = chunks.chunk_pages(make(spark, {"url": "u", "title": "t", "breadcrumbs": ["A", "B"], "content": "x", "sections": [("H", long), ("short", "no"), ("H", long)]})).collect()
    assert [r.metadata.chunk_index for r in found] == list(range(len(found))) and len(found) == 4
    assert len({r.id for r in found}) == 2  # equal headings share ids
    assert found[0].metadata.breadcrumbs == "A > B" and found[0].text.startswith("word") and found[0].metadata.content_type is None


def test_chunks_without_sections(spark):
    found = chunks.chunk_pages(make(spark, {"url": "u", "content": "sentence one. " * 60}, {"url": "v", "content": "short"})).collect()
    assert {r.metadata.url for r in found} == {"u"} and all(50 <= len(r.text) <= 500 for r in found)
    assert [r.metadata.chunk_index for r in found] == list(range(len(found)))


def test_typed_chunks(spark):
    short = {"url": "c", "type": "course", "title": "COMP — P", "uoc": "6", "level": "undergraduate", "faculty": "E", "content": "tiny"}
    long = {"url": "p", "type": "program", "title": "Program", "duration": "3", "uoc": "9", "content": "A sentence here. " * 120}
    found = chunks.chunk_pages(make(spark, short, long)).collect()
    one = [r for r in found if r.metadata.url == "c"]
    assert len(one) == 1 and one[0].text == "COMP — P\n6 Units of Credit\nLevel: Undergraduate\nFaculty: E\n\ntiny" and one[0].metadata.content_type == "course"
    more = [r for r in found if r.metadata.url == "p"]
    assert len(more) > 3 and all(r.text.startswith("Program\nDuration: 3\n\n") for r in more)


def test_statistics_of_nothing(spark):
    empty = make(spark).limit(0)
    r = chunks.chunk_statistics(empty, chunks.chunk_pages(empty)).first()
    assert (r.n_pages, r.n_chunks, r.chunks_per_page) == (0, 0, 0)


def test_json_lines_are_read_tolerantly(spark, tmp_path):
    path = tmp_path / "pages.jsonl"
    path.write_text('{"url": "a", "content": "x"}\n\n{broken\n{"url": "b"}\n')
    found = files.read_pages(spark, str(path), str(tmp_path / "none"))
    assert sorted((r.url, r.src_ord) for r in found.collect()) == [("a", 0), ("b", 0)]
    assert files.read_chunks(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_pages(spark, str(tmp_path / "none"))


def test_crawl_depths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("d", "e")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "url string")
    assert sorted(map(tuple, crawl.crawl_depths(edges, start).collect())) == [("a", 0), ("b", 1), ("c", 1)]
    assert crawl.crawl_depths(edges, start, max_pages=2).count() == 2


def test_new_and_detail_links(spark):
    html = '<a href="/undergraduate/courses/2026/COMP1511">x</a><a class=y href="/b#f">y</a><a href="">z</a>'
    rows = spark.createDataFrame([("https://h.example.edu/b/", html)], "url string, html string")
    assert [tuple(r) for r in crawl.detail_links(rows).collect()] == [("https://h.example.edu/undergraduate/courses/2026/COMP1511", "course")]
    assert [r.norm_url for r in crawl.new_links(crawl.links(rows), rows).collect()] == ["https://h.example.edu/undergraduate/courses/2026/COMP1511"]


def test_carried_headings(spark):
    nodes = spark.createDataFrame([(1, 0, None), (1, 1, "H"), (1, 2, None), (2, 0, None)], "page_id int, pos int, heading string")
    assert sorted((r.page_id, r.pos, r.section_heading) for r in pages.carried_headings(nodes).collect()) == [(1, 0, ""), (1, 1, "H"), (1, 2, "H"), (2, 0, "")]


def test_response_filters(spark):
    rows = spark.createDataFrame([(200, "text/html; x"), (404, "text/html"), (200, "image/png")], "status int, content_type string")
    assert pages.html_only(pages.succeeded(rows)).count() == 1
    assert pages.fresh_responses(rows.withColumn("fetched_at", F.current_timestamp() - F.expr("INTERVAL 25 HOURS"))).count() == 0


def test_settings_of_chunks():
    assert (Settings().chunk_size, Settings().chunk_overlap, Settings().min_chunk) == (500, 80, 50)


def test_links_of_all_kinds(spark):
    from urllib.parse import urljoin

    base = "https://h.example/a/b?x"
    hrefs = ["page2.html", "../x", "?page=2", "#f", "/c/../d", "/e", "//g/i", "http://o/e", "HTTPS://h.example/q", "https:r", "mailto:u@h", " /s ", "/t;", "./undergraduate/courses/2026/COMP1511", "http://[bad"]
    forms = ["<a href='{}'>", '<A HREF="{}">', '<a title="a > b" data-href="no" href = "{}" href="no">']
    html = "".join(forms[i % 3].format(x) for i, x in enumerate(hrefs)) + "<a\nhref=un/quoted class=z><a href><a><abbr href=no><a href=it's><a href=>" + '<a x="' + "y" * 9 + " z" * 20_000 + '" href=last>'
    rows = spark.createDataFrame([(base, html)], "url string, html string")
    found = {r.href: r.url for r in crawl.links(rows).collect()}
    want = {x: urljoin(base, x) for x in [*hrefs[:-1], "un/quoted", "it's", "last"]} | {"http://[bad": None}
    assert found == want
    new = {r.norm_url for r in crawl.new_links(crawl.links(rows), rows).collect()}
    assert {"https://h.example/a/page2.html", "https://h.example/x", "https://h.example/a/un/quoted", "https://h.example/d"} <= new and None not in new and "https://h.example/a/b" not in new
    assert [tuple(r) for r in crawl.detail_links(rows).collect()] == [("https://h.example/a/undergraduate/courses/2026/COMP1511", "course")]


def test_hostile_pages_are_searched_for_links_in_linear_time(spark):
    """A megabyte of beginnings of tags; what stands before them is found."""
    import time

    from granary.functions import text as X

    for part in ("<a ", '<a x="', "<a href=", "<a <a", "<a x='y\" ", "<a/"):
        rows = spark.createDataFrame([("<a href=first>" + part * (1_000_000 // len(part)),)], "html string")
        began = time.time()
        assert rows.select(X.hrefs(F.col("html")).alias("h")).first().h[0] == "first"
        assert time.time() - began < 5, part
    rows = spark.createDataFrame([("<a href=1><a <a href=2><a x='>' href=3>text<a href=4",)], "html string")
    assert rows.select(X.hrefs(F.col("html")).alias("h")).first().h == ["1", "2", "3"]


def test_a_frontier_has_valid_links_only(spark):
    base = "http://a.example.org/x"
    html = "".join(f"<a href='{x}'>" for x in ("y", "y/", "/z?q=1", "mailto:x@y.z", "http://evil.com/p", "/search", "/f.pdf", "#top", "http://b.example.org/k", "x", "//a.example.org/w"))
    rows = spark.createDataFrame([(base, html), ("http://a.example.org/w", "")], "url string, html string")
    found = lambda *more: sorted(r.norm_url for r in crawl.frontier(rows, ("a.example.org", "b.example.org"), *more).collect())
    assert found() == ["http://a.example.org/y", "http://a.example.org/z", "http://b.example.org/k"]
    assert found(spark.createDataFrame([("http://b.example.org/k/",)], "url string")) == ["http://a.example.org/y", "http://a.example.org/z"]


def test_deep_pages_take_time_in_proportion():
    import time

    from granary.functions.html import read_page, read_typed_page

    def seconds(n):
        page = "<div>" * n + "Overview of things and more of it"
        began = time.process_time()
        assert read_page(page, "B")["sections"][0]["content"] == "Overview of things and more of it"
        read_typed_page(page, "course")
        return time.process_time() - began

    seconds(1000)
    assert seconds(40_000) < 40 * max(seconds(4000), 0.02)


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from granary.runtime import shared_dir

    def session(master, folder=None):
        values = {"spark.checkpoint.dir": folder}
        conf = SimpleNamespace(get=lambda k, d=None: values.get(k) or d, set=values.__setitem__)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))

    assert shared_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    own = session("local[2]")
    assert shared_dir(own) == shared_dir(own)
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))
