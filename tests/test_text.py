import pytest
from pyspark.sql import functions as F

from granary.config import Settings, Site
from granary.functions import text as X
from granary.functions import vectors as V
from granary.functions.html import join_urls


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(column).collect()]


def test_urls_are_normalized(spark):
    urls = ["HTTPS://www.example.edu:80/a/b/?q=1#x", "http://u@h/a;p=1", "http://h", "http://h///", "/a/b", "mailto:x@y"]
    assert values(spark, urls, X.normalize_url(F.col("x"))) == ["https://www.example.edu:80/a/b", "http://u@h/a", "http://h", "http://h", ":///a/b", "mailto://x@y"]


def test_extensions_follow_dots(spark):
    urls = ["http://h/a.PDF", "http://h/.bashrc", "http://h/..a.b", "http://h/a.b/c", "http://h/x.tar.gz?y=.zip", "http://h.pdf"]
    assert values(spark, urls, X.url_extension(F.col("x"))) == [".pdf", "", ".b", "", ".gz", ""]


def test_skipped_urls(spark):
    urls = ["http://h/a#frag", "http://h/a?page=2", "http://h/a?q=1", "http://h/A.PDF", "mailto:a@b", "http://h/Search/x", "http://h/a"]
    assert values(spark, urls, X.skipped_url(F.col("x"))) == [True, True, False, True, True, True, False]


def test_valid_links_stay_on_the_site(spark):
    urls = ["https://www.example.edu/a", "https://other.example.edu/a", "ftp://www.example.edu/a", "", None, "https://www.example.edu/login"]
    assert values(spark, urls, X.valid_link(F.col("x"), Site().allowed_domains)) == [True, False, False, False, False, False]


def test_links_are_resolved(spark):
    base = F.lit("https://h.example/a/b?x")
    hrefs = ["/c", "//g/d", "http://o/e", "f"]
    assert values(spark, hrefs, X.resolve_link(base, F.col("x"))) == ["https://h.example/c", "https://g/d", "http://o/e", None]
    assert values(spark, hrefs, join_urls(base, F.col("x"))) == ["https://h.example/c", "https://g/d", "http://o/e", "https://h.example/a/f"]


def test_catalogue_urls_are_told_apart(spark):
    urls = ["/undergraduate/courses/2026/COMP1511", "/undergraduate/programs/2026/3778", "/research/courses/2026", None]
    assert values(spark, urls, X.page_kind(F.col("x"))) == ["course", "program", None, None]
    assert values(spark, urls, X.code_of(F.col("x"), "course")) == ["COMP1511", "", "", None]


def test_text_is_cleaned_like_strings_are(spark):
    from granary.functions.html import cleaned

    texts = ["a\nline  one\t\nline one\n\nother line \nline one", "  em \xa0 space 　\nxyz\nabcd", "", None]
    assert values(spark, texts, X.clean_text(F.col("x"))) == [cleaned(x or "") for x in texts]


def test_tokens_are_of_any_script(spark):
    assert values(spark, ["Élan, x_1 中文!", None], F.array_join(X.tokens(F.col("x")), "|")) == ["élan|x_1|中文", ""]


def test_titles_credits_and_lists(spark):
    assert values(spark, ["Fees | Example Uni", "Fees"], X.without_brand(F.col("x"), "Example")) == ["Fees", "Fees"]
    assert values(spark, ["Handbook – COMP1511"], X.without_handbook(F.col("x"))) == ["COMP1511"]
    assert values(spark, ["is 6 Units of Credit", "none"], X.credits(F.col("x"))) == ["6", ""]
    assert values(spark, [" a, b ,,c"], F.array_join(X.list_of(F.col("x")), "|")) == ["a|b|c"]


def test_embedded_json(spark):
    page = '<script id="__NEXT_DATA__" type="application/json">{"a": 1}</script>'
    assert values(spark, [page, "<p>", page.replace("}", "")], F.to_json(X.embedded_json(F.col("x")))) == ['{"a":1}', None, None]


@pytest.mark.parametrize(("text", "html"), [("# T", "<h1>T</h1>"), ("**b** *i* `c`", "<p><strong>b</strong> <em>i</em> <code>c</code></p>"), ("a\nb", "<p>a<br>b</p>"), ("", ""), ("- x\n- y", "<ul><li>x</li><li>y</li></ul>"), ("<i>", "<p>&lt;i&gt;</p>"), ("1. x\n2. y\n\nz `**k**", "<ol><li>x</li><li>y</li></ol><p>z `<strong>k</strong></p>"), ("`a*b*` [x](javascript:y)", "<p><code>a*b*</code> [x](javascript:y)</p>"), ("[t](http://u)", '<p><a href="http://u" target="_blank" rel="noopener">t</a></p>')])
def test_markdown(spark, text, html):
    assert values(spark, [text], X.render_markdown(F.col("x"))) == [html]


def test_response_times(spark):
    assert [r[0] for r in spark.sql("SELECT * FROM VALUES (1000), (1500) AS t(ms)").select(X.response_time(F.col("ms"))).collect()] == ["1000ms", "1.5s"]


def test_vectors(spark):
    row = spark.range(1).select(V.dot(F.lit([1.0, 2.0]), F.lit([3.0, 4.0])), V.cosine_distance(F.lit([1.0, 0.0]), F.lit([0.0, 2.0])), V.normalized(F.lit([3.0, 4.0])), V.normalized(F.lit([0.0, 0.0]))).first()
    assert row[0] == 11 and row[1] == 1 and row[2] == [0.6, 0.8] and row[3] == [0, 0]


def test_settings_come_from_the_environment():
    s = Settings.from_env({"MAX_PAGES": "7", "ALLOWED_DOMAINS": "a.b, c.d,"})
    assert s.max_pages == 7 and s.site.allowed_domains == ("a.b", "c.d") and s.chunk_size == 500


def test_response_times_are_those_of_to_fixed(spark):
    from decimal import ROUND_HALF_UP, Decimal

    found = spark.range(50, 200_000, 100).select("id", X.response_time(F.col("id")).alias("label")).collect()
    assert all(r.label == (f"{Decimal(r.id / 1000).quantize(Decimal('0.1'), ROUND_HALF_UP)}s" if r.id > 1000 else f"{r.id}ms") for r in found)
    assert {r.label for r in found if r.id in (1050, 1150, 1250)} == {"1.1s", "1.3s"}
    assert spark.range(1).select(X.response_time(F.lit(None).cast("long"))).first()[0] is None


def test_every_document_has_a_response_label(spark, tmp_path):
    from granary.queries import QUERIES

    rows = [(1, 1050, "a<b"), (2, 1150, "c"), (3, None, "d&e"), (4, 50, None), (5, 1234, "f")]
    spark.createDataFrame(rows, "doc_id long, n_chars long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: (r.label, r.escaped) for r in QUERIES["response_labels"](spark, str(tmp_path)).collect()}
    assert found == {1: ("1.1s", "a&lt;b"), 2: ("1.1s", "c"), 3: (None, "d&amp;e"), 4: ("50ms", None), 5: ("1.2s", "f")}
