"""Queries over the test tables, one for each operator, and SQL that gives the same rows.

Scores are rounded to six decimals before they are ranked, here and in the SQL:
the two engines add up in other orders. The operators themselves don't round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.config import Settings, Site
from granary.functions import text as X
from granary.functions import vectors as V
from granary.functions.html import join_urls, page_fields
from granary.operators import answer, chunks, crawl, lexical, pages, retrieve, vectors
from granary.operators.text_index import TextIndex
from granary.operators.vector_index import VectorIndex
from granary.runtime import prepared, shared_path, table
from granary.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
QUESTION = "the of payment return shipping the"
SITE = Site()
#: Hosts that belong to the crawled site are a list of its settings; here, some of the table's.
HOSTS = ("blog.tionsh.example.net", "thther.example.org", "blog.ththan.example.net", "blog.tiontion.example.com", "www.ththhe.example.com", "m.ththth.example.net")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepared(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


TOKENS = r"toks AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents)"
TERMS = TOKENS + """,
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(w) AS term FROM toks) GROUP BY term),
n AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM toks),
idf AS (SELECT term, df, ln(n - df + 0.5e0) - ln(df + 0.5e0) AS idf FROM df, n)"""
BM25 = TERMS + r""",
m AS (SELECT avg(idf) AS mean FROM idf),
q AS (SELECT term, count(*) AS times FROM (SELECT unnest(regexp_extract_all('the of payment return shipping the', '[\p{L}\p{N}_]+')) AS term) GROUP BY term),
qi AS (SELECT q.term, times, CASE WHEN idf < 0 THEN 0.25e0 * mean ELSE idf END AS idf FROM q JOIN idf USING (term), m),
tf AS (SELECT doc_id, len(w) AS dl, qi.term, times, idf, len(list_filter(w, lambda x: x = qi.term)) AS tf FROM toks, qi),
bm AS (SELECT doc_id, round(sum(CASE WHEN tf > 0 THEN times * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl)) ELSE 0 END), 6) AS score FROM tf, n GROUP BY doc_id)"""
HASHED = r""",
b AS (SELECT doc_id, ('0x' || md5(term)[1:8])::BIGINT % 384 AS b, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest(w) AS term FROM toks) GROUP BY ALL),
qb AS (SELECT ('0x' || md5(term)[1:8])::BIGINT % 384 AS b, sum(times)::DOUBLE AS n FROM q GROUP BY ALL),
sim AS (SELECT t.doc_id, round(coalesce(s.dot / (s.len * (SELECT sqrt(sum(n * n)) FROM qb)), 0), 6) AS similarity FROM toks t LEFT JOIN
  (SELECT doc_id, sqrt(sum(b.n * b.n)) AS len, coalesce(sum(b.n * qb.n), 0) AS dot FROM b LEFT JOIN qb USING (b) GROUP BY doc_id) s USING (doc_id))"""
RANKED = BM25 + HASHED + """,
bmk AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 20),
veck AS (SELECT doc_id, similarity, row_number() OVER (ORDER BY similarity DESC, doc_id) AS rank FROM sim QUALIFY rank <= 20),
both_lists AS (SELECT doc_id, 0 AS place, rank, 0.6e0 / (60 + rank) AS part FROM veck UNION ALL SELECT doc_id, 1, rank, 0.4e0 / (60 + rank) FROM bmk WHERE score > 0),
keyed AS (SELECT x.*, substr(text, 1, 100) AS key FROM both_lists x JOIN documents USING (doc_id)),
fused AS (SELECT key, arg_min(doc_id, place * 1000000 + rank) AS doc_id, round(sum(part), 6) AS score, min(place * 1000000 + rank) AS seq,
  min(CASE WHEN place = 0 THEN rank END)::INT AS vector_rank, max(CASE WHEN place = 1 THEN rank END)::INT AS bm25_rank FROM keyed GROUP BY key),
best AS (SELECT doc_id, score, vector_rank, bm25_rank, row_number() OVER (ORDER BY score DESC, seq) AS rank FROM fused QUALIFY rank <= 5)"""
RESULTS = RANKED + """,
res AS (SELECT rank, d.text, 'https://www.' || d.source || '.example/' || d.lang AS url, d.lang || ' ' || d.source AS title, d.lang AS heading FROM best JOIN documents d USING (doc_id))"""


@query(f"WITH {TOKENS} SELECT doc_id, len(w)::BIGINT AS n_tokens, len(list_distinct(w))::BIGINT AS n_terms FROM toks")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = X.tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.size(F.array_distinct(w)).cast("long").alias("n_terms"))


@query(f"WITH {TERMS} SELECT term, df, round(idf, 6) AS idf FROM idf")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_statistics(_docs(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


@query(f"WITH {TOKENS} SELECT doc_id, len(w)::BIGINT AS dl FROM toks")
def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.lengths(_docs(spark, sf_dir), "doc_id").withColumnRenamed("id", "doc_id")


@query(f"WITH {TOKENS} SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM toks) GROUP BY ALL")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(_docs(spark, sf_dir), "doc_id").select("term", F.col("id").alias("doc_id"), "tf")


@query(f"WITH {TERMS} SELECT count(*)::BIGINT AS n, round((SELECT avgdl FROM n), 6) AS avgdl, (SELECT round(avg(idf), 6) FROM idf) AS mean_idf FROM documents")
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    out = lexical.totals(docs, lexical.term_statistics(docs))
    return out.select("n", F.round("avgdl", 6).alias("avgdl"), F.round("mean_idf", 6).alias("mean_idf"))


_STORED: dict[tuple, tuple[str, TextIndex | DataFrame]] = {}
METADATA = "struct<url:string,title:string,section_heading:string,doc_id:bigint>"


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[str], TextIndex | DataFrame]) -> TextIndex | DataFrame:
    """What ``make`` writes at a path: once for each application and folder, anew if it has been removed."""
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _STORED or not files.exists(spark, _STORED[key][0]):
        path = shared_path(spark, name)
        _STORED[key] = path, make(path)
    return _STORED[key][1]


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.struct(F.concat(F.lit("https://www."), "source", F.lit(".example/"), "lang").alias("url"), F.concat_ws(" ", "lang", "source").alias("title"), F.col("lang").alias("section_heading"), "doc_id")
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", meta.alias("metadata"))


def _index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The documents' index, read from disk."""
    return _once(spark, sf_dir, "words", lambda path: TextIndex(spark, path).add(_searched(spark, sf_dir)))


def _collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' collection, read from disk; it needs no index."""

    def make(path: str) -> DataFrame:
        out = vectors.Collection(spark, path, "documents", f"id bigint, text string, metadata {METADATA}, embedding array<double>")
        out.upsert(_searched(spark, sf_dir).withColumn("embedding", vectors.hashed_embedding(F.col("text"))).withColumn("seq", F.lit(0)))
        return out.read()

    return _once(spark, sf_dir, "collection", make)


@query(f"WITH {TERMS} SELECT (SELECT count(*) FROM documents) AS n_documents, (SELECT count(*) FROM idf) AS n_terms, (SELECT sum(len(list_distinct(w)))::BIGINT FROM toks) AS n_postings, (SELECT count(DISTINCT doc_id) FROM documents) AS n_vectors")
def search_index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the index and the collection that the search queries read, and counts what they hold."""
    for name in ("words", "collection"):
        _STORED.pop((spark.sparkContext.applicationId, sf_dir, name), None)
    index, collection = _index(spark, sf_dir), _collection(spark, sf_dir)
    one = index.terms.agg(F.count("*").alias("n_terms")).withColumn("n_documents", F.lit(index.n))
    return one.crossJoin(index.blocks.agg(F.sum("n").alias("n_postings"))).crossJoin(collection.agg(F.count("*").alias("n_vectors")))


TOP = f"WITH {BM25} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm WHERE score > 0 QUALIFY rank <= 20"


@query(TOP)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).search(QUESTION, 20, 6).select(F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


@query(rf"""WITH {TERMS}, m AS (SELECT avg(idf) AS mean FROM idf),
q AS (SELECT question_id, term, count(*) AS times FROM (SELECT conv_id || '-' || turn AS question_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM conversations WHERE length(text) BETWEEN 2 AND 1000) GROUP BY ALL),
w AS (SELECT question_id, term, times * CASE WHEN idf < 0 THEN 0.25e0 * mean ELSE idf END AS weight FROM q JOIN idf USING (term), m),
tf AS (SELECT doc_id, len(w) AS dl, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM toks) GROUP BY ALL),
s AS (SELECT question_id, doc_id, round(sum(weight * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 6) AS score FROM w JOIN tf USING (term), n GROUP BY ALL)
SELECT question_id, doc_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 5""")
def bm25_topk_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents for every valid question of the conversations."""
    asked = answer.valid_questions(table(spark, sf_dir, "conversations")).select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), "text")
    out = _index(spark, sf_dir).search_many(asked, 5, 6)
    return out.select("question_id", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {BM25} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm WHERE score > 0 QUALIFY rank <= 20")
def bm25_increments_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From an index that grew in three steps: some documents, all others and older versions of some, and their true versions."""
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    old = docs.where("id % 5 = 1").withColumn("text", F.concat(F.lit("shipping payment "), F.substring("text", 1, 300)))
    index = TextIndex(spark, shared_path(spark, "increments")).add(docs.where("id % 3 = 0 and id % 5 <> 1"))
    index = index.add(docs.where("id % 3 <> 0 and id % 5 <> 1").unionByName(old)).add(docs.where("id % 5 = 1"), replace=True)
    return index.search(QUESTION, 20, 6).select(F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


@query(TOP)
def bm25_scan_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without an index."""
    best = lexical.top_k(lexical.scan_scores(_docs(spark, sf_dir), QUESTION, "doc_id").select("id", "score"), 20, 6)
    return best.select(F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {BM25} SELECT doc_id, score FROM bm JOIN toks USING (doc_id) WHERE list_has_any(w, ['the', 'of', 'payment', 'return', 'shipping'])")
def bm25_index_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    ids = index.documents().select("segment", "row", F.col("id").alias("doc_id"))
    return index.scores(QUESTION).join(ids, ["segment", "row"]).select("doc_id", F.round("score", 6).alias("score"))


NEAR = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE vec_id = 0),
d AS (SELECT vec_id, label, round(1 - list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))), 6) AS distance FROM e, q {where}),
r AS (SELECT vec_id, label, distance, round(1 - distance, 6) AS similarity, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM d QUALIFY rank <= 20) SELECT * FROM r"""


def _near(spark: SparkSession, sf_dir: str, where: object = None) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("query"))
    out = vectors.search(e, q, 20, where, "vec_id", digits=6)
    return out.select("vec_id", "label", "distance", "similarity", F.col("rank").cast("long").alias("rank"))


@query(NEAR.format(where=""))
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir)


@query(NEAR.format(where="WHERE label = 3"))
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, F.col("label") == 3)


_INDEXED: dict[tuple, VectorIndex] = {}


def _vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The embeddings' inverted file, written once for each application and folder, anew if it has been removed."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _INDEXED or not files.exists(spark, _INDEXED[key].path):
        _INDEXED[key] = VectorIndex.build(table(spark, sf_dir, "embeddings"), shared_path(spark, "vectors"), id="vec_id")
    return _INDEXED[key]


@query(NEAR.format(where=""))
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, through the index: a few lists, then those that their bounds don't rule out."""
    q = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first().embedding
    out = _vector_index(spark, sf_dir).search([float(x) for x in q], 20, digits=6)
    return out.select("vec_id", "label", "distance", "similarity", F.col("rank").cast("long").alias("rank"))


def _asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
d AS (SELECT q.vec_id AS query_id, e.vec_id, round(1 - list_dot_product(q.v, e.v) / (q.n * e.n), 6) AS distance FROM e q JOIN e ON q.vec_id % 100 = 0 AND q.n > 0 AND e.n > 0)
SELECT query_id, vec_id, abs(distance) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d QUALIFY rank <= 20""")
def vector_topk_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, for a table of queries: those whose id is divisible by 100, against all rows, in blocks."""
    out = _vector_index(spark, sf_dir).search_many(_asked_vectors(spark, sf_dir), 20, digits=6)
    return out.select("query_id", F.col("id").alias("vec_id"), F.abs("distance").alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a search finds 0.95 of the true twenty nearest, with as many probes as a twentieth of the rows needs for 0.99; these aren't the ones that are asked."""
    index, k = _vector_index(spark, sf_dir), 20
    sample = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 10").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    probes, asked = index.probes_for(sample, k, 0.99), _asked_vectors(spark, sf_dir)
    true, found = (index.search_many(asked, k, p).select("query_id", "id") for p in (None, probes))
    both = true.join(found.withColumn("found", F.lit(1)), ["query_id", "id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), (F.count("found") >= 0.95 * F.count("*")).alias("reached"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS length, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS unit_sum FROM embeddings")
def normalize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(v), 6).alias("length"), F.round(F.aggregate(V.normalized(v), F.lit(0.0), lambda s, x: s + x), 6).alias("unit_sum"))


@query(f"WITH {BM25}{HASHED} SELECT doc_id, similarity FROM sim")
def hashed_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.hashed_similarity(_docs(spark, sf_dir), QUESTION, "doc_id").select(F.col("id").alias("doc_id"), F.round("similarity", 6).alias("similarity"))


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.hybrid_search(_index(spark, sf_dir), _collection(spark, sf_dir), QUESTION, 5, digits=6)


@query(f"WITH {RANKED} SELECT doc_id, score, vector_rank, bm25_rank, rank FROM best")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir).select("metadata.doc_id", "score", "vector_rank", "bm25_rank", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {RESULTS} SELECT 'CONTEXT:' || chr(10) || string_agg('[Source ' || rank || '] ' || title || ' — ' || heading || chr(10) || 'URL: ' || url || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'QUESTION: the of payment return shipping the' || chr(10) || chr(10) || 'Answer from these sources and from nothing else. Say after each statement which source it comes from, by its URL, and list the URLs that you used at the end.' AS prompt FROM res")
def context_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.context_prompt(_hybrid(spark, sf_dir), QUESTION)


@query(f"WITH {RESULTS} SELECT url, arg_min(title, rank) AS title, min(rank) AS rank FROM res GROUP BY url")
def unique_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.unique_sources(_hybrid(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {RANKED} SELECT doc_id, similarity, rank FROM veck WHERE rank <= 5")
def vector_only_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = retrieve.vector_only_search(_collection(spark, sf_dir), QUESTION, 5, digits=6)
    return best.select(F.col("id").alias("doc_id"), "similarity", F.col("rank").cast("long").alias("rank"))


LISTS = """a AS (SELECT doc_id, text, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 200),
b AS (SELECT doc_id, text, row_number() OVER (ORDER BY n_chars DESC, doc_id DESC) AS rank FROM documents WHERE lang = 'en' QUALIFY rank <= 200)"""


@query(f"""WITH {LISTS}, u AS (SELECT substr(text, 1, 100) AS key, doc_id, 0 AS place, rank, 0.6e0 / (60 + rank) AS part FROM a UNION ALL SELECT substr(text, 1, 100), doc_id, 1, rank, 0.4e0 / (60 + rank) FROM b)
SELECT arg_min(doc_id, place * 1000000 + rank) AS doc_id, round(sum(part), 6) AS score, min(CASE WHEN place = 0 THEN rank END)::INT AS vector_rank, max(CASE WHEN place = 1 THEN rank END)::INT AS bm25_rank FROM u GROUP BY key""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("metadata", F.col("doc_id"))

    def ranked(df: DataFrame, *order: object) -> DataFrame:
        return df.orderBy(*order).limit(200).withColumn("rank", F.row_number().over(Window.orderBy(*order)))

    out = retrieve.fuse(ranked(docs, F.desc("n_chars"), "doc_id"), ranked(docs.where("lang = 'en'"), F.desc("n_chars"), F.desc("doc_id")), digits=6)
    return out.select(F.col("metadata").alias("doc_id"), "score", "vector_rank", "bm25_rank")


PATH = r"regexp_replace(regexp_extract(regexp_replace(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?', ''), '^([^?#]*)', 1), ';[^/]*$', '')"
AUTHORITY = r"regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)"
NORMAL = rf"lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) || '://' || {AUTHORITY} || regexp_replace({PATH}, '/+$', '')"
EXTENSION = rf"lower(regexp_extract({PATH}, '[^/.][^/]*(\.[^./]*)$', 1))"
SKIP = " OR ".join(f"contains(lower(url), '{p}')" for p in X.SKIP_PATTERNS) + f" OR {EXTENSION} IN ({', '.join(repr(e) for e in X.SKIP_EXTENSIONS)})"
HREFS = """hrefs AS (SELECT page_id, url AS src, replace(unnest(regexp_extract_all(html, '<a\\b[^>]*?\\bhref="([^"]*)"', 1)), '&amp;', '&') AS href FROM pages),
links AS (SELECT page_id, src, href, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(src, '^([^:]*:)', 1) || href
  WHEN starts_with(href, '/') THEN regexp_extract(src, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href END AS url FROM hrefs WHERE href <> '')"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


@query(f"SELECT page_id, {NORMAL} AS norm_url, {EXTENSION} AS extension FROM pages")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return _pages(spark, sf_dir).select("page_id", X.normalize_url(u).alias("norm_url"), X.url_extension(u).alias("extension"))


@query(f"SELECT page_id, ({SKIP}) AS skipped FROM pages")
def url_skip_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", X.skipped_url(F.col("url")).alias("skipped"))


@query(f"SELECT page_id, starts_with(url, 'http') AND {AUTHORITY} IN ({', '.join(map(repr, HOSTS))}) AND NOT ({SKIP}) AS valid FROM pages")
def link_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", X.valid_link(F.col("url"), HOSTS).alias("valid"))


@query(f"WITH {HREFS} SELECT page_id, href, url FROM links")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).select("page_id", "url", F.explode(X.hrefs(F.col("html"))).alias("href")).withColumn("href", crawl.decoded(F.col("href")))
    return rows.select("page_id", "href", crawl.resolved(F.col("url"), F.col("href")).alias("url"))


@query(f"WITH {HREFS} SELECT page_id, href, url FROM links")
def link_resolve_rfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).select("page_id", "url", F.explode(X.hrefs(F.col("html"))).alias("href")).withColumn("href", crawl.decoded(F.col("href")))
    return rows.select("page_id", "href", join_urls(F.col("url"), F.col("href")).alias("url"))


#: A page with links of all kinds, which the table lacks, and what they resolve to, worked out by hand.
ODD_PAGE = ("http://a.example.org/x/y", """<a href="next.html">1</a><A HREF='../up/'>2</A><a class=c href=bare?p=1>3</a><a href="/q?a=1&amp;b=2">4</a><a href='?page=2'>5</a><a href="#top">6</a>
<a href="//other.example.org/z">7</a><a href="http://B.example.org/k/../m">8</a><a title="href='no'" href="&#47;num">9</a><a href="">10</a><a name=n>11</a><a href="y">itself</a><a href="mailto:x@y.z">12</a>""")
ODD_LINKS = ["http://a.example.org/x/next.html", "http://a.example.org/up", "http://a.example.org/x/bare", "http://a.example.org/q", "http://a.example.org/num"]
#: The hosts that a crawl stays on: a domain of the table's, which has links to itself, and the odd page's.
CRAWLED = (*HOSTS, "a.example.org")


@query(f"WITH {HREFS}, seen AS (SELECT DISTINCT {NORMAL} AS norm_url FROM pages) SELECT DISTINCT {NORMAL} AS norm_url FROM links WHERE starts_with(url, 'http') AND {AUTHORITY} IN ({', '.join(map(repr, CRAWLED))}) AND NOT ({SKIP}) AND {NORMAL} NOT IN (SELECT norm_url FROM seen) UNION SELECT unnest({ODD_LINKS})")
def link_frontier_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid links only: of the site's hosts, without those to be skipped."""
    rows = _pages(spark, sf_dir).select("url", "html").unionByName(spark.range(1).select(F.lit(ODD_PAGE[0]).alias("url"), F.lit(ODD_PAGE[1]).alias("html")))
    return crawl.frontier(rows, CRAWLED)


KINDS = "('https://h.example.edu/undergraduate/courses/2026/COMP1511'), ('https://h.example.edu/undergraduate/programs/2026/3778'), ('https://h.example.edu/postgraduate/courses/2026/MATH5905?x=1'), ('https://h.example.edu/research/programs/2026/1650'), ('https://h.example.edu/undergraduate/courses/2026'), ('/about')"


@query(rf"""SELECT url, CASE WHEN regexp_matches(url, '{X.COURSE_URL}') THEN 'course' WHEN regexp_matches(url, '{X.PROGRAM_URL}') THEN 'program' END AS type,
CASE WHEN contains(url, '/postgraduate/') THEN 'postgraduate' WHEN contains(url, '/research/') THEN 'research' ELSE 'undergraduate' END AS level,
regexp_extract(url, '/([A-Z]{{4}}\d{{4}})$', 1) AS course_code, regexp_extract(url, '/(\d{{4}})$', 1) AS program_code
FROM (SELECT url FROM (VALUES {KINDS}) v(url) UNION ALL SELECT url FROM pages)""")
def url_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.sql(f"SELECT url FROM VALUES {KINDS} AS v(url)")
    u = F.col("url")
    return fixed.unionByName(_pages(spark, sf_dir).select("url")).select("url", X.page_kind(u).alias("type"), X.level_of(u).alias("level"), X.code_of(u, "course").alias("course_code"), X.code_of(u, "program").alias("program_code"))


LINES = r"""raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
tidy AS (SELECT doc_id, pos, regexp_replace(regexp_replace(line, '[\s\x{85}\p{Z}\x1c-\x1f]+', ' ', 'g'), '^[\s\x{85}\p{Z}\x1c-\x1f]+|[\s\x{85}\p{Z}\x1c-\x1f]+$', '', 'g') AS line FROM raw),
kept AS (SELECT doc_id, pos, line, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM tidy WHERE length(line) > 3),
clean AS (SELECT doc_id, pos, line FROM kept WHERE before IS NULL OR before <> line)"""


@query(f"WITH {LINES} SELECT d.doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos), '') AS text FROM documents d LEFT JOIN clean USING (doc_id) GROUP BY d.doc_id")
def clean_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.clean_text(F.col("text")).alias("text"))


@query(f"WITH {LINES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS n, line FROM clean")
def dedup_consecutive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(X.clean_lines(F.col("text"))).alias("n", "line")).withColumn("n", F.col("n").cast("long"))


@query("SELECT doc_id, substr(sha256(source || '::chunk::' || lang || '_' || doc_id), 1, 16) AS id FROM documents")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.chunk_id(F.col("source"), F.concat_ws("_", "lang", "doc_id")).alias("id"))


@query("""SELECT doc_id, substr(text, 1, 250) AS preview, CASE WHEN contains(text, ':') THEN split_part(text, ':', 1) ELSE '' END AS heading, regexp_replace(text, '^Handbook\\s*[-–—]\\s*', '') AS title FROM documents""")
def previews_and_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", X.preview(t).alias("preview"), X.before_colon(t).alias("heading"), X.without_handbook(t).alias("title"))


# The SQL of pages knows the table's one layout: a title, and within the body nav, an advert, one article of an h1 and paragraphs, and a footer.
WHITE = r"[\s\x{85}\p{Z}\x1c-\x1f]+"


def _decoded(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', chr(39)), '&amp;', '&')"


def _tidy(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{WHITE}', ' ', 'g'), '^ | $', '', 'g')"


LAYOUT = rf"""parts AS (SELECT page_id, url, html, {_tidy(_decoded("regexp_extract(html, '<title>([^<]*)', 1)"))} AS title, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS article, regexp_extract(html, '<div class="ad">(.*?)</div>', 1, 's') AS ad FROM pages),
heads AS (SELECT *, {_tidy(_decoded("regexp_extract(article, '<h1>([^<]*)', 1)"))} AS h1 FROM parts),
strings AS (SELECT page_id, 'content' AS what, string_split({_decoded("regexp_replace(article, '<[^>]*>', chr(10), 'g')")}, chr(10)) AS s FROM parts
  UNION ALL SELECT page_id, 'body', string_split({_decoded("regexp_replace(ad || chr(10) || article, '<[^>]*>', chr(10), 'g')")}, chr(10)) FROM parts
  UNION ALL SELECT page_id, 'section', list_filter(list_transform(string_split_regex(regexp_replace(article, '^.*?</h1>', '', 's'), '<p>'),
    lambda p: array_to_string(list_transform(string_split_regex(p, '<[^>]*>'), lambda x: regexp_replace({_decoded("x")}, '^{WHITE}|{WHITE}$', '', 'g')), '')), lambda x: length(x) > 10) FROM parts),
tidy AS (SELECT page_id, what, list_filter(list_transform(s, lambda x: {_tidy("x")}), lambda x: length(x) > 3) AS s FROM strings),
joined AS (SELECT page_id, what, array_to_string(list_filter(s, lambda x, i: i = 1 OR x <> s[i - 1]), chr(10)) AS t FROM tidy),
page AS (SELECT h.*, c.t AS content, b.t AS body, p.t AS section FROM heads h JOIN joined c ON c.page_id = h.page_id AND c.what = 'content' JOIN joined b ON b.page_id = h.page_id AND b.what = 'body' JOIN joined p ON p.page_id = h.page_id AND p.what = 'section')"""
NAMED = r"CASE WHEN regexp_replace(title, '\s*\|\s*Example.*$', '') = '' THEN h1 ELSE regexp_replace(title, '\s*\|\s*Example.*$', '') END"


@query(f"WITH {LAYOUT} SELECT page_id, {NAMED} AS title, h1, '' AS meta_description FROM page")
def page_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _pages(spark, sf_dir).withColumn("p", page_fields(F.col("html"), SITE.brand))
    return read.select("page_id", "p.title", "p.h1", "p.meta_description")


@query("""WITH n AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
h AS (SELECT *, CASE WHEN length(line) < 60 THEN line END AS heading FROM n),
c AS (SELECT doc_id, pos, heading, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section_heading FROM h)
SELECT doc_id, pos, section_heading FROM c WHERE heading IS NULL""")
def section_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    nodes = nodes.withColumn("heading", F.when(F.char_length("line") < 60, F.col("line")))
    out = pages.carried_headings(nodes, "doc_id").where("heading is null")
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), "section_heading")


VERSIONS = """old AS (SELECT doc_id AS id, md5(text) AS text, source AS note FROM documents),
new AS (SELECT doc_id AS id, md5('new ' || text) AS text, lang AS note, 1 AS seq FROM documents WHERE n_chars % 3 = 0 UNION ALL SELECT doc_id, md5('newer ' || text), source, 2 FROM documents WHERE n_chars % 6 = 0
  UNION ALL SELECT doc_id, md5('tied ' || text), lang, 1 FROM documents WHERE n_chars % 9 = 0 UNION ALL SELECT doc_id, md5('tied ' || text), 'zz', 2 FROM documents WHERE n_chars % 12 = 0 UNION ALL SELECT doc_id + 100000000, md5(text), lang, 1 FROM documents WHERE n_chars % 7 = 0),
latest AS (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC, text DESC NULLS LAST, note DESC NULLS LAST) = 1)"""


@query(f"WITH {VERSIONS} SELECT id, text, note FROM latest UNION ALL SELECT id, text, note FROM old WHERE id NOT IN (SELECT id FROM latest)")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Into a collection: some rows are new, some come twice, and some twice with the same place."""
    docs = _docs(spark, sf_dir)
    old = docs.select(F.col("doc_id").alias("id"), F.md5("text").alias("text"), F.col("source").alias("note"))

    def part(where: str, say: str, note: Column, seq: int, add: int = 0) -> DataFrame:
        return docs.where(where).select((F.col("doc_id") + add).alias("id"), F.md5(F.concat(F.lit(say), "text")).alias("text"), note.alias("note"), F.lit(seq).alias("seq"))

    lang, source = F.col("lang"), F.col("source")
    new = part("n_chars % 3 = 0", "new ", lang, 1).unionByName(part("n_chars % 6 = 0", "newer ", source, 2)).unionByName(part("n_chars % 9 = 0", "tied ", lang, 1))
    new = new.unionByName(part("n_chars % 12 = 0", "tied ", F.lit("zz"), 2)).unionByName(part("n_chars % 7 = 0", "", lang, 1, 100000000))
    collection = vectors.Collection(spark, shared_path(spark, "upserts"), "versions", "id bigint, text string, note string")
    collection.upsert(old.withColumn("seq", F.lit(0)))
    collection.upsert(new)
    return collection.read()


@query("SELECT (SELECT count(*) FROM pages) AS total_chunks, array_to_string(list_sort(list(DISTINCT url)), ' ') AS sample_urls FROM (SELECT url FROM pages ORDER BY page_id LIMIT 10)")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).stats().withColumn("sample_urls", F.array_join("sample_urls", " "))


def _urls(spark: SparkSession, sf_dir: str) -> vectors.Collection:
    """A collection of the pages' urls, put in by two upserts of which the second has a part of the first again."""
    rows = _pages(spark, sf_dir).select(F.col("page_id").alias("id"), F.struct("url").alias("metadata"), F.lit(0).alias("seq"))
    out = vectors.Collection(spark, shared_path(spark, "urls"), "pages", "id bigint, metadata struct<url:string>")
    out.upsert(rows.where("id % 4 <> 1").withColumn("metadata", F.when(F.col("id") % 4 == 0, F.struct(F.lit("before").alias("url"))).otherwise(F.col("metadata"))))
    out.upsert(rows.where("id % 4 < 2"))
    return out


@query("SELECT page_id, url FROM pages ORDER BY page_id LIMIT 10")
def collection_peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).peek(10).select(F.col("id").alias("page_id"), "metadata.url")


@query(f"""SELECT 'https://handbook.example.edu/' || level || '/courses/2026?query=' || area AS url, area FROM (SELECT unnest({list(SITE.areas)}) AS area), (VALUES ('undergraduate'), ('postgraduate')) l(level)
UNION ALL SELECT 'https://handbook.example.edu/' || x, NULL FROM (VALUES (''), ('undergraduate/courses/2026'), ('postgraduate/courses/2026'), ('undergraduate/programs/2026'), ('postgraduate/programs/2026'), ('research/programs/2026')) v(x)""")
def seed_cross_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.catalogue_seeds(spark, SITE)


@query("SELECT unnest(['https://www.example.edu/', 'https://www.example.edu/students', 'https://handbook.example.edu/']) AS url")
def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.seeds(spark, SITE)


@query("""WITH RECURSIVE edges AS (SELECT CAST(o_custkey AS VARCHAR) AS src, CAST(o_orderkey % (SELECT count(*) FROM customer) AS VARCHAR) AS dst FROM orders),
walk AS (SELECT '1' AS url, 0 AS depth UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = url WHERE depth < 6)
SELECT url, min(depth) AS depth FROM walk GROUP BY url""")
def crawl_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").crossJoin(F.broadcast(table(spark, sf_dir, "customer").agg(F.count("*").alias("n"))))  # one row
    edges = orders.select(F.col("o_custkey").cast("string").alias("src"), (F.col("o_orderkey") % F.col("n")).cast("string").alias("dst"))
    return crawl.crawl_depths(edges, spark.createDataFrame([("1",)], "url string"), 6)


@query("SELECT CASE WHEN contains(url, '?page=') THEN 'listing' ELSE 'general' END AS type, count(*) AS n_pages FROM pages GROUP BY ALL")
def crawl_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.crawl_counters(_pages(spark, sf_dir).select(F.when(F.col("url").contains("?page="), "listing").alias("type")))


@query("SELECT conv_id, turn, text FROM conversations WHERE length(text) BETWEEN 2 AND 1000")
def valid_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.valid_questions(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "text")


ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


# A tenth of the double that n_chars / 1000 is, halves upwards: the double's exact value tells, as DECIMAL(38, 20).
@query(f"""SELECT doc_id, CASE WHEN n_chars > 1000 THEN t // 10 || '.' || t % 10 || 's' ELSE n_chars || 'ms' END AS label, {ESCAPED.format("text")} AS escaped
FROM (SELECT *, (n_chars + 50) // 100 - CASE WHEN n_chars % 100 = 50 AND printf('%.20f', n_chars / 1000)::DECIMAL(38, 20) < (n_chars // 1000 || '.' || lpad((n_chars % 1000)::VARCHAR, 3, '0'))::DECIMAL(38, 20) THEN 1 ELSE 0 END AS t FROM documents)""")
def response_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.response_time(F.col("n_chars")).alias("label"), X.escape_html(F.col("text")).alias("escaped"))


@query(f"WITH {LAYOUT} SELECT url, {NAMED} AS title, h1, '' AS meta_description, '' AS breadcrumbs, content, (section <> '')::INT AS n_sections, CASE WHEN section <> '' THEN h1 || ': ' || section ELSE '' END AS sections FROM page WHERE content <> '' AND NOT ({SKIP})")
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' records, lists as texts; the table has no typed pages."""
    found = pages.general_pages(_pages(spark, sf_dir), SITE)
    sections = F.array_join(F.transform("sections", lambda s: F.concat(s.heading, F.lit(": "), s.content)), "\n\n")
    return found.select("url", "title", "h1", "meta_description", F.array_join("breadcrumbs", " > ").alias("breadcrumbs"), "content", F.size("sections").alias("n_sections"), sections.alias("sections"))


# The splitter as SQL, from ``texts`` (doc, text) to ``split`` (doc, i, piece). ``nodes`` are the texts that are cut, each at the first separator that it has;
# pieces of 500 characters are cut again. ``runs`` are the neighbouring shorter pieces, with the sums of their lengths. ``folds`` steps from chunk to chunk:
# a chunk is the pieces from w up to the one, k, with which it would exceed 500; the next one begins where at most 80 characters, and no more than leave room for k, go back.
SPLIT = rf"""seps AS (SELECT [chr(10) || chr(10), chr(10), '. ', '? ', '! ', '; ', ', ', ' ', ''] AS s),
nodes AS (SELECT doc, []::BIGINT[] AS path, text, 1::BIGINT AS lo FROM texts UNION ALL
  SELECT doc, path || [k], piece, nth + 1 FROM (SELECT doc, path, nth, unnest(ps) AS piece, unnest(range(1, len(ps) + 1)) AS k FROM (SELECT *, @PIECES@ AS ps FROM (SELECT *, s[nth] AS sep FROM (SELECT *, @FIRST@ AS nth FROM nodes, seps)))) WHERE length(piece) >= 500 AND nth < 9),
pieces AS (SELECT doc, path, unnest(ps) AS piece, unnest(range(1, len(ps) + 1)) AS k FROM (SELECT *, @PIECES@ AS ps FROM (SELECT *, s[nth] AS sep FROM (SELECT *, @FIRST@ AS nth FROM nodes, seps)))),
marked AS (SELECT *, sum((length(piece) >= 500)::INT) OVER (PARTITION BY doc, path ORDER BY k) AS g FROM pieces),
summed AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc, path, g ORDER BY k)::BIGINT AS total FROM marked WHERE length(piece) < 500),
runs AS (SELECT row_number() OVER () AS run, doc, path || [min(k)] AS path, list(piece ORDER BY k) AS ps, list(total ORDER BY k) AS sums FROM summed GROUP BY doc, path, g),
folds AS (SELECT run, sums, 1::BIGINT AS w, (len(list_filter(sums, lambda x: x <= 500)) + 1)::BIGINT AS k FROM runs UNION ALL
  SELECT run, sums, w, (len(list_filter(sums, lambda x: x <= 500 + CASE WHEN w = 1 THEN 0 ELSE sums[w - 1] END)) + 1)::BIGINT FROM (
    SELECT run, sums, greatest(w, CASE WHEN back <= 0 THEN 1 ELSE 2 + len(list_filter(sums, lambda x: x < back)) END)::BIGINT AS w FROM (
      SELECT *, sums[k - 1] - least(80, 500 - (sums[k] - sums[k - 1])) AS back FROM folds WHERE k <= len(sums)))),
found AS (SELECT doc, path, k, regexp_replace(array_to_string(ps[w:k - 1], ''), '^{WHITE}|{WHITE}$', '', 'g') AS piece FROM folds JOIN runs USING (run)),
split AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY path, k) - 1 AS i, piece FROM found WHERE piece <> '')""".replace(
    "@FIRST@", "list_filter(range(lo, 10), lambda j: j = 9 OR contains(text, s[j]))[1]"
).replace("@PIECES@", "CASE WHEN nth = 9 THEN string_split(text, '') ELSE list_filter(list_transform(string_split(text, sep), lambda x, n: CASE WHEN n = 1 THEN x ELSE sep || x END), lambda x: x <> '') END")


def _flat(chunks_: DataFrame) -> DataFrame:
    return chunks_.select("id", "text", "metadata.*")


@query(f"""WITH RECURSIVE {LAYOUT}, kept AS (SELECT *, {NAMED} AS name FROM page WHERE content <> '' AND NOT ({SKIP})),
texts AS (SELECT page_id AS doc, CASE WHEN section = '' THEN content WHEN h1 = '' THEN section ELSE h1 || chr(10) || chr(10) || section END AS text FROM kept WHERE length(CASE WHEN section = '' THEN content ELSE section END) >= 50), {SPLIT},
good AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY i) - 1 AS n FROM split WHERE length(piece) >= 50)
SELECT substr(sha256(url || '::chunk::' || CASE WHEN section = '' THEN '' ELSE h1 || '_' END || i), 1, 16) AS id, piece AS text, url, name AS title, CASE WHEN section = '' THEN '' ELSE h1 END AS section_heading, '' AS breadcrumbs,
(CASE WHEN section = '' THEN i ELSE n END)::INT AS chunk_index, NULL::VARCHAR AS content_type FROM good JOIN kept ON doc = page_id""")
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.general_pages(_pages(spark, sf_dir), SITE)
    return _flat(chunks.chunk_pages(found.withColumn("type", F.lit(None).cast("string")).select("*", *[F.lit(None).cast("string").alias(c) for c in ("uoc", "level", "faculty", "school", "offering_terms", "duration")])))


@query(f"""WITH RECURSIVE texts AS (SELECT doc_id AS doc, text FROM documents WHERE length(text) >= 50), {SPLIT}
SELECT substr(sha256('doc://' || doc || '::chunk::' || i), 1, 16) AS id, piece AS text, 'doc://' || doc AS url, source AS title, '' AS section_heading, concat_ws(' > ', lang, source) AS breadcrumbs, i::INT AS chunk_index, NULL::VARCHAR AS content_type
FROM split JOIN documents ON doc = doc_id WHERE length(piece) >= 50""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages without sections, in chunks."""
    empty = [F.lit(None).cast("string").alias(c) for c in ("uoc", "level", "faculty", "school", "offering_terms", "duration", "type")]
    docs = _docs(spark, sf_dir).select(F.concat(F.lit("doc://"), "doc_id").alias("url"), F.col("source").alias("title"), F.array("lang", "source").alias("breadcrumbs"), F.col("text").alias("content"), F.expr("cast(null as array<struct<heading:string,content:string>>)").alias("sections"), *empty)
    return _flat(chunks.chunk_pages(docs, Settings()))


TYPED = r"""t AS (SELECT *, 'COMP' || lpad((page_id % 10000)::VARCHAR, 4, '0') AS code, regexp_replace(title, '^Handbook\s*[-–—]\s*', '') AS name, regexp_extract(html, '(\d+)\s*Units?\s*of\s*Credit', 1) AS uoc FROM page)"""


@query(f"""WITH {LAYOUT}, {TYPED} SELECT 'https://handbook.example.edu/undergraduate/courses/2026/' || code AS url, 'course' AS type, code AS course_code, NULL::VARCHAR AS program_code, code || ' — ' || name AS title, 'undergraduate' AS level, uoc,
'' AS faculty, '' AS school, '' AS offering_terms, NULL::VARCHAR AS duration, body AS content, CASE WHEN contains(body, ':') THEN split_part(body, ':', 1) ELSE '' END AS heading, 'Example Handbook > Undergraduate > Courses > ' || code AS breadcrumbs,
code || ' ' || name || ' - ' || uoc || ' UOC - Example Undergraduate' AS meta_description FROM t WHERE body <> ''""")
def typed_page_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as if it were a course's, lists as texts."""
    url = F.concat(F.lit("https://handbook.example.edu/undergraduate/courses/2026/COMP"), F.lpad((F.col("page_id") % 10000).cast("string"), 4, "0"))
    found = pages.typed_pages(_pages(spark, sf_dir).select(url.alias("url"), "html"), SITE).drop("last_crawled")
    heading = F.array_join(F.transform("sections", lambda s: s.heading), "; ")
    return found.withColumn("heading", heading).withColumn("breadcrumbs", F.array_join("breadcrumbs", " > ")).drop("sections")


INLINE = r"""regexp_replace(regexp_replace(regexp_replace({}, '\*\*([^*]+)\*\*', '<strong>\1</strong>', 'g'), '\*([^*\s][^*]*)\*', '<em>\1</em>', 'g'), '\[([^\[\]]+)\]\(((?:https?://|/|#)[^()\s"]*)\)', '<a href="\2" target="_blank" rel="noopener">\1</a>', 'g')"""
MARKDOWN = rf"""WITH l AS (SELECT conv_id, turn, string_split_regex({ESCAPED.format("coalesce(text, '')")}, '\r?\n') AS lines FROM conversations),
k AS (SELECT *, list_transform(lines, lambda x: CASE WHEN regexp_matches(x, '^# .') THEN 'h1' WHEN regexp_matches(x, '^## .') THEN 'h2' WHEN regexp_matches(x, '^### .') THEN 'h3'
  WHEN regexp_matches(x, '^[-*] .') THEN 'ul' WHEN regexp_matches(x, '^\d+\. .') THEN 'ol' WHEN trim(x) = '' THEN '' ELSE 'p' END) AS kinds FROM l),
u AS (SELECT conv_id, turn, unnest(lines) AS line, unnest(kinds) AS kind, unnest(range(len(lines))) AS i FROM k),
b AS (SELECT *, coalesce(lag(kind) OVER w, '') AS before, lead(kind) OVER w IS NULL AS ends, CASE WHEN kind IN ('h1', 'h2', 'h3', 'ul', 'ol') THEN regexp_replace(line, '^(#+|[-*]|\d+\.) ', '') ELSE line END AS said FROM u WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
p AS (SELECT *, unnest(string_split(said, '`')) AS part, unnest(range(len(string_split(said, '`')))) AS j, len(string_split(said, '`')) - 1 AS last FROM b),
s AS (SELECT conv_id, turn, i, kind, before, ends, string_agg(CASE WHEN j % 2 = 0 THEN {INLINE.format("part")} WHEN j = last THEN '`' || {INLINE.format("part")} ELSE '<code>' || part || '</code>' END, '' ORDER BY j) AS said FROM p GROUP BY ALL),
o AS (SELECT *, CASE WHEN kind = before AND kind = 'p' THEN '<br>' WHEN kind = before AND kind IN ('ul', 'ol') THEN '' ELSE CASE WHEN before <> '' THEN '</' || before || '>' ELSE '' END || CASE WHEN kind <> '' THEN '<' || kind || '>' ELSE '' END END
  || CASE WHEN kind IN ('ul', 'ol') THEN '<li>' || said || '</li>' WHEN kind = '' THEN '' ELSE said END || CASE WHEN ends AND kind <> '' THEN '</' || kind || '>' ELSE '' END AS html FROM s)
SELECT conv_id, turn, string_agg(html, '' ORDER BY i) AS html FROM o GROUP BY conv_id, turn"""


@query(MARKDOWN)
def markdown_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.render_markdown(F.col("text")).alias("html"))
