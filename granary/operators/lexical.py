"""BM25: statistics, scores by a scan, and top-k; ``operators.text_index`` keeps an index.

score(d) is the sum over the query's tokens, repeats included, of
idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)), where a negative idf is
replaced by EPSILON times the mean idf of all terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import tokens

K1, B, EPSILON = 1.5, 0.75, 0.25


def _idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def counted_terms(text: Column) -> Column:
    """(term, tf) of each distinct token of a text, in its own row: sorted, equal tokens are neighbours, and a run's length is the distance of its ends."""
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    ends = lambda m: F.filter(F.transform(m, lambda x, i: F.struct(x.alias("term"), i.alias("i"))), lambda p: F.get(m, p.i + 1).isNull() | (F.get(m, p.i + 1) != p.term))
    runs = lambda e: F.transform(e, lambda p, k: F.struct(p.term.alias("term"), (p.i - F.coalesce(F.get(e, k - 1).getField("i"), F.lit(-1))).cast("long").alias("tf")))
    return once(F.sort_array(tokens(text)), lambda m: once(ends(m), runs))


def postings(docs: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """(term, id, tf, dl), a row for each distinct token of each row. Repeats are counted where the text is; nothing is shuffled."""
    rows = docs.select(F.col(id).alias("id"), F.size(tokens(F.col(text))).cast("long").alias("dl"), counted_terms(F.col(text)).alias("w"))
    return rows.select("id", "dl", F.explode("w").alias("t")).select("t.term", "id", "t.tf", "dl")


def lengths(docs: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    return docs.select(F.col(id).alias("id"), F.size(tokens(F.col(text))).cast("long").alias("dl"))


def term_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df, idf): only distinct terms of a document leave its row, and they are summed before the shuffle."""
    df = docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", _idf(F.col("n"), F.col("df")).alias("idf"))


def totals(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """One row."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col(text)))).alias("avgdl")).crossJoin(terms.agg(F.avg("idf").alias("mean_idf")))


def _effective(idf: Column, mean: Column) -> Column:
    return F.when(idf < 0, EPSILON * mean).otherwise(idf)


def _score(idf: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def query_terms(docs: DataFrame, query: str) -> DataFrame:
    """(term, times) of a query: one row a distinct token."""
    words = docs.sparkSession.range(1).select(F.explode(tokens(F.lit(query))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("times"))


def scan_scores(docs: DataFrame, query: str, id: str = "id", text: str = "text") -> DataFrame:
    """(id, text, score) of every document, without an index: one pass over the texts and one aggregation of terms.

    The query's idfs are one row (a map); a document's score needs only its own
    row, so documents aren't shuffled. An empty query scores 0.
    """
    terms = term_statistics(docs, text)
    wanted = query_terms(docs, query)
    total = totals(docs, terms, text)
    known = terms.join(F.broadcast(wanted), "term").crossJoin(F.broadcast(total))
    one = known.agg(F.collect_list(F.struct("term", "times", _effective(F.col("idf"), F.col("mean_idf")).alias("idf"))).alias("q"))
    base = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), tokens(F.col(text)).alias("w"))
    asked = tokens(F.lit(query))  # a constant: a document's tokens are read once for all of them
    base = base.select("id", "text", F.size("w").alias("dl"), F.filter("w", lambda x: F.array_contains(asked, x)).alias("hits"))
    base = base.crossJoin(F.broadcast(one.crossJoin(total.select("avgdl"))))
    tf = lambda q: F.size(F.filter("hits", lambda x: x == q.term))
    score = F.aggregate("q", F.lit(0.0), lambda s, q: s + q.times * F.when(tf(q) > 0, _score(q.idf, tf(q), F.col("dl"), F.col("avgdl"))).otherwise(0.0))
    return base.select("id", "text", score.alias("score"))


def top_k(scores: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """The k best by score, the smaller id first among equals, those above 0, with their ``rank`` from 1."""
    from pyspark.sql import Window

    if digits is not None:
        scores = scores.withColumn("score", F.round("score", digits))
    best = scores.orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).where("score > 0")
