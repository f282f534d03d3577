"""Target-distribution importance resampling: documents drawn by how much their features resemble a target's.

1. Features (runs of words) are hashed into buckets and counted over all documents
   and over all texts of the target. A bucket's gain, the rounded log ratio of the
   two smoothed shares, is one number; the gains of all buckets are an array.
2. A document's weight is the sum of its features' gains, looked up in the array
   where the document is. Its score is the weight and Gumbel noise that depends on
   its id alone, an integer, so the highest scores are a draw without replacement.
3. Scores are counted exactly. Counts summed from the highest score down say how
   many documents stand before each score, and so where the draw ends. Of documents
   of one surviving score ``row_number`` by id gives the place after those before.

All of it runs in the JVM. No step sorts all documents: the sums over scores go by
digits (see ``before``), and documents below the cutoff score move nowhere.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, fresh, table, written

#: A word: ASCII digits and letters, and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a score that one window sorts: at most 4,096 sums each.
DIGIT = 12
#: Documents of one score up to which one window numbers them.
HOT = 100_000
#: A score is below 2**47 in size: a text has under 2**30 words, a gain is under 2**17.
SPAN = 48


def features(text: Column, n: int = 1) -> Column:
    """All runs of 1 to ``n`` consecutive words, joined by one space, repeats included; an empty array for null."""
    words = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    if n == 1:
        return words
    run = lambda w, k: F.transform(F.slice(w, 1, F.greatest(F.size(w) - k + 1, F.lit(0))), lambda _, i: F.array_join(F.slice(w, i + 1, k), " "))
    return F.get(F.transform(F.array(words), lambda w: F.flatten(F.array(w, *[run(w, k) for k in range(2, n + 1)]))), F.lit(0))


def bucket(feature: Column, buckets: int) -> Column:
    return F.crc32(feature.cast("binary")) % buckets


def bucket_counts(texts: DataFrame, buckets: int, n: int = 1, text: str = "text") -> DataFrame:
    """(bucket, n) of the buckets that occur; features are counted within a task before they move."""
    found = texts.select(F.explode(F.transform(features(column(texts, text), n), lambda x: bucket(x, buckets))).alias("bucket"))
    return found.groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = 10_000, n: int = 1, text: str = "text", target_text: str = "text") -> list[int]:
    """The gain of each bucket, ``buckets`` numbers, which is what comes to the driver.

    floor(1000 * ln(((t + 1) / (T + buckets)) / ((s + 1) / (S + buckets)))) with t of the
    target's T features and s of the documents' S features in the bucket.
    """
    spark = docs.sparkSession
    own, wanted = bucket_counts(docs, buckets, n, text).withColumnRenamed("n", "s"), bucket_counts(target, buckets, n, target_text).withColumnRenamed("n", "t")
    all_ = spark.range(buckets).select(F.col("id").alias("bucket")).join(own, "bucket", "left").join(wanted, "bucket", "left").na.fill(0, ["s", "t"])
    rows = all_.select("bucket", "s", "t").collect()
    d = lambda x: F.lit(float(x))
    total_s, total_t = sum(r.s for r in rows) + buckets, sum(r.t for r in rows) + buckets
    counts = spark.createDataFrame([(r.bucket, r.s, r.t) for r in rows], "bucket long, s long, t long")
    gain = F.floor(d(1000) * F.log((F.col("t") + d(1)) * d(total_s) / ((F.col("s") + d(1)) * d(total_t))))
    return [r.gain for r in counts.select("bucket", gain.alias("gain")).orderBy("bucket").collect()]


def scored(docs: DataFrame, gain: list[int], seed: int = 2024, n: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_features``, ``weight`` and ``score`` (long).

    A null or empty text has no features and weight 0. The noise of a null id is
    that of the seed and no id. Names that ``docs`` has get a ``_``.
    """
    count, weight, score, found = fresh(docs, "n_features", "weight", "score", "found")
    array = F.from_json(F.lit(json.dumps(gain)), "array<bigint>")  # a constant of the plan: len(gain) numbers
    sum_ = lambda words: F.aggregate(words, F.lit(0).cast("long"), lambda s, x: s + F.get(array, bucket(x, len(gain)).cast("int")))
    both = F.get(F.transform(F.array(features(column(docs, text), n)), lambda w: F.struct(F.size(w).cast("long").alias("n"), sum_(w).alias("w"))), F.lit(0))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(column(docs, doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    out = docs.withColumn(found, both)
    f = F.col(f"`{found}`")
    return out.withColumns({count: f["n"], weight: f["w"], score: f["w"] + noise}).drop(found)


def before(counts: DataFrame, key: str, n: str, span: int = SPAN, group: tuple[str, ...] = (), digit: int = DIGIT) -> DataFrame:
    """``counts`` (one row for each value of ``key``, a long of at most ``span`` bits) with ``before``: the sum of ``n`` over smaller keys of its group.

    Keys are cut into digits of ``digit`` bits. Sums over the keys that share all
    but the last digit are a window of at most 2**digit rows, whatever the number
    of keys; what stands before the whole window comes from the same sums a digit up.
    """
    if span <= digit:
        return counts.withColumn("before", F.coalesce(F.sum(n).over(Window.partitionBy(*group, F.lit(0)).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    high, low = F.shiftright(F.col(key), digit), fresh(counts, "high_")[0]
    split = counts.withColumn(low, high)
    above = before(split.groupBy(*group, low).agg(F.sum(n).alias("n_")), low, "n_", span - digit, group, digit).withColumnRenamed("before", "base_").drop("n_")
    w = Window.partitionBy(*group, low).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    inside = split.withColumn("before", F.coalesce(F.sum(n).over(w), F.lit(0)))
    return inside.join(above, [*group, low]).withColumn("before", F.col("before") + F.col("base_")).drop("base_", low)


def ranked(rows: DataFrame, n: int, hot: int = HOT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of ``rows``, a written table with these and ``may`` (whether it can be drawn) and ``salt``.

    The ``n`` highest scores that may be drawn are numbered from 1, among equals the
    smaller doc_id first, nulls last; the other ranks are null. Rows equal in score
    and doc_id are interchangeable.

    A score that more than ``hot`` rows have is numbered by parts, (doc_id, salt),
    whose counts are summed as those of the scores are, so no task sorts all of it.
    """
    wanted = ["doc_id", "n_features", "weight", "score"]
    none = rows.select(*wanted, F.lit(None).cast("long").alias("rank"))
    if n <= 0:
        return none
    down = rows.where("may").groupBy((-F.col("score")).alias("down")).agg(F.count("*").alias("n"))
    counts = written(before(down, "down", "n").where(F.col("before") < n), "scores")  # surviving scores only
    cutoff, most = counts.agg(-F.max("down"), F.max("n")).first()
    if cutoff is None:
        return none
    lost = rows.where(~F.col("may") | (F.col("score") < cutoff)).select(*wanted, F.lit(None).cast("long").alias("rank"))
    alive = rows.where(F.col("may") & (F.col("score") >= cutoff)).withColumn("down", -F.col("score"))
    order = [F.col("doc_id").asc_nulls_last(), "n_features", "salt"]
    place = lambda df, *by: df.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("down", *by).orderBy(*order)))
    drawn = place(alive.join(counts.where(F.col("n") <= hot).drop("n"), "down"))
    if most > hot:
        # doc_id over its whole range of 64 bits, nulls after all: as its two halves, with a flag
        id_ = {"nil": F.col("doc_id").isNull().cast("long"), "top": F.coalesce(F.shiftright("doc_id", 32), F.lit(0)), "end": F.coalesce(F.col("doc_id").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(0))}
        many = alive.join(counts.where(F.col("n") > hot).select("down", "before"), "down").withColumns(id_)
        own = many.groupBy("down", "nil", "top", "end", "salt").agg(F.count("*").alias("n"))
        steps, group = [("nil", 1), ("top", 32), ("end", 33), ("salt", DIGIT)], ["down"]
        base = []
        for key, span in steps:  # rows before in the order of (nil, top, end, salt), a key at a time
            sums = own.groupBy(*group, key).agg(F.sum("n").alias("n"))
            base.append((before(sums, key, "n", span, tuple(group)).select(*group, key, F.col("before").alias(f"b_{key}")), [*group, key]))
            group.append(key)
        for sums, on in base:
            many = many.join(sums, on)
        many = many.withColumn("before", F.col("before") + sum(F.col(f"b_{key}") for key, _ in steps))
        drawn = drawn.unionByName(place(many, "nil", "top", "end", "salt").select(*drawn.columns))
    drawn = drawn.select(*wanted, F.when(F.col("rank") <= n, F.col("rank")).cast("long").alias("rank"))
    return lost.unionByName(drawn)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, buckets: int = 10_000, n: int = 1, least: int = 20, seed: int = 2024, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank), long, of every row of ``docs``.

    Of the N rows with at least ``least`` words, floor(percent * N / 100) are drawn: those
    with the highest scores, ranked from 1. All other ranks are null. ``target``
    is the texts whose distribution the draw should have.

    Null and empty texts have no features, weight 0, and aren't drawn while
    ``least`` is above 0. Rows that repeat a doc_id are documents of their own with
    equal noise. A null doc_id comes last among equal scores. Empty tables: no
    documents give no rows; no target leaves every bucket's share of it equal.
    Other columns of ``docs`` don't matter, whatever their names.
    """
    gain = gains(docs, target, buckets, n, text, target_text)
    own = docs.select(column(docs, doc_id).cast("long").alias("doc_id"), column(docs, text).alias("text"))
    found = scored(own, gain, seed, n)
    # a run of up to n words is a feature: w words have w + (w - 1) + ... features, so `least` words have this many
    enough = sum(max(0, least - k) for k in range(n))
    rows = found.select("doc_id", "n_features", "weight", "score", (F.col("n_features") >= enough).alias("may"), (F.monotonically_increasing_id() % 1024).alias("salt"))
    rows = written(rows, "scored")
    return ranked(rows, percent * rows.where("may").count() // 100)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")
    return resample(docs, target)


#: The checksum is computed a distinct word at a time, from the bytes of its UTF-8 in hexadecimal.
OP12_SQL = r"""
WITH steps AS (
  SELECT list(list_reduce([n, 1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t
  FROM range(256) r(n)),
words AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
wanted AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark),
own AS (SELECT doc_id, row, unnest(w) AS word FROM words),
known AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM own UNION SELECT word FROM wanted)),
bucketed AS (
  SELECT word, xor(list_reduce(list_concat([4294967295]::BIGINT[], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS b
  FROM known, steps),
s AS (SELECT b, count(*)::DOUBLE AS s FROM own JOIN bucketed USING (word) GROUP BY b),
t AS (SELECT b, count(*)::DOUBLE AS t FROM wanted JOIN bucketed USING (word) GROUP BY b),
gain AS (
  SELECT b, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT count(*) FROM own) + 10000)::DOUBLE / ((coalesce(s, 0) + 1) * ((SELECT count(*) FROM wanted) + 10000)::DOUBLE)))::BIGINT AS g
  FROM range(10000) r(b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
weights AS (SELECT row, sum(g)::BIGINT AS weight FROM own JOIN bucketed USING (word) JOIN gain USING (b) GROUP BY row),
scores AS (
  SELECT doc_id, row, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM words LEFT JOIN weights USING (row)),
drawn AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scores LEFT JOIN drawn USING (row)
"""
