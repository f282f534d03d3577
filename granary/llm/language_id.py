"""Language identification by Bayesian fusion of evidence.

For each language l the log posterior adds up
  - the text: a multinomial over hashed letter n-grams, fitted on a bounded sample
    of labelled rows. N-grams of a text aren't independent, so the whole text's
    log likelihood is scaled to weigh as much as EFFECTIVE of them;
  - the declared language (of the markup, or a column): P(declared | l);
  - the address suffix (the host's last label): P(suffix | l);
  - the host's prior: P(l | host), smoothed towards its domain's (last two labels),
    which is smoothed towards that of all rows.
The last three are counted over all rows by grouped aggregation of the posteriors
that the text alone gives, so no label is trusted that the texts contradict.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, fresh, table, written
from .graph import small

BUCKETS, EFFECTIVE, KAPPA = 1 << 14, 60.0, 20.0
#: Labelled rows for fitting: about as many, shared among the languages, of at most so many characters; languages with so many rows at least.
SAMPLE_ROWS, SAMPLE_CHARS, LEAST_ROWS = 4000, 20_000, 5
#: Languages of a model at most: their counts come to the driver, and 64 KB of each to every worker.
MOST_LANGUAGES = 200
#: A language's share of the sample at least, however many languages there are.
LANGUAGE_ROWS = 200
_LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str) -> np.ndarray:
    """Buckets of the letter bigrams and trigrams of a whole text, lower-cased; other characters part words."""
    u = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    u = np.where(_LETTER[u.astype(np.int64)], u, np.uint64(32))
    u = np.concatenate([[np.uint64(32)], u, [np.uint64(32)]])
    blank = u == 32
    two = u[:-1] * np.uint64(0x9E3779B1) + u[1:] * np.uint64(0x85EBCA77)
    three = two[:-1] * np.uint64(0xC2B2AE3D) + u[2:] * np.uint64(0x27D4EB2F) + np.uint64(1)
    h = np.concatenate([two[~(blank[:-1] & blank[1:])], three[~(blank[1:-1] & (blank[:-2] | blank[2:]))]])
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(50)).astype(np.int64)


class LanguageModel:
    """Languages and the log probability of each bucket; the row after the languages' is uniform (no language)."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        table_ = np.array([counts[x] for x in self.languages] or np.zeros((0, BUCKETS)), np.float64).reshape(-1, BUCKETS) + 0.05
        self.log = np.concatenate([np.log(table_ / table_.sum(1, keepdims=True)), np.full((1, BUCKETS), -math.log(BUCKETS))]).astype(np.float32)

    def evidence(self, text: str | None) -> np.ndarray:
        """Scaled log likelihoods: each language's, then no language's. No letters: zeros."""
        found = grams(text) if text else np.zeros(0, np.int64)
        if not len(found):
            return np.zeros(len(self.log))
        times = np.bincount(found, minlength=BUCKETS) if len(found) > BUCKETS else None
        whole = (self.log @ times.astype(np.float32) if times is not None else self.log[:, found].sum(1, dtype=np.float64)).astype(np.float64)
        return whole * (min(EFFECTIVE, len(found)) / len(found))


def fit(docs: DataFrame, text: str = "text", label: str = "lang") -> LanguageModel:
    """A model from a sample of rows with a label and a text: see SAMPLE_ROWS. Other rows only don't serve for fitting.

    Each language has a share of its own, so every one with LEAST_ROWS labelled
    rows is in the model, whatever the size of the others; without such a one,
    those with the most rows. Longer texts serve only for a language with too few
    others. More than MOST_LANGUAGES of them raise ValueError. Equal texts of a language count once, so copies neither fill the sample
    nor keep others out; the text with the least hash is always taken.
    """
    rows = docs.select(column(docs, label).alias("l"), column(docs, text).alias("t")).where("l is not null and l <> '' and t is not null")
    hashed, fits = F.pmod(F.xxhash64("t"), F.lit(1 << 30)), F.char_length("t") <= SAMPLE_CHARS
    different = lambda c: F.greatest(F.approx_count_distinct(c, 0.02), F.lit(1))
    sizes = rows.groupBy("l").agg(F.count("*").alias("n"), F.min(hashed).alias("first"), F.count_if(fits).alias("n_fit"), F.min(F.when(fits, hashed)).alias("first_fit"), different(F.xxhash64("t")).alias("texts"), different(F.when(fits, F.xxhash64("t"))).alias("texts_fit"))
    found = sizes.where(F.col("n") >= LEAST_ROWS).limit(MOST_LANGUAGES + 1).collect()  # a row a language
    if not found:
        most = sizes.agg(F.max("n")).first()[0]
        found = sizes.where(F.col("n") == most).limit(MOST_LANGUAGES + 1).collect() if most else []
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels: they are taken for languages, of which each is {BUCKETS} numbers of the model")
    if not found:
        return LanguageModel({})
    wanted = max(SAMPLE_ROWS // len(found), LANGUAGE_ROWS)
    shares = []
    for r in found:
        long = r.n_fit < min(LEAST_ROWS, r.n)
        n, first = (r.texts, r.first) if long else (r.texts_fit, r.first_fit)
        shares.append((r.l, long, max(first + 1, int(min(1.0, wanted / n) * (1 << 30)))))
    shares_ = F.broadcast(docs.sparkSession.createDataFrame(shares, "l string, long boolean, below long"))
    sample = rows.join(shares_, "l").where((hashed < F.col("below")) & (F.col("long") | fits)).groupBy("l", F.sha2("t", 256)).agg(F.first("t").alias("t"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, x in zip(b["l"], b["t"], strict=True):
                total[lang] = total.get(lang, 0) + np.bincount(grams(x), minlength=BUCKETS)
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"l": lang, "bucket": at, "n": c[at]})

    counts = sample.mapInPandas(count, "l string, bucket int, n long").groupBy("l", "bucket").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS a language
    made = {r.l: np.zeros(BUCKETS) for r in found}
    for r in counts:
        made[r.l][r.bucket] = r.n
    return LanguageModel(made)


def host_of(url: Column) -> Column:
    """The host of a url, lower-cased, without user and port; what has no ``://`` is taken for a host itself."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[^:/?#]*://)?([^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")


def markup_language(html: Column) -> Column:
    """The primary subtag that an ``<html>`` element declares, lower-cased; empty if none."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-zA-Z]{2,3})""", 1))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", declared: Column | None = None, address: Column | None = None, least: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``carry``, else all) with ``language``, ``confidence`` (double), ``text_language`` and ``accepted`` (boolean).

    ``declared`` is a declared language, ``address`` a url or host; null or
    empty ones say nothing. A row is accepted if its text has letters, fits its
    language better than no language, and the posterior is at least ``least``;
    a text without letters, null ones included, gets the language that the other
    evidence favours but isn't accepted. Equal posteriors: the first language in
    order. Without any language in the model all rows get null and aren't
    accepted. Whole texts are read, whatever their length; repeated rows get equal
    results, an empty table an empty one. Where ``docs`` has columns of these
    names, the new ones get a ``_``.
    """
    langs, carry = model.languages, docs.columns if carry is None else carry
    names = fresh(docs, "language", "confidence", "text_language", "accepted")
    if not langs:
        return docs.select(*[column(docs, c) for c in carry]).withColumns({names[0]: F.lit(None).cast("string"), names[1]: F.lit(0.0), names[2]: F.lit(None).cast("string"), names[3]: F.lit(False)})
    evidence, said, suffix, domain, host = fresh(docs, "evidence_", "said_", "suffix_", "domain_", "host_")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages times BUCKETS numbers

    def weighed(x: str | None) -> np.ndarray:
        """The text's evidence for each language and for none, and each language's share of it: the text alone, and 0 without letters."""
        e = shared.value.evidence(x)
        own = np.exp(e[: len(langs)] - e[: len(langs)].max()) if e[len(langs)] < 0 else np.zeros(len(langs))
        return np.r_[e, own / max(own.sum(), 1.0)]

    @F.pandas_udf("array<double>")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([weighed(x) for x in b])

    empty = F.lit("")
    at = host_of(address) if address is not None else empty
    scored = docs.withColumns({evidence: weigh(column(docs, text)), said: F.lower(F.coalesce(declared, empty)) if declared is not None else empty, host: at})
    scored = scored.withColumns({suffix: F.when(F.col(host).contains("."), F.substring_index(host, ".", -1)).otherwise(empty), domain: F.substring_index(host, ".", -2)})
    scored = written(scored.select(*[column(docs, c) for c in carry], evidence, said, suffix, domain, host), "evidence")
    e = F.col(evidence)
    has_text = e[len(langs)] < 0
    counted = scored.select(said, suffix, domain, host, F.when(has_text, 1.0).otherwise(0.0).alias("n"), *[e[len(langs) + 1 + i].alias(f"n{i}") for i in range(len(langs))])
    sums = [F.sum(f"n{i}").alias(f"n{i}") for i in ["", *range(len(langs))]]  # the rows, and how they are shared among the languages
    total = counted.agg(*sums[1:]).first()
    total = [float(x or 0) for x in total]
    whole = [(x + 1) / (sum(total) + len(langs)) for x in total]

    def smoothed(keys: list[str]) -> DataFrame:
        return written(counted.groupBy(*keys).agg(*sums), "counts")

    def ratios(key: str, name: str) -> DataFrame:
        """log P(key | l) up to a constant, KAPPA rows of no news added; the empty key says nothing."""
        value = [F.when(F.col(key) == "", 0.0).otherwise(F.log((F.col(f"n{i}") + KAPPA * whole[i]) / (F.col("n") + KAPPA) / whole[i])) for i in range(len(langs))]
        return written(smoothed([key]).select(key, F.array(*value).alias(name)), name)

    declares, ends = ratios(said, "declares"), ratios(suffix, "ends")
    by_domain = smoothed([domain]).select(domain, *[F.col(f"n{i}").alias(f"d{i}") for i in ["", *range(len(langs))]])
    by_host = smoothed([host, domain]).join(by_domain, domain)
    prior = [F.log((F.col(f"n{i}") + KAPPA * (F.col(f"d{i}") + KAPPA * whole[i]) / (F.col("d") + KAPPA)) / (F.col("n") + KAPPA)) for i in range(len(langs))]
    priors = written(by_host.select(host, F.array(*prior).alias("prior")), "prior")
    out = scored.join(small(priors), host, "left").join(small(declares), said, "left").join(small(ends), suffix, "left")
    z = [e[i] + F.col("prior")[i] + F.col("declares")[i] + F.col("ends")[i] for i in range(len(langs))]
    posterior = fresh(docs, "posterior_")[0]
    out = out.withColumn(posterior, F.array(*z))
    p = F.col(posterior)
    best = F.array_max(p)
    weights = F.aggregate(p, F.lit(0.0), lambda a, x: a + F.exp(x - best))
    name = F.array(*[F.lit(x) for x in langs])
    pick = lambda a: F.get(name, (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    only = F.slice(e, 1, len(langs))
    out = out.withColumns({names[0]: pick(p), names[1]: 1 / weights, names[2]: F.when(has_text, pick(only))})
    out = out.withColumn(names[3], has_text & (F.array_max(only) > e[len(langs)]) & (F.col(names[1]) >= least))
    return out.select(*[column(out, c) for c in carry], *names)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = identify(docs, fit(docs), declared=F.col("lang"), address=F.col("source"), carry=["doc_id"])
    return out.select("doc_id", "language", F.round("confidence", 6).alias("confidence"), "text_language", F.col("accepted").alias("kept"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with all its evidence: markup language, address suffix and host of web pages."""
    docs = table(spark, sf_dir, "documents").select("text", "lang")
    pages = table(spark, sf_dir, "pages").withColumn("text", F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " "))
    out = identify(pages, fit(docs), declared=markup_language(F.col("html")), address=F.col("url"), carry=["page_id"])
    return out.select("page_id", "language", F.round("confidence", 6).alias("confidence"), "text_language", F.col("accepted").alias("kept"))
