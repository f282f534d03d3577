"""A corpus pipeline: quality rules, language identification, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) with the columns of ``documents`` and works
on all that the stage before kept. All but the last return the same columns: the
quality rules' text is the cleaned one, and lang is the language identified.

For all stages: a null doc_id is a document's like any other and stays null; rows
that repeat a doc_id are documents of their own; empty tables give empty ones;
columns beyond those of ``documents`` don't go on; texts are read whole, however
long. What happens to null and empty texts, ties and repeats is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import language_id, ngram_join, packing, quality
from granary.llm.common import table, written
from granary.llm.queries import prepared

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines are removed from the texts; documents that fail go.

    Null and empty texts have no words and go. Equal rows fare alike. n_chars is
    counted anew, whatever it was.
    """
    prepared(spark)
    judged = quality.apply_rules(docs.select(*COLUMNS), clean="clean").where("verdict.kept")
    return judged.withColumn("text", F.col("clean")).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def language_identification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; lang becomes the one identified.

    Texts without letters, null and empty ones included, go. Null and empty lang
    and source say nothing. Of equally probable languages it is the first in order.
    """
    prepared(spark)
    docs = docs.select(*COLUMNS)
    found = language_id.identify(docs, language_id.fit(docs), declared=F.col("lang"), address=F.col("source"))
    return found.where("accepted").withColumn("lang", F.col("language")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id.

    Rows that repeat this doc_id stay with it; a group without any doc_id stays
    whole. Null texts and texts without words are near nothing and stay.
    """
    prepared(spark)
    return ngram_join.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their place in a sequence.

    A null or empty text is one piece of one id. Pieces of equal length are
    placed in the order of doc_id, piece and ids; equal ones are interchangeable.
    """
    prepared(spark)
    out = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality_rules", quality_rules), ("language_id", language_identification), ("ngram_jaccard_join", near_duplicates), ("best_fit_packing", packed)]
#: SQL has no way to say a language model, a tokenizer or a packing: the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
