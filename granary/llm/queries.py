"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.runtime import prepared

from . import balanced_packing, embedding_dedup, html_extract, language_id, ngram_join, packing, quality, resampling, sentencepiece_scan, token_counts, url_filter, warc


def _prepared(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepared(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {
    name: _prepared(f)
    for name, f in {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_html_extraction": html_extract.op4_html_extraction,
        "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
        "op6_best_fit_packing": packing.op6_best_fit_packing,
        "op7_language_id": language_id.op7_language_id,
        "language_id_pages": language_id.language_id_pages,
        "op8_ngram_jaccard_join": ngram_join.op8_ngram_jaccard_join,
        "op9_sentencepiece": sentencepiece_scan.op9_sentencepiece,
        "op10_warc": warc.op10_warc,
        "op11_balanced_packing": balanced_packing.op11_balanced_packing,
        "op12_importance_resampling": resampling.op12_importance_resampling,
    }.items()
}
ORACLE = {
    "op1_url_filter": url_filter.OP1_SQL, "op2_quality_rules": quality.OP2_SQL, "op4_html_extraction": html_extract.OP4_SQL, "op5_embedding_dedup": embedding_dedup.OP5_SQL,
    "op8_ngram_jaccard_join": ngram_join.OP8_SQL, "op10_warc": warc.OP10_SQL, "op12_importance_resampling": resampling.OP12_SQL,
}
