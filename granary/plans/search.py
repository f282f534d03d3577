"""Command lines over what ``plans.refresh`` has stored: search, ask, and the collection.

``spark-submit -m granary.plans.search search QUESTION``, ``... vectors QUESTION``,
``... ask QUESTION``, ``... stats``, ``... peek`` and ``... clear``; ``-n`` results.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from granary.config import Settings
from granary.operators import answer, retrieve
from granary.operators.text_index import TextIndex
from granary.operators.vectors import Collection
from granary.plans.api import Service
from granary.runtime import ship


def open_search(spark: SparkSession, settings: Settings):  # noqa: ANN201
    """(collection, search): ``search(question, n)`` is hybrid where there is an index, else by embedding alone."""
    ship(spark)
    collection, path = Collection(spark, settings.index_dir, settings.collection), f"{settings.index_dir}/bm25"
    index = TextIndex(spark, path)
    index = index if index.segments else None

    def search(question: str, n: int) -> DataFrame:
        return retrieve.hybrid_search(index, collection.read(), question, n)

    return collection, search


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("what", choices=["search", "vectors", "ask", "stats", "peek", "clear"])
    p.add_argument("question", nargs="?", default="")
    p.add_argument("-n", type=int, default=5)
    a = p.parse_args(argv)
    if a.what in ("search", "vectors", "ask") and not a.question:
        p.error("a question is needed")
    spark, settings = SparkSession.builder.appName("granary-search").getOrCreate(), Settings.from_env()
    collection, search = open_search(spark, settings)
    if a.what == "ask":
        print(json.dumps(Service(collection, search, answer.language_model(settings.llm_provider)).chat(a.question), indent=1))
    elif a.what == "stats":
        print(json.dumps(collection.stats().first().asDict()))
    elif a.what == "clear":
        collection.clear()
        collection.vacuum()
    else:
        found = collection.peek(a.n) if a.what == "peek" else search(a.question, a.n) if a.what == "search" else retrieve.vector_only_search(collection.read(), a.question, a.n)
        for r in (found if a.what == "peek" else found.orderBy("rank")).drop("embedding").toJSON().collect():
            print(r)


if __name__ == "__main__":
    main()
