"""What a server would offer, as functions: chat, health and stats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from granary.operators import answer
from granary.operators.vectors import Collection


class ServiceError(Exception):
    """``status`` as an HTTP server would give it."""

    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status, self.detail = status, detail


class Service:
    def __init__(self, collection: Collection | None, search: Callable[[str, int], DataFrame] | None, model: answer.LanguageModel | None = None):
        self.collection, self.search, self.model = collection, search, model or answer.language_model()

    def chat(self, question: str) -> dict:
        if not isinstance(question, str) or not 2 <= len(question) <= 1000:
            raise ServiceError(422, "a question has 2 to 1000 characters")
        if self.collection is None or self.search is None:
            raise ServiceError(503, "the knowledge base isn't there yet: refresh it first")
        try:
            return answer.ask(question, self.search, self.model)
        except Exception as e:
            raise ServiceError(500, f"no answer: {e}") from e

    def health(self) -> dict:
        ok = self.collection is not None
        return {"status": "ok" if ok else "degraded", "llm_provider": type(self.model).__name__ if ok else "not initialized", "knowledge_base_size": self.collection.read().count() if ok else 0}

    def stats(self) -> dict:
        return self.collection.stats().first().asDict() if self.collection is not None else {"total_chunks": 0, "sample_urls": []}
