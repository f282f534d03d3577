"""The recursive splitter: texts in pieces of limited length that overlap.

The first separator that a text has cuts it; a separator stays at the beginning of
the piece after it. Pieces that are too long are cut by the separators after it;
short ones are put together again up to the limit, each result taking over up to
``overlap`` characters of the one before.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where texts are cut, in this order.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ", "")


def _cut(text: str, separator: str) -> list[str]:
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [x for x in (first, *(separator + x for x in rest)) if x]


def _joined(pieces: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    held: list[str] = []
    total = 0
    for p in pieces:
        if held and total + len(p) > size:
            if done := "".join(held).strip():
                out.append(done)
            while total > overlap or (total > 0 and total + len(p) > size):
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    if done := "".join(held).strip():
        out.append(done)
    return out


def split_text(text: str | None, size: int = 500, overlap: int = 80, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    if not text:
        return []
    at = next(i for i, s in enumerate(separators) if not s or s in text) if any(not s or s in text for s in separators) else len(separators) - 1
    rest = separators[at + 1 :]
    out: list[str] = []
    short: list[str] = []
    for p in _cut(text, separators[at]):
        if len(p) < size:
            short.append(p)
            continue
        out += _joined(short, size, overlap)
        short = []
        out += split_text(p, size, overlap, rest) if rest else [p]
    return out + _joined(short, size, overlap)


def split(text: Column, size: int = 500, overlap: int = 80) -> Column:
    """An array of pieces; empty for null and for the empty text."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([split_text(x, size, overlap) for x in texts], dtype=object)

    return run(text)


def split_many(texts: Column, size: int = 500, overlap: int = 80) -> Column:
    """For an array of texts, an array of their pieces: one array each."""

    @F.pandas_udf("array<array<string>>")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([[split_text(x, size, overlap) for x in row] if row is not None else [] for row in rows], dtype=object)

    return run(texts)
