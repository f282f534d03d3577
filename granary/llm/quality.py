"""Quality rules: line-first cleaning.

Each line of a text is judged by itself; lines that fail are removed, and a
document that loses too large a part of its words with them is rejected. So one
bad line costs a line, and only a text made of bad lines costs a document.
Whole texts are judged, in one Arrow-batched pass without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, column, fresh, table

_WORD = regex.compile(WORD)
#: End marks of all scripts with the marks and brackets that may follow them; Thai and Lao write none.
_END = regex.compile(r"""[.!?…:;"'”’»)\]\p{Sentence_Terminal}：；︰؛།༎」』】〉》〕〗）］｝｣＂＇\p{Thai}\p{Lao}]$""")
_SEPARATOR = regex.compile(r"^[|»›•·>/–—-]+$")
_LOWER, _UPPER = regex.compile(r"\p{Ll}"), regex.compile(r"\p{Lu}")
SYMBOLS = "#*$%&|<>"
#: Phrases, in lower case, of lines that belong to a site and not to a text: English, German, French, Spanish. A line's
#: frequency wouldn't do: the lines of a text with many copies are frequent too, and one of its copies has to stay.
PHRASES = (
    "all rights reserved", "licensed under", "cookie policy", "accept cookies", "uses cookies", "privacy policy", "terms of use",
    "terms of service", "enable javascript", "lorem ipsum", "click here", "subscribe to our", "sign up for our", "skip to content",
    "alle rechte vorbehalten", "lizenziert unter", "verwendet cookies", "verwenden cookies", "datenschutzerklärung", "nutzungsbedingungen", "hier klicken", "newsletter abonnieren", "zum inhalt springen",
    "tous droits réservés", "sous licence", "utilise des cookies", "utilisons des cookies", "politique de confidentialité", "conditions d'utilisation", "cliquez ici", "abonnez-vous à notre", "aller au contenu",
    "todos los derechos reservados", "bajo la licencia", "utiliza cookies", "utilizamos cookies", "política de privacidad", "términos de uso", "haga clic aquí", "suscríbase a nuestro", "saltar al contenido",
)
_PHRASE = regex.compile("|".join(map(regex.escape, PHRASES)))
VERDICTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_removed_lines long, n_removed_words long, kept boolean"


@dataclass(frozen=True)
class Rules:
    """Limits. Of a line: words below which it needs an end mark; symbols a word
    and separators a word at most; words from which capitals alone, and few
    distinct words, fail it; words from which a site's phrase fails it only if
    over half of its words belong to such. Of a document: per cent of its words it may lose.
    """

    short_line: int = 8
    symbols_pct: int = 20
    separators_pct: int = 25
    caps_words: int = 3
    repeat_words: int = 10
    distinct_pct: int = 34
    phrase_words: int = 20
    max_lost_pct: int = 50


def line_fails(line: str, words: list[str], rules: Rules, phrases: Sequence[str] = PHRASES) -> str | None:
    """The rule that a line breaks. ``words`` are its words, at least one; ``phrases`` those of PHRASES that it could have."""
    n = len(words)
    if sum(map(line.count, SYMBOLS)) * 100 > rules.symbols_pct * n:
        return "symbols"
    if n < rules.short_line and not _END.search(words[-1]):
        return "no end mark"
    if sum(1 for w in words if _SEPARATOR.match(w)) * 100 > rules.separators_pct * n:
        return "navigation"
    if n >= rules.caps_words and not _LOWER.search(line) and _UPPER.search(line):
        return "capitals"
    if n >= rules.repeat_words and len(set(words)) * 100 < rules.distinct_pct * n:
        return "repetition"
    found = _PHRASE.findall(line.lower()) if phrases else ()
    if found and (n < rules.phrase_words or 2 * sum(len(x.split()) for x in found) > n):
        return "boilerplate"
    return None


def base_counts(text: str, words: list[str]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    n, repeated = len(words), 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(windows) != len(set(windows)):
        times, reach = Counter(windows), 0  # reach: the first word not yet counted
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return sum(map(len, words)) if n else 0, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def judge(text: str | None, rules: Rules = Rules()) -> tuple[tuple, str]:
    """The fields of VERDICTS and the text of the lines that stay, of one whole text."""
    text = text or ""
    words = _WORD.findall(text)
    counts, n = base_counts(text, words), len(words)
    failed = n < 50 or 100 * counts[3] > 50 * n
    low = text.lower()
    phrases = [p for p in PHRASES if p in low]  # mostly none
    seen: set[str] = set()
    stay, lines, gone, lost = [], 0, 0, 0
    for line in text.split("\n"):
        if not (own := _WORD.findall(line)):
            stay.append(line)
            continue
        lines += 1
        if line in seen or line_fails(line, own, rules, phrases):
            gone, lost = gone + 1, lost + len(own)
        else:
            seen.add(line)
            stay.append(line)
    kept = not failed and 100 * lost <= rules.max_lost_pct * n
    return (n, *counts, failed, lines, gone, lost, kept), "\n".join(stay)


def apply_rules(docs: DataFrame, text: str = "text", rules: Rules = Rules(), clean: str | None = None) -> DataFrame:
    """``docs`` with a struct column ``verdict`` (VERDICTS) and, if ``clean`` names one, the cleaned text in that column.

    A null or empty text has no words and fails; a cleaned null text stays null.
    A line equal to an earlier line that stayed is removed. Very long texts cost
    time in proportion. Rows are judged one by one, so repeated rows get equal
    verdicts and an empty table gives an empty one. Columns named like the new
    ones keep their place; the new ones then get a ``_``.
    """
    name, new = fresh(docs, "verdict", clean or "cleaned")
    both = T.StructType([T.StructField("v", T._parse_datatype_string(VERDICTS)), T.StructField("t", T.StringType())])
    fields = T._parse_datatype_string(VERDICTS).fieldNames()

    @F.pandas_udf(both)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [judge(x, rules) for x in texts]
            verdicts = pd.DataFrame([v for v, _ in found], columns=fields)
            yield pd.DataFrame({"v": verdicts.to_dict("records"), "t": [None if x is None else t for x, (_, t) in zip(texts, found, strict=True)] if clean else None})

    # Called non-deterministic so that a filter on the verdict doesn't judge each text a second time.
    out = docs.withColumn(name, run.asNondeterministic()(column(docs, text)))
    v = F.col(f"`{name}`")
    if clean:
        out = out.withColumn(new, v["t"])
    return out.withColumn(name, v["v"])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs).select("doc_id", "verdict.*")


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT k, i, ws[i:i+2] AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
r AS (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS times FROM g),
covered AS (SELECT k, count(DISTINCT i + j) AS n FROM r, (SELECT unnest([0, 1, 2]) AS j) WHERE times > 1 GROUP BY k),
l0 AS (SELECT k, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS p FROM d),
l AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw, row_number() OVER (PARTITION BY k, line ORDER BY p) AS nth
      FROM l0 WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT *, len(lw) AS n,
        length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS sym,
        len(list_filter(lw, lambda x: regexp_matches(x, '^[|»›•·>/–—-]+$'))) AS seps FROM l),
b AS (SELECT *, nth > 1
        OR sym * 100 > 20 * n
        OR (n < 8 AND NOT regexp_matches(lw[n], '[.!?…:;"''”’»)\]]$'))
        OR seps * 100 > 25 * n
        OR (n >= 3 AND NOT regexp_matches(line, '\p{Ll}') AND regexp_matches(line, '\p{Lu}'))
        OR (n >= 10 AND len(list_distinct(lw)) * 100 < 34 * n)
        OR len(regexp_extract_all(lower(line), '@PHRASES@')) > 0 AND (n < 20 OR 2 * list_sum(list_transform(regexp_extract_all(lower(line), '@PHRASES@'), lambda x: len(string_split(x, ' ')))) > n) AS bad
      FROM f),
ls AS (SELECT k, count(*) AS n_lines, count(*) FILTER (nth > 1) AS n_dup_lines, count(*) FILTER (bad) AS n_removed_lines,
         coalesce(sum(n) FILTER (bad), 0)::BIGINT AS n_removed_words FROM b GROUP BY k),
a AS (SELECT d.k, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(ls.n_dup_lines, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
        coalesce(ls.n_lines, 0) AS n_lines, coalesce(ls.n_removed_lines, 0) AS n_removed_lines, coalesce(ls.n_removed_words, 0) AS n_removed_words
      FROM d JOIN w USING (k) LEFT JOIN covered USING (k) LEFT JOIN ls USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_lines, n_removed_lines, n_removed_words,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_removed_words <= 50 * n_words AS kept
FROM a
""".replace("@PHRASES@", "|".join(PHRASES).replace("'", "''"))
