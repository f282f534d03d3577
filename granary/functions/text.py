"""Text and url functions as column expressions: all run in the JVM.

Python's ideas of white space and of word characters are wider than Java's
default ones, so the patterns name them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
SPACE = r"[\s\u0085\p{Z}\x1c-\x1f]"
#: Urls that contain one of these, or end in one of these, are skipped.
SKIP_PATTERNS = ("/search", "/login", "/logout", "/api/", "/feeds/", "/print/", "?page=", "#", "mailto:", "tel:", "javascript:")
SKIP_EXTENSIONS = (
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar", ".tar", ".gz", ".jpg", ".jpeg", ".png", ".gif", ".svg",
    ".webp", ".ico", ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".css", ".js", ".woff", ".woff2", ".ttf", ".eot",
)
#: Urls of catalogue pages.
COURSE_URL = r"/(?:undergraduate|postgraduate|research)/courses/\d{4}/[A-Z]{4}\d{4}"
PROGRAM_URL = r"/(?:undergraduate|postgraduate|research)/programs/\d{4}/\d{4}"
_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
_AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"
#: An attribute of a tag, and its value with its quotes. All possessive: no backtracking, and no recursion in Java.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
_ATTRIBUTE = rf"[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?+"
_BEFORE_PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def tokens(c: Column) -> Column:
    """Lower-cased runs of word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def without_repeats(lines: Column) -> Column:
    """An array without elements equal to the one before."""
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))))
    pairs = F.zip_with(lines, before, lambda x, y: F.struct(x.alias("x"), y.alias("y")))  # the arrays are made once, not in the lambda
    return F.transform(F.filter(pairs, lambda p: p.x.isNotNull() & (p.y.isNull() | (p.x != p.y))), lambda p: p.x)


def clean_lines(c: Column) -> Column:
    """Lines with single spaces, stripped, of more than three characters, without immediate repeats."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: strip(F.regexp_replace(x, rf"{SPACE}+", " ")))
    return without_repeats(F.filter(lines, lambda x: F.char_length(x) > 3))


def clean_text(c: Column) -> Column:
    return F.array_join(clean_lines(c), "\n")


def chunk_id(url: Column, key: Column) -> Column:
    """16 hexadecimal digits that depend on the url and the chunk's key only."""
    return F.substring(F.sha2(F.concat(url, F.lit("::chunk::"), key.cast("string")), 256), 1, 16)


def before_colon(c: Column) -> Column:
    return F.when(c.contains(":"), F.substring_index(c, ":", 1)).otherwise("")


def preview(c: Column, n: int = 250) -> Column:
    return F.substring(c, 1, n)


def url_path(url: Column) -> Column:
    """The path without parameters of its last segment, query and fragment."""
    path = F.regexp_extract(F.regexp_replace(url, _BEFORE_PATH, ""), r"^([^?#]*)", 1)
    return F.regexp_replace(path, r";[^/]*$", "")


def url_authority(url: Column) -> Column:
    return F.regexp_extract(url, _AUTHORITY, 1)


def normalize_url(url: Column) -> Column:
    """Scheme, authority and path without slashes at its end."""
    return F.concat(F.lower(F.regexp_extract(url, _SCHEME, 1)), F.lit("://"), url_authority(url), F.regexp_replace(url_path(url), r"/+$", ""))


def url_extension(url: Column) -> Column:
    """The lower-cased extension of the path's last segment; dots at its beginning begin no extension."""
    return F.lower(F.regexp_extract(url_path(url), r"[^/.][^/]*(\.[^./]*)$", 1))


def skipped_url(url: Column) -> Column:
    low = F.lower(url)
    found = reduce(Column.__or__, [low.contains(p) for p in SKIP_PATTERNS])
    return found | url_extension(url).isin(*SKIP_EXTENSIONS)


def valid_link(url: Column, domains: tuple[str, ...]) -> Column:
    ok = url.isNotNull() & (url != "") & url.startswith("http") & url_authority(url).isin(*domains) & ~skipped_url(url)
    return F.coalesce(ok, F.lit(False))


def resolve_link(base: Column, href: Column) -> Column:
    """Absolute urls and root-relative ones; null for others (see ``functions.html.join_urls``)."""
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:]*:)", 1), href))
        .when(href.startswith("/"), F.concat(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1), href))
    )


def hrefs(html: Column) -> Column:
    """The href of each anchor in any case and quoting, the first of several; empty ones left out.

    A tag that is never closed is read to the end and left out, so what lies in it is
    read once: the time is linear, also for a page of nothing but beginnings of tags.
    """
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(rf"(?i)<a(?=[\s/])(?:[\s/]++|{_ATTRIBUTE})*+(?:>|\z)"), F.lit(0))
    closed = F.filter(tags, lambda x: x.endswith(">"))
    values = F.transform(closed, lambda x: F.regexp_extract(x, rf"(?i)^<a(?:[\s/]++|(?!href(?:[\s/=]|$)){_ATTRIBUTE})*+href\s*+=\s*+({_VALUE})", 1))
    return F.filter(F.transform(values, lambda x: F.regexp_replace(x, r"""^(?s)(["'])(.*)\1$""", "$2")), lambda x: x != "")


def page_kind(url: Column) -> Column:
    """course, program or null, by the url."""
    return F.when(url.rlike(COURSE_URL), "course").when(url.rlike(PROGRAM_URL), "program")


def level_of(url: Column) -> Column:
    return F.when(url.contains("/postgraduate/"), "postgraduate").when(url.contains("/research/"), "research").otherwise("undergraduate")


def code_of(url: Column, kind: str) -> Column:
    return F.regexp_extract(url, r"/([A-Z]{4}\d{4})$" if kind == "course" else r"/(\d{4})$", 1)


def without_brand(title: Column, brand: str) -> Column:
    """Without a `` | brand...`` at the end."""
    return F.regexp_replace(title, rf"\s*\|\s*\Q{brand}\E.*$", "")


def without_handbook(title: Column) -> Column:
    return F.regexp_replace(title, r"^Handbook\s*[-–—]\s*", "")


def credits(html: Column) -> Column:
    """Digits before the first "Units of Credit", as text."""
    return F.regexp_extract(html, r"(\d+)\s*Units?\s*of\s*Credit", 1)


def embedded_json(html: Column) -> Column:
    """The page's embedded data as VARIANT; null where there is none or it isn't JSON."""
    return F.try_parse_json(F.nullif(F.regexp_extract(html, r'(?s)<script\s+id="__NEXT_DATA__"\s+type="application/json">(.*?)</script>', 1), F.lit("")))


def list_of(text: Column) -> Column:
    """Comma-separated values, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _inline(c: Column) -> Column:
    """Strong and emphasized runs, and links to the web or within the site."""
    c = F.regexp_replace(c, r"\*\*([^*]+)\*\*", "<strong>$1</strong>")
    c = F.regexp_replace(c, r"\*([^*\s][^*]*)\*", "<em>$1</em>")
    return F.regexp_replace(c, r"""\[([^\[\]]+)\]\(((?:https?://|/|#)[^()\s"]*)\)""", '<a href="$2" target="_blank" rel="noopener">$1</a>')


def _spans(line: Column) -> Column:
    """A line with its inline parts; what stands between two backticks is code and nothing else."""
    parts = F.split(line, "`", -1)
    last = F.size(parts) - 1

    def part(x: Column, i: Column) -> Column:
        alone = F.concat(F.lit("`"), _inline(x))  # a backtick that no other one closes
        return F.when(i % 2 == 0, _inline(x)).when(i == last, alone).otherwise(F.concat(F.lit("<code>"), x, F.lit("</code>")))

    return F.array_join(F.transform(parts, part), "")


#: What a line is, by its beginning; the line without it is what it says.
MARKS = (("h1", r"^# (?=.)"), ("h2", r"^## (?=.)"), ("h3", r"^### (?=.)"), ("ul", r"^[-*] (?=.)"), ("ol", r"^\d+\. (?=.)"))


def render_markdown(c: Column) -> Column:
    """A small Markdown as HTML: each line is a heading, an item of a list, blank, or text.

    Items that follow each other are one list, ``<ol>`` if they are numbered, and
    lines of text one paragraph with ``<br>`` between them. Null and blank texts are empty.
    """
    lines = F.split(escape_html(F.coalesce(c, F.lit(""))), r"\r?\n", -1)
    kind = lambda x: reduce(lambda out, m: out.when(x.rlike(m[1]), m[0]), MARKS, F.when(F.trim(x) == "", "")).otherwise("p")
    kinds = F.transform(lines, kind)
    tag = lambda name, end="": F.when(name == "", "").otherwise(F.concat(F.lit(f"<{end}"), name, F.lit(">")))

    def rendered(line: Column, i: Column) -> Column:
        own, before = F.get(kinds, i), F.when(i > 0, F.get(kinds, i - 1)).otherwise("")
        goes_on = (own == before) & own.isin("ul", "ol", "p")
        said = _spans(reduce(lambda x, m: F.when(own == m[0], F.regexp_replace(line, m[1], "")).otherwise(x), MARKS, line))
        item = F.when(own.isin("ul", "ol"), F.concat(F.lit("<li>"), said, F.lit("</li>"))).when(own == "", "").otherwise(said)
        between = F.when(goes_on & (own == "p"), "<br>").when(goes_on, "").otherwise(F.concat(tag(before, "/"), tag(own)))
        return F.concat(between, item)

    return F.concat(F.array_join(F.transform(lines, rendered), ""), tag(F.element_at(kinds, -1), "/"))


def response_time(ms: Column) -> Column:
    """Above a second as seconds with one decimal, else as milliseconds, which are whole numbers.

    The decimal is that of JavaScript's ``(ms / 1000).toFixed(1)``: the tenth nearest
    to the double, and of two as near the larger. Only where ``ms`` ends in 50 can the
    double lie below the half that it stands for; its exact error, from the double's
    upper and lower halves, tells.
    """
    x = ms / 1000
    upper = x * 134217729.0 - (x * 134217729.0 - x)  # 2 ** 27 + 1
    below = (ms % 100 == 50) & ((upper * 1000 - ms) + (x - upper) * 1000 < 0)
    tenths = F.floor((ms + 50) / 100) - F.when(below, 1).otherwise(0)
    return F.when(ms > 1000, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("s"))).otherwise(F.concat(ms.cast("string"), F.lit("ms")))
