"""Column functions on titles, summaries, URLs, dates and pages of a news feed."""

from __future__ import annotations

import html
import html.entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Parts of a URL as of RFC 3986, appendix B (fixed value).
URL_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
#: Query parameters that only track readers (fixed values).
TRACKING = ("tsrc", "cmpid", "ncid", "ocid")
TRACKING_PREFIXES = ("utm_", "ga_")
NAMED_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


@F.pandas_udf(StringType())
def _unescape(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def _unescape_ended(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known = lambda m: html.unescape(m[0]) if m[1] or m[0][1:] in html.entities.html5 else m[0]
    for texts in batches:
        yield texts.map(lambda t: re.sub("&(?:(#[0-9]+|#[xX][0-9A-Fa-f]+)|[A-Za-z][A-Za-z0-9]*);", known, t), na_action="ignore")


def decode_entities(text: Column, ended: bool = False) -> Column:
    """HTML entities decoded: the common ones by ``replace``, texts with others in Arrow batches, to which all other texts are null.

    As browsers do, some are known without their semicolon; with ``ended``, an entity that was cut off before it stays as it is.
    """
    plain = text
    for name, value in NAMED_ENTITIES:
        plain = F.replace(plain, F.lit(name), F.lit(value))
    rest = F.regexp_replace(text, "&(?:lt|gt|quot|#39|nbsp|amp);", "").rlike("&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);" + ("" if ended else "?"))
    return F.coalesce((_unescape_ended if ended else _unescape)(F.when(rest, text)), plain)


def none_if_empty(text: Column) -> Column:
    """``text``, named once (a task's Python function may be in it); null for an empty one."""
    return F.try_element_at(F.array_remove(F.array(text), ""), F.lit(1))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)[\s&&[^ ]]\s*| \s+", " "))  # single spaces are passed over


def normalize_title(title: Column, entities: bool = True) -> Column:
    """Lower-case letters, digits and single spaces of a title."""
    known = decode_entities(title) if entities else title
    return F.trim(F.regexp_replace(F.regexp_replace(collapse(F.lower(known)), "[^a-z0-9 ]+", ""), " {2,}", " "))


def normal_start(text: Column, n: int) -> Column:
    """The first ``n`` letters of :func:`normalize_title` of a text without entities.

    The normal form is made from left to right, so the start of a text gives
    the start of its form; the whole is only looked at where that is too short.
    """
    start = normalize_title(F.substring(text, 1, 2 * n), entities=False)
    return F.substring(F.when(F.length(start) >= n, start).otherwise(normalize_title(text, entities=False)), 1, n)


def clean_summary(text: Column, entities: bool = True) -> Column:
    """Text without tags and double spaces; null where nothing is left."""
    known = decode_entities(text) if entities else text
    return none_if_empty(collapse(F.regexp_replace(known, "<[^>]+>", " ")))


#: Fixed value: what heads a list of other news below an article.
RELATED = r"(?is)>\s*(?:More\s+News\s+From|Related\s+(?:News|Press\s+Releases|Articles)|Also\s+from\s+this\s+source)\b.*$"
#: Fixed value: a div that a side bar's class names, at the start of a text.
SIDEBAR = r'(?i)^<div\b[^>]*\bclass="[^"]*sidebar[^"]*"[^>]*>'


def without_side_bars(page: Column) -> Column:
    """A page with a space for each side bar, up to the end of its own div at any depth; one that never ends goes up to the page's end.

    The page is cut at its div tags, and one pass over these keeps the running
    depth; a side bar ends where the depth is what it was before it.
    """

    def step(state: Column, piece: Column) -> Column:
        closes = F.lower(F.substring(piece, 1, 6)) == "</div>"
        depth = state["depth"] + F.when(closes, -1).when(F.lower(F.substring(piece, 1, 4)) == "<div", 1).otherwise(0)
        outside = state["base"].isNull()
        starts = outside & piece.rlike(SIDEBAR)
        ends = closes & F.coalesce(depth == state["base"], F.lit(False))
        base = F.when(starts, state["depth"]).when(~ends, state["base"])
        rest = F.when(ends, F.substring(piece, 7, F.length(piece))).when(starts, " ").when(outside, piece)  # a bar's own end tag goes
        kept = F.when(rest.isNotNull(), F.array_append(state["kept"], rest)).otherwise(state["kept"])
        return F.struct(depth.alias("depth"), base.alias("base"), kept.alias("kept"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("int").alias("base"), F.array().cast("array<string>").alias("kept"))
    cut = lambda p: F.aggregate(F.split(p, "(?i)(?=<div|</div>)"), start, step, lambda state: F.array_join(state["kept"], ""))
    # The page has a name in the lambda, so that what it is made of is done once and not in each branch.
    return F.get(F.transform(F.array(page), lambda p: F.when(F.contains(F.lower(p), F.lit("sidebar")), cut(p)).otherwise(p)), F.lit(0))


def without_noise(page: Column) -> Column:
    """A page without scripts, styles, navigation, asides, footers and side bars, cut at a heading of related news."""
    out = F.regexp_replace(page, r"(?is)<(script|style|nav|aside|footer)\b[^>]*>.*?</\1\s*>", " ")
    return F.regexp_replace(without_side_bars(out), RELATED, ">")


def text_of(page: Column, ended: bool = False) -> Column:
    """Text of a page that :func:`without_noise` has cleaned; null where nothing is left."""
    return none_if_empty(collapse(decode_entities(F.regexp_replace(page, "<[^>]+>", " "), ended)))


def page_text(page: Column, ended: bool = False) -> Column:
    """Readable text of a page; null where nothing is left; ``ended`` as of :func:`decode_entities`."""
    return text_of(without_noise(page), ended)


def url_part(url: Column, part: str) -> Column:
    at = {"scheme": 1, "host": 2, "path": 3, "query": 4, "fragment": 5}[part]
    return F.regexp_extract(url, URL_PARTS, at)


def canonical_query(query: Column) -> Column:
    """Parameters without tracking and blank ones, decoded, sorted by name and value, and encoded again, so that spellings of one query agree."""
    decoded = lambda c: F.coalesce(F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")), c)
    encoded = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pairs = F.transform(F.split(query, "&"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(F.contains(p, F.lit("=")), F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p))).otherwise("").alias("v")))

    def own(p: Column) -> Column:
        name = F.lower(p["k"])
        tracked = name.isin(*TRACKING)
        for start in TRACKING_PREFIXES:
            tracked = tracked | name.startswith(start)
        return (p["v"] != "") & ~tracked

    plain = F.transform(pairs, lambda p: F.struct(decoded(p["k"]).alias("k"), decoded(p["v"]).alias("v")))
    return F.array_join(F.transform(F.array_sort(F.filter(plain, own)), lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")


def canonicalize_url(url: Column) -> Column:
    """One spelling of a URL: lower-case scheme (https if absent) and host, no standard port, tracking, fragment or final slash."""
    known = F.trim(url)
    scheme = F.coalesce(F.nullif(F.lower(url_part(known, "scheme")), F.lit("")), F.lit("https"))
    host = F.regexp_replace(F.lower(url_part(known, "host")), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(url_part(known, "path"), ";[^/]*$", ""), "/+$", "")
    query = canonical_query(url_part(known, "query"))
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def article_url(url: Column) -> Column:
    """Scheme, host and path only."""
    return F.concat(url_part(url, "scheme"), F.lit("://"), url_part(url, "host"), url_part(url, "path"))


def host_is(url: Column, host: str) -> Column:
    """Whether an http(s) URL's host is ``host`` or below it."""
    own = F.lower(url_part(url, "host"))
    return url_part(url, "scheme").isin("http", "https") & ((own == host) | own.endswith(f".{host}"))


_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
#: Spellings of a day: pattern, and the groups of year, month, day.
_DAYS = (
    (r"^(\d{1,2})[ -]([A-Za-z]{3,9})\.?,?[ -](\d{4})\b", (3, 2, 1)),
    (r"^([A-Za-z]{3,9})\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})\b", (3, 1, 2)),
    (r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?!\d)", (1, 2, 3)),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})\b", (3, 1, 2)),
    (r"^(\d{4})(\d{2})(\d{2})(?!\d)", (1, 2, 3)),
)
_CLOCK = r"(?i)^,?(?:T| (?:at )?)(\d{1,2})(?::(\d{2})(?::(\d{2}))?)?(?:\.\d+)? ?(a\.?m|p\.?m)?(?![\d/-])"
#: Hours of named zones from UTC; others count as UTC.
_ZONES = {"EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "CET": 1, "CEST": 2, "BST": 1}


def parse_date(text: Column) -> Column:
    """Dates as UTC: RFC 2822, ISO, and the usual free forms (``February 11, 2026 8:30 AM EST``); those without a zone are taken as UTC, and null stands for what is no date.

    The parts are found by patterns and put into one ISO text, so a date is
    parsed once however it is spelt.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", " "), r"^(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,? ", "")

    def padded(part: Column, size: int = 2) -> Column:
        return F.lpad(part, size, "0")

    def month(part: Column) -> Column:
        at = F.call_function("instr", F.lit(_MONTHS), F.lower(F.substring(part, 1, 3)))
        return F.when(part.rlike("^\\d"), part).when(at % 3 == 1, ((at + 2) / 3).cast("int").cast("string"))

    days = []
    for pattern, (y, m, d) in _DAYS:
        part = lambda g, p=pattern: F.regexp_extract(bare, p, g)
        days.append(F.when(part(y) != "", F.concat(part(y), F.lit("-"), padded(month(part(m))), F.lit("-"), padded(part(d)))))
    rest = F.regexp_replace(bare, "|".join(p for p, _ in _DAYS), "")
    clock = lambda g: F.regexp_extract(rest, _CLOCK, g)
    half = F.lower(F.substring(clock(4), 1, 1))
    hour = F.when(clock(1) == "", 0).otherwise(clock(1).cast("int"))
    hour = F.when((half == "p") & (hour < 12), hour + 12).when((half == "a") & (hour == 12), 0).otherwise(hour)
    minute = lambda g: padded(F.when(clock(g) == "", "0").otherwise(clock(g)))
    shift = F.regexp_extract(bare, r":\d{2}(?:\.\d+)? ?([+-]\d{2}:?\d{2})(?: ?\([A-Z]+\))?$", 1)
    name = F.regexp_extract(bare, r"\b([A-Z]{3,4})$", 1)
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in _ZONES.items() for x in (k, f"{v:+03d}:00")]), name), F.lit("+00:00"))
    zone = F.when(shift != "", F.concat(F.substring(shift, 1, 3), F.lit(":"), F.substring(shift, -2, 2))).otherwise(named)
    spelt = F.concat(F.coalesce(*days), F.lit("T"), padded(hour.cast("string")), F.lit(":"), minute(2), F.lit(":"), minute(3), zone)
    return spelt.try_cast("timestamp")


def label(text: Column, most: int = 120) -> Column:
    return F.substring(F.trim(text), 1, most)


def primary_language(code: Column) -> Column:
    return F.lower(F.element_at(F.split(F.trim(code), "[-_]"), 1))


def symbol_list(text: Column) -> Column:
    """Comma-separated symbols: upper case, no blanks, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda s: F.upper(F.trim(s))), lambda s: s != ""))


def backoff_seconds(failures: Column, base: float = 30.0, cap: float = 3600.0, hint: Column | None = None) -> Column:
    """min(base * 2^(failures - 1), cap); a server's hint is a floor, capped as well; 0 without base or cap."""
    if base <= 0 or cap <= 0:
        return F.lit(0.0)
    own = F.when(failures <= 0, F.lit(0.0)).otherwise(F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(failures, F.lit(64)) - 1), F.lit(cap)))
    return own if hint is None else F.greatest(own, F.least(F.coalesce(hint.cast("double"), F.lit(0.0)), F.lit(cap)))


def payload(title: Column, link: Column, published: Column, summary: Column, source: Column, language: Column, others: Column) -> Column:
    """The stored form of a feed entry as JSON; null fields are left out."""
    return F.to_json(F.struct(title.alias("title"), link.alias("link"), published.cast("string").alias("published"), summary.alias("summary"), source.alias("source"), language.alias("language"), others.alias("_alt_feed_urls")))
