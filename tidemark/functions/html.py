"""Page metrics from stored html, by pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and fallbacks.
TITLE = r"(?is)<title>(.*?)</title>"
DESCRIPTION = r"""(?i)<meta[^>]*name=['"]description['"][^>]*content=['"](.*?)['"]"""
HEADING = r"(?is)<h1[^>]*>(.*?)</h1>"
LINK = r"""(?i)href=['"]?([^'" >]+)"""
NO_TITLE, NO_DESCRIPTION, NO_HEADING, NO_ENTITY = "Unknown Domain", "No meta description defined.", "No primary heading", "web-target"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _first(html: Column, pattern: str, fallback: str, clean=lambda c: c) -> Column:
    return F.when(F.regexp_instr(html, F.lit(pattern)) > 0, _strip(clean(F.regexp_extract(html, pattern, 1)))).otherwise(fallback)


def title(html: Column) -> Column:
    return _first(html, TITLE, NO_TITLE)


def description(html: Column) -> Column:
    return _first(html, DESCRIPTION, NO_DESCRIPTION)


def heading(html: Column) -> Column:
    return _first(html, HEADING, NO_HEADING, lambda c: F.regexp_replace(c, "<[^>]+>", ""))


def all_links(html: Column) -> Column:
    """Every link target, in order."""
    return F.regexp_extract_all(html, F.lit(LINK), F.lit(1))


def links(html: Column, most: int = 5) -> Column:
    """The first links that are absolute or rooted: a sample to show."""
    return F.slice(F.filter(all_links(html), lambda x: x.startswith("http") | x.startswith("/")), 1, most)


def count_tag(html: Column, tag: str) -> Column:
    return F.regexp_count(html, F.lit(rf"(?i)<{tag}"))


def size_kb(html: Column) -> Column:
    """Kilobytes of UTF-8 to two decimals, ties to even."""
    return F.bround(F.octet_length(html) / 1024, 2)


def entity(url: Column) -> Column:
    """Host and port of the address; an address without a scheme is read as http."""
    full = F.when(url.rlike(r"(?i)^https?://"), url).otherwise(F.concat(F.lit("http://"), url))
    return F.coalesce(F.nullif(F.regexp_extract(full, r"(?i)^https?://([^/?#]*)", 1), F.lit("")), F.lit(NO_ENTITY))


def scheme(url: Column) -> Column:
    return F.upper(F.coalesce(F.nullif(F.regexp_extract(url, r"(?i)^(https?)://", 1), F.lit("")), F.lit("http")))
