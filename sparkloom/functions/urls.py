"""URL predicates and routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Paths, without a closing slash, that name no concrete source.
GENERIC_PATHS = ("/", "/topic", "/search", "/video", "/article", "/read", "/podcast")
#: Markers in a lower-cased query that name a concrete source.
ID_MARKERS = ("id=", "vid=", "aid=", "bvid=", "p=", "article")
#: Fixed values: (substring, page type), first match wins.
PAGE_TYPES = (("/wiki/", "wiki"), ("/docx/", "doc"), ("/docs/", "doc"), ("/sheets/", "sheet"), ("/spreadsheets/", "sheet"), ("/base/", "base"))
#: Fixed values: (path part, token type), first match wins.
TOKEN_TYPES = (("wiki", "wiki"), ("docx", "docx"), ("docs", "doc"), ("sheets", "sheet"), ("base", "base"))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def is_concrete_source(url: Column, generic=GENERIC_PATHS, markers=ID_MARKERS, slug: int = 8) -> Column:
    """An http(s) URL with a host whose path names more than a section of a site.

    Two path segments are enough, or one of ``slug`` characters, or a query that holds an id marker.
    """
    path = F.regexp_replace(path_of(url), "/+$", "")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    by_query = F.lit(False)
    for m in markers:
        by_query = by_query | F.lower(query_of(url)).contains(m)
    concrete = (F.size(segments) >= 2) | (F.length(F.coalesce(F.get(segments, F.lit(0)), F.lit(""))) >= slug) | by_query
    return url.rlike(r"^https?://[^/?#]+") & ~F.when(path == "", F.lit("/")).otherwise(path).isin(*generic) & concrete


def page_type(url: Column) -> Column:
    out = F.lit("unknown")
    for part, kind in reversed(PAGE_TYPES):
        out = F.when(url.contains(part), F.lit(kind)).otherwise(out)
    return out


def doc_token(url: Column) -> tuple[Column, Column]:
    """(token, type) by the first pattern that matches; null without one."""
    token, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for part, name in reversed(TOKEN_TYPES):
        pattern = f"/{part}/([A-Za-z0-9]+)"
        token = F.when(url.rlike(pattern), F.regexp_extract(url, pattern, 1)).otherwise(token)
        kind = F.when(url.rlike(pattern), F.lit(name)).otherwise(kind)
    return token, kind
