"""URL, handle and post-id expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import strip

# fixed values: host spellings of one network that collapse to a single host
HOST_ALIASES = ("twitter.com", "www.twitter.com", "mobile.twitter.com", "www.x.com")
HOST_CANONICAL = "x.com"

# RFC 3986 appendix B, with the scheme restricted to its legal characters
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(?s:.*))?$"


def _part(url: Column, index: int) -> Column:
    return F.regexp_extract(url, _PARTS, index)


def _collapse_host(host: Column) -> Column:
    return F.when(host.isin(*HOST_ALIASES), F.lit(HOST_CANONICAL)).otherwise(host)


def url_domain(url: Column) -> Column:
    """Lower-cased network location with known aliases collapsed; null when the URL has none."""
    return F.nullif(_collapse_host(F.lower(_part(url, 2))), F.lit(""))


def url_path(url: Column) -> Column:
    return _part(url, 3)


def canonical_url(url: Column, *, collapse_hosts: bool = True, keep_relative: bool = True) -> Column:
    """Stable URL form for grouping: scheme and host lower-cased, fragment and trailing slashes dropped.

    With ``keep_relative`` a value without scheme or host comes back trimmed but otherwise unchanged.
    """
    text = F.nullif(strip(url), F.lit(""))
    scheme, host, path, query = F.lower(_part(text, 1)), F.lower(_part(text, 2)), _part(text, 3), _part(text, 4)
    if collapse_hosts:
        host = _collapse_host(host)
    path = F.when(path == "/", path).otherwise(F.rtrim(path, F.lit("/")))
    built = F.concat(
        F.when(F.length(scheme) > 0, F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        F.when(F.length(host) > 0, F.concat(F.lit("//"), host)).otherwise(F.lit("")),
        F.when((F.length(host) > 0) & (F.length(path) > 0) & ~F.startswith(path, F.lit("/")), F.concat(F.lit("/"), path))
        .otherwise(path),
        F.when(F.length(query) > 0, F.concat(F.lit("?"), query)).otherwise(F.lit("")),
    )
    if keep_relative:
        built = F.when((F.length(scheme) == 0) | (F.length(host) == 0), text).otherwise(built)
    return built


def _on_network(text: Column) -> Column:
    return F.contains(text, F.lit("twitter.com")) | F.contains(text, F.lit(HOST_CANONICAL))


def screen_name(value: Column) -> Column:
    """Account handle out of ``@name``, a profile URL, or a bare name."""
    text = strip(value)
    first = F.regexp_extract(url_path(text), r"^/*([^/]+)", 1)
    return (
        F.when(F.startswith(text, F.lit("@")), F.substr(text, F.lit(2)))
        .when(_on_network(text) & (F.length(first) > 0), first)
        .otherwise(text)
    )


def post_id(value: Column) -> Column:
    """Post id out of a status URL, or the value itself."""
    text = strip(value)
    found = F.regexp_extract(url_path(text), r"(?:^|/)status/+([^/]+)", 1)
    return F.when(_on_network(text) & (F.length(found) > 0), found).otherwise(text)


def post_url(post: Column, handle: Column) -> Column:
    return F.when(
        F.length(post) > 0,
        F.concat(
            F.lit("https://x.com/"), F.coalesce(F.nullif(handle, F.lit("")), F.lit("i")), F.lit("/status/"), post
        ),
    )


def hashtag(value: Column) -> Column:
    """``#tag`` for a bare or prefixed tag; null when empty or holding whitespace."""
    text = strip(F.regexp_replace(strip(value), "^#", ""))
    return F.when((F.length(text) > 0) & ~text.rlike(f"[{P.SPACE}]"), F.concat(F.lit("#"), text))


def hashtags_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(P.HASHTAG_RE), F.lit(0)))


def looks_like_image(url: Column) -> Column:
    text = strip(url)
    path = F.lower(url_path(text))
    hit = F.lit(False)
    for extension in P.IMAGE_EXTENSIONS:
        hit = hit | F.endswith(path, F.lit(extension))
    return F.coalesce(F.rlike(text, F.lit("^https?://")) & hit, F.lit(False))


def image_urls(text: Column) -> Column:
    """Markdown images first, then ``<img src>``, first occurrence kept."""
    found = F.concat(
        F.regexp_extract_all(text, F.lit(P.MARKDOWN_IMAGE_RE), F.lit(1)),
        F.regexp_extract_all(text, F.lit(P.HTML_IMAGE_RE), F.lit(1)),
    )
    return F.array_distinct(found)


def url_list(entries: Column) -> Column:
    """URL strings out of a VARIANT array that mixes plain strings and link objects."""

    def pick(entry: Column) -> Column:
        named = [
            F.nullif(F.try_variant_get(entry, f"$.{key}", "string"), F.lit(""))
            for key in ("expandedUrl", "url", "expanded_url", "displayUrl")
        ]
        is_object = F.startswith(F.schema_of_variant(entry), F.lit("OBJECT"))
        return F.when(is_object, F.coalesce(*named)).otherwise(
            F.nullif(strip(F.try_variant_get(entry, "$", "string")), F.lit(""))
        )

    return F.array_compact(F.transform(F.try_variant_get(entries, "$", "array<variant>"), pick))
