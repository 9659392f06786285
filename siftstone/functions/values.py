"""Number, engagement, timestamp and error-category expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import SPACE
from .text import casefold, strip

# ---- fixed values -----------------------------------------------------------------------------------------------
ENGAGEMENT_ALIASES = {
    "likes": ("likes", "like_count", "likes_count"),
    "reposts": ("reposts", "repost_count", "reposts_count"),
    "retweets": ("retweets", "retweet_count", "retweets_count"),
    "replies": ("replies", "reply_count", "replies_count"),
    "quotes": ("quotes", "quote_count", "quotes_count"),
    "views": ("views", "view_count", "views_count", "page_views_count"),
    "bookmarks": ("bookmarks", "bookmark_count", "bookmarks_count", "stocks_count"),
}
ENGAGEMENT_WEIGHTS = {"likes": 1.0, "retweets": 2.0, "reposts": 2.0, "quotes": 1.5, "replies": 1.0, "views": 0.2}
ERROR_CATEGORIES = {
    "timeout": ("timeout", "timed_out"),
    "auth_required": ("auth_required", "not_authenticated", "not_authorized", "unauthorized", "forbidden"),
    "rate_limited": ("rate_limited", "rate_limit", "too_many_requests", "http_429"),
    "dependency_missing": ("dependency_missing", "missing_dependency"),
    "invalid_input": (
        "invalid_input",
        "unknown_channel",
        "unsupported_operation",
        "unsupported_option",
        "missing_configuration",
    ),
    "parse_error": ("parse_error", "parse_failed", "invalid_response", "invalid_json"),
    "no_results": ("no_results", "not_found"),
    "upstream_unavailable": (
        "upstream_unavailable",
        "http_error",
        "http_409",
        "dns_error",
        "command_failed",
        "internal_error",
    ),
}
ERROR_TEXT_MARKERS = {
    "timeout": ("timeout", "timed out"),
    "rate_limited": ("rate limit", "too many requests", "http 429", "429"),
    "upstream_unavailable": ("http 409", "409", "conflict"),
    "auth_required": ("auth", "login", "credential"),
}
RETRYABLE_CATEGORIES = ("timeout", "rate_limited", "upstream_unavailable")
THROTTLE_MARKERS = (
    "rate_limited",
    "rate limit",
    "too many requests",
    "http 429",
    "http_429",
    "429",
    "http 409",
    "http_409",
    "409",
    "conflict",
)
# ---- end of fixed values ----------------------------------------------------------------------------------------


def number_or_null(text: Column) -> Column:
    """Number out of text such as ``1,234``; null when it is not one."""
    return F.replace(strip(text), F.lit(","), F.lit("")).try_cast("double")


def normalize_engagement(payload: Column) -> Column:
    """Seven common engagement fields out of an open VARIANT object, with spellings and a ``metrics`` fallback.

    The first present spelling decides for its source, as a non-null value; only when it is not a number does the
    nested ``metrics`` object get asked. Absent fields are left out of the map.
    """

    def present(prefix: str, names: tuple[str, ...]) -> Column:
        # read as text: JSON null is absent, and neither booleans nor objects turn into numbers
        return number_or_null(F.coalesce(*[F.try_variant_get(payload, f"{prefix}.{n}", "string") for n in names]))

    pairs = []
    for field, names in ENGAGEMENT_ALIASES.items():
        pairs += [F.lit(field), F.coalesce(present("$", names), present("$.metrics", names))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def metric(engagement: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(engagement, F.lit(name)), F.lit(0.0))


def engagement_score(engagement: Column) -> Column:
    """Weighted sum of log10(v + 1) over the positive fields."""
    total = F.lit(0.0)
    for field, weight in ENGAGEMENT_WEIGHTS.items():
        value = metric(engagement, field)
        total = total + F.when(value > 0, F.log10(value + 1) * weight).otherwise(0.0)
    return total


_TIMESTAMP_PATTERNS = (
    "dd MMM yyyy HH:mm:ss XX",
    "dd MMM yyyy HH:mm:ss z",
    "d MMM yyyy HH:mm:ss XX",
    "d MMM yyyy HH:mm:ss z",
)


def timestamp_text(value: Column) -> Column:
    """Common timestamp spellings to UTC seconds with ``Z``; unreadable text comes back trimmed.

    The session time zone must be UTC, see :func:`siftstone.session.configure`.
    """
    text = F.nullif(strip(value), F.lit(""))
    no_weekday = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))
    compact = F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
    mail = F.when(
        no_weekday.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} "),
        F.coalesce(*[F.try_to_timestamp(no_weekday, F.lit(p)) for p in _TIMESTAMP_PATTERNS]),
    )
    return F.coalesce(F.date_format(F.coalesce(iso, compact, mail), "yyyy-MM-dd'T'HH:mm:ss'Z'"), text)


def epoch_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def error_category(code: Column, message: Column | None = None, details: Column | None = None) -> Column:
    """Stable category: exact code first, then markers in code, details (a VARIANT's text) and message."""
    empty = F.lit("")
    text = F.lower(strip(F.coalesce(code, empty)))
    hay = F.concat_ws(
        " ",
        text,
        F.lower(F.coalesce(details, empty)) if details is not None else empty,
        F.lower(F.coalesce(message, empty)) if message is not None else empty,
    )
    result = None
    for category, names in ERROR_CATEGORIES.items():
        hit = text.isin(*names)
        result = F.when(hit, F.lit(category)) if result is None else result.when(hit, F.lit(category))
    for category, markers in ERROR_TEXT_MARKERS.items():
        hit = F.lit(False)
        for marker in markers:
            hit = hit | F.contains(hay, F.lit(marker))
        result = result.when(hit, F.lit(category))
    return result.otherwise(F.lit("unknown"))


def error_retryable(category: Column) -> Column:
    return category.isin(*RETRYABLE_CATEGORIES)


def http_status(raw: Column) -> Column:
    """HTTP status mentioned in free text; 409 and 429 also count when they stand alone."""
    named = F.regexp_extract(raw, rf"(?iu)(?:http[{SPACE}_-]*|status[{SPACE}_-]*|error[{SPACE}_-]*)(\d{{3}})", 1)
    alone = F.regexp_extract(raw, r"(?<![\p{L}\p{N}_])(409|429)(?![\p{L}\p{N}_])", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(alone, F.lit(""))).try_cast("int")


def plain_error_code(raw: Column) -> Column:
    text, status = casefold(raw), http_status(raw)
    return (
        F.when(
            F.coalesce(status == 429, F.lit(False))
            | F.contains(text, F.lit("too many requests"))
            | F.contains(text, F.lit("rate limit")),
            F.lit("rate_limited"),
        )
        .when(F.coalesce(status == 409, F.lit(False)) | F.contains(text, F.lit("conflict")), F.lit("http_409"))
        .when(F.contains(text, F.lit("not_authenticated")), F.lit("not_authenticated"))
    )


def structured_error_code(raw: Column) -> Column:
    """``error.code`` of JSON output, else the code read out of plain text."""
    parsed = F.try_parse_json(raw)
    return F.coalesce(F.nullif(F.try_variant_get(parsed, "$.error.code", "string"), F.lit("")), plain_error_code(raw))


def throttle_sensitive(category: Column, *texts: Column) -> Column:
    """Rate-limit or conflict signs in the error; ``texts`` are code, message, details and raw output."""
    hay = casefold(F.concat_ws(" ", F.coalesce(category, F.lit("")), *[F.coalesce(t, F.lit("")) for t in texts]))
    hit = category == "rate_limited"
    for marker in THROTTLE_MARKERS:
        hit = hit | F.contains(hay, F.lit(marker))
    return F.coalesce(hit, F.lit(False))
