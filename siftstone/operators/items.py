"""The item row: column defaults, raw post normalisation, item build, retention, media references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions import values as V

MEDIA_TYPE = (
    "struct<type:string,url:string,relation:string,thumb_url:string,alt:string,width:int,height:int,"
    "duration_seconds:int,source_field:string,media_type:string>"
)
# item columns every operator may use; a table that lacks one gets a typed null
ITEM_COLUMNS = {
    "id": "string",
    "kind": "string",
    "title": "string",
    "url": "string",
    "canonical_url": "string",
    "source_item_id": "string",
    "text": "string",
    "author": "string",
    "published_at": "string",
    "source": "string",
    "engagement": "map<string,double>",
    "media_references": f"array<{MEDIA_TYPE}>",
    "identifiers": "map<string,string>",
    "timeline_item_kind": "string",
    "author_name": "string",
    "quoted_author_handle": "string",
    "quoted_author_name": "string",
    "urls": "array<string>",
    "item_query_tokens": "array<string>",
    "coverage_topics": "array<struct<topic_id:string,label:string>>",
}
SIGHTING_COLUMNS = {
    "run_id": "string",
    "channel": "string",
    "operation": "string",
    "input": "string",
    "intent": "string",
    "query_id": "string",
    "source_role": "string",
    "query_tokens": "array<string>",
}


def with_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Add typed nulls for the item columns a table does not have."""
    missing = {n: F.lit(None).cast(t) for n, t in wanted.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


def timeline_kind(is_retweet: Column, reply_to: Column, quoted_id: Column) -> Column:
    return (
        F.when(F.coalesce(is_retweet, F.lit(False)), F.lit("retweet"))
        .when(F.length(reply_to) > 0, F.lit("reply"))
        .when(quoted_id.isNotNull(), F.lit("quote"))
        .otherwise(F.lit("original"))
    )


def preference_rank(kind: Column) -> Column:
    """0 original, 1 quote, 2 reply, 3 retweet, 4 anything else."""
    k = F.lower(T.strip(kind))
    return (
        F.when(k == "original", 0).when(k == "quote", 1).when(k == "reply", 2).when(k == "retweet", 3).otherwise(4)
    )


#: fixed values of HTML: references that occur in URLs, the ampersand last
URL_ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&amp;", "&"))


def media_references(entries: Column) -> Column:
    """Typed media references out of a VARIANT array; entries without an http(s) URL are skipped, first copy kept."""

    def text_at(entry: Column, *names: str) -> Column:
        return F.coalesce(*[F.nullif(F.try_variant_get(entry, f"$.{n}", "string"), F.lit("")) for n in names])

    def clean(col: Column) -> Column:
        value = T.strip(col)
        for entity, char in URL_ENTITIES:
            value = F.replace(value, F.lit(entity), F.lit(char))
        return F.when(value.rlike("^https?://"), value)

    def build(entry: Column) -> Column:
        raw = F.try_variant_get(entry, "$.type", "string")
        return F.struct(
            F.when(raw.isin("video", "animated_gif", "gif"), F.lit("video")).otherwise(F.lit("image")).alias("type"),
            clean(text_at(entry, "url", "mediaUrl", "media_url")).alias("url"),
            F.lit("post_media").alias("relation"),
            clean(text_at(entry, "thumbnail", "thumbUrl", "previewImageUrl")).alias("thumb_url"),
            F.nullif(T.strip(F.try_variant_get(entry, "$.alt", "string")), F.lit("")).alias("alt"),
            *[
                F.when(
                    F.schema_of_variant(F.try_variant_get(entry, f"$.{name}", "variant")) != "BOOLEAN",
                    V.number_or_null(F.try_variant_get(entry, f"$.{name}", "string")).cast("int"),
                ).alias(alias)
                for name, alias in (("width", "width"), ("height", "height"), ("durationSeconds", "duration_seconds"))
            ],
            F.lit("media[]").alias("source_field"),
            F.nullif(T.strip(raw), F.lit("")).alias("media_type"),
        )

    built = F.transform(F.try_variant_get(entries, "$", "array<variant>"), build)
    return dedupe_media(F.filter(built, lambda m: m["url"].isNotNull()))


def dedupe_media(references: Column) -> Column:
    """Keep the first reference of each (type, relation, url, thumb_url, source_field, media_type)."""

    def key(m: Column) -> Column:
        names = ("type", "relation", "url", "thumb_url", "source_field", "media_type")
        return F.struct(*[m[n].alias(n) for n in names])

    keys = F.transform(references, key)
    return F.filter(references, lambda m, i: F.array_position(keys, key(m)) == i + 1)


def unescape_media(df: DataFrame, id_col: str = "id") -> DataFrame:
    """One row per media reference with entities in its URLs resolved (only rows with '&' visit Python)."""
    rows = df.select(id_col, F.posexplode("media_references").alias("position", "m")).select(id_col, "position", "m.*")
    return rows.withColumns({"url": T.html_unescape(F.col("url")), "thumb_url": T.html_unescape(F.col("thumb_url"))})


def normalize_posts(raw: DataFrame, payload: str = "payload", source: str = "posts") -> DataFrame:
    """Backend post objects (a VARIANT column) to item rows. Columns other than the payload are kept."""
    p = F.col(payload)

    def get(path: str, dtype: str = "string") -> Column:
        return F.try_variant_get(p, f"$.{path}", dtype)

    text_id = F.nullif(get("id"), F.lit(""))
    handle = get("author.screenName")
    quoted = get("quotedTweet.id")
    created = F.coalesce(F.nullif(get("createdAtISO"), F.lit("")), get("createdAt"))
    kind = timeline_kind(get("isRetweet", "boolean"), get("inReplyToStatusId"), quoted)
    has_metrics = F.try_variant_get(p, "$.metrics", "variant")
    out = raw.select(
        *[c for c in raw.columns if c != payload],
        text_id.alias("id"),
        F.lit("post").alias("kind"),
        T.derive_title(get("text"), F.concat(F.lit("Tweet "), text_id)).alias("title"),
        U.post_url(text_id, handle).alias("url"),
        get("text").alias("text"),
        handle.alias("author"),
        V.timestamp_text(created).alias("published_at"),
        F.lit(source).alias("source"),
        V.normalize_engagement(has_metrics).alias("engagement"),
        media_references(F.try_variant_get(p, "$.media", "variant")).alias("media_references"),
        kind.alias("timeline_item_kind"),
        F.nullif(get("author.name"), F.lit("")).alias("author_name"),
        F.nullif(get("quotedTweet.author.screenName"), F.lit("")).alias("quoted_author_handle"),
        F.nullif(get("quotedTweet.author.name"), F.lit("")).alias("quoted_author_name"),
        F.nullif(get("lang"), F.lit("")).alias("lang"),
        U.url_list(F.try_variant_get(p, "$.urls", "variant")).alias("urls"),
        F.nullif(get("conversationId"), F.lit("")).alias("conversation_id"),
    )
    return build_items(out)


def build_items(df: DataFrame) -> DataFrame:
    """Fill the derived item columns: canonical_url, source_item_id, media list and identifiers."""
    df = with_columns(df, ITEM_COLUMNS)
    extra = {
        "author_handle": F.col("author"),
        "post_id": F.col("id"),
        "conversation_id": F.col("conversation_id") if "conversation_id" in df.columns else F.lit(None).cast("string"),
    }
    defaults = F.create_map(
        F.lit("domain"),
        U.url_domain(F.col("url")),
        *[part for name, value in extra.items() for part in (F.lit(name), value)],
    )
    given = F.coalesce(F.col("identifiers"), F.create_map().cast("map<string,string>"))
    given = F.map_filter(given, lambda _, v: F.length(v) > 0)
    missing = F.map_filter(defaults, lambda k, v: (F.length(v) > 0) & ~F.map_contains_key(given, k))
    return df.withColumns(
        {
            "canonical_url": F.coalesce(F.col("canonical_url"), U.canonical_url(F.col("url"))),
            "source_item_id": F.coalesce(F.col("source_item_id"), F.col("id")),
            "media_references": F.coalesce(F.col("media_references"), F.array().cast(f"array<{MEDIA_TYPE}>")),
            "engagement": F.coalesce(F.col("engagement"), F.create_map().cast("map<string,double>")),
            "identifiers": F.map_concat(given, missing),
        }
    )


def identifier(name: str) -> Column:
    return F.try_element_at(F.col("identifiers"), F.lit(name))


# ---- retention ---------------------------------------------------------------------------------------------------

DEFAULT_SNIPPET_CHARS = 500
BROAD_SNIPPET_CHARS = 280
BROAD_OPERATIONS = ("search", "hashtag", "user_posts")


def retain_text(text: Column, mode: str = "full", max_chars: int | None = None) -> Column:
    """``full`` keeps, ``snippet`` shortens, ``none`` drops the text. The shortening is the feature itself."""
    if mode not in ("full", "snippet", "none"):
        raise ValueError("item text mode must be one of: full, snippet, none")
    if mode == "full":
        return text
    return F.left(text, F.lit(max_chars or DEFAULT_SNIPPET_CHARS)) if mode == "snippet" else F.lit(None).cast("string")


def _variant_text(raw: Column) -> Column:
    """Strings as they are, everything else as compact JSON."""
    return F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(raw, "$", "string")).otherwise(F.to_json(raw))


def raw_type(raw: Column) -> Column:
    kind = F.schema_of_variant(raw)
    return (
        F.when(F.is_variant_null(raw) | raw.isNull(), F.lit("NoneType"))
        .when(F.startswith(kind, F.lit("OBJECT")), F.lit("dict"))
        .when(F.startswith(kind, F.lit("ARRAY")), F.lit("list"))
        .when(kind == "STRING", F.lit("str"))
        .when(kind == "BOOLEAN", F.lit("bool"))
        .when(kind == "BIGINT", F.lit("int"))
        .otherwise(F.lit("float"))
    )


def raw_bytes(raw: Column) -> Column:
    """UTF-8 size of the payload's compact JSON (of the text itself for strings, 0 for null)."""
    return F.when(raw.isNull() | F.is_variant_null(raw), F.lit(0)).otherwise(F.octet_length(_variant_text(raw)))


def retain_raw(df: DataFrame, raw: str = "raw", mode: str = "full", max_bytes: int | None = None) -> DataFrame:
    """Apply a raw retention mode to a VARIANT column.

    Adds ``raw_mode``, ``raw_payload_bytes`` and ``raw_summary`` (a struct, null unless minimised or truncated) and sets the
    raw column to null wherever the payload is not kept.
    """
    if mode not in ("full", "minimal", "none"):
        raise ValueError("raw mode must be one of: full, minimal, none")
    col, size = F.col(raw), raw_bytes(F.col(raw))
    kind = raw_type(col)
    keys = F.slice(F.sort_array(F.json_object_keys(F.when(kind == "dict", F.to_json(col)))), 1, 50)
    body = _variant_text(col)
    nothing = F.lit(None).cast(
        "struct<raw_mode:string,type:string,approx_bytes:int,keys:array<string>,length:int,preview:string>"
    )
    if mode == "minimal":
        summary = F.when(
            kind != "NoneType",
            F.struct(
                F.lit("minimal").alias("raw_mode"),
                kind.alias("type"),
                size.alias("approx_bytes"),
                keys.alias("keys"),
                F.when(kind == "list", F.size(F.try_variant_get(col, "$", "array<variant>"))).alias("length"),
                F.when(kind == "str", F.left(body, F.lit(500))).alias("preview"),
            ),
        )
        kept = F.lit(None).cast("variant")
    elif mode == "full" and max_bytes is not None:
        too_big = size > max_bytes
        summary = F.when(
            too_big,
            F.struct(
                F.lit("truncated").alias("raw_mode"),
                kind.alias("type"),
                size.alias("approx_bytes"),
                F.lit(None).cast("array<string>").alias("keys"),
                F.lit(None).cast("int").alias("length"),
                F.left(body, F.lit(max_bytes)).alias("preview"),
            ),
        )
        kept = F.when(~too_big, col)
    else:
        summary = nothing
        kept = col if mode == "full" else F.lit(None).cast("variant")
    return df.withColumns({"raw_mode": F.lit(mode), "raw_payload_bytes": size, "raw_summary": summary, raw: kept})
