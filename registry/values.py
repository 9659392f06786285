"""Value-level queries: URLs, handles, titles, numbers, timestamps, error codes, tokens, item build."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftstone.functions import patterns as P
from siftstone.functions import text as T
from siftstone.functions import urls as U
from siftstone.functions import values as V
from siftstone.operators import items as I

from .base import POSTS_SQL, canonical_sql, fold, query

_VARIANTS = "CASE page_id % 4 WHEN 0 THEN upper(url) WHEN 1 THEN concat(url, '/#frag') WHEN 2 THEN concat('https://www.twitter.com/p/', CAST(page_id AS {0}), '/') ELSE url END"


@query(
    "canonical_urls",
    f"""WITH v AS (SELECT page_id, {_VARIANTS.format('VARCHAR')} AS u FROM pages)
SELECT page_id, {canonical_sql('u')} AS canonical, {canonical_sql('u', False)} AS canonical_plain,
 CASE WHEN lower(regexp_extract(u, '://([^/?#]*)', 1)) = 'www.twitter.com' THEN 'x.com'
   ELSE lower(regexp_extract(u, '://([^/?#]*)', 1)) END AS domain,
 regexp_matches(lower(regexp_extract(u, '://[^/?#]*([^?#]*)', 1)), '(png|jpg|jpeg|gif|webp|bmp|svg|avif)$') AS image
FROM v""",
)
def canonical_urls(t):
    u = F.expr(_VARIANTS.format("STRING"))
    v = t.pages.select("page_id", u.alias("u"))
    return v.select(
        "page_id",
        U.canonical_url(F.col("u")).alias("canonical"),
        U.canonical_url(F.col("u"), collapse_hosts=False, keep_relative=False).alias("canonical_plain"),
        U.url_domain(F.col("u")).alias("domain"),
        U.looks_like_image(F.col("u")).alias("image"),
    )


@query(
    "post_references",
    """SELECT doc_id, concat('acct_', source) AS handle, CAST(doc_id AS VARCHAR) AS post,
 concat('https://x.com/acct_', source, '/status/', CAST(doc_id AS VARCHAR)) AS url,
 concat('#', source) AS tag FROM documents""",
)
def post_references(t):
    link = F.concat(F.lit("https://x.com/acct_"), F.col("source"), F.lit("/status/"), F.col("doc_id"), F.lit("?s=20"))
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("@acct_"), F.col("source"))).otherwise(link)
    d = t.documents.select("doc_id", "source", link.alias("link"), name.alias("name"))
    post, handle = U.post_id(F.col("link")), U.screen_name(F.col("name"))
    return d.select(
        "doc_id", handle.alias("handle"), post.alias("post"), U.post_url(post, handle).alias("url"), U.hashtag(F.col("source")).alias("tag")
    )


@query(
    "extract_images",
    """WITH x AS (SELECT page_id, concat(html, ' ![pic](', url, '.png) <IMG class="a" src="', url, '.jpg"> ![again](', url, '.png)') AS h FROM pages),
m AS (SELECT page_id, list_concat(regexp_extract_all(h, '!\\[[^\\]]*\\]\\((https?://[^)\\s]+)\\)', 1),
  regexp_extract_all(h, '(?i)<img\\b[^>]*?\\bsrc=["''](https?://[^"'']+)["'']', 1)) AS l FROM x)
SELECT page_id, array_to_string(list_sort(list_distinct(l)), ' ') AS images, CAST(len(list_distinct(l)) AS BIGINT) AS n FROM m""",
)
def extract_images(t):
    html = F.concat(
        "html", F.lit(" ![pic]("), "url", F.lit('.png) <IMG class="a" src="'), "url", F.lit('.jpg"> ![again]('), "url", F.lit(".png)")
    )
    found = t.pages.select("page_id", U.image_urls(html).alias("l"))
    return found.select("page_id", F.array_join(F.sort_array("l"), " ").alias("images"), F.size("l").cast("bigint").alias("n"))


@query(
    "link_lists",
    "SELECT page_id, concat('e:', url, ' ', url, ' d:', url) AS links FROM pages",
)
def link_lists(t):
    row = F.to_json(
        F.array(
            F.to_variant_object(F.struct(F.concat(F.lit("e:"), "url").alias("expandedUrl"), F.col("url").alias("url"))),
            F.to_variant_object(F.struct(F.lit("").alias("url"), F.lit(None).cast("string").alias("expanded_url"))),
            F.to_variant_object(F.struct(F.col("url").alias("expanded_url"))),
            F.to_variant_object(F.struct(F.concat(F.lit("d:"), "url").alias("displayUrl"))),
        )
    )
    return t.pages.select("page_id", F.array_join(U.url_list(F.parse_json(row)), " ").alias("links"))


@query(
    "timestamps",
    """SELECT event_id, CASE event_id % 6 WHEN 3 THEN strftime(ts, '%Y-%m-%dT00:00:00Z') WHEN 5 THEN concat('at ', CAST(event_id AS VARCHAR))
 ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS published_at FROM events""",
)
def timestamps(t):
    fmt = lambda p: F.date_format("ts", p)
    kind = F.col("event_id") % 6
    spelled = (
        F.when(kind == 0, fmt("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(kind == 1, fmt("yyyy-MM-dd HH:mm:ss"))
        .when(kind == 2, fmt("E, dd MMM yyyy HH:mm:ss 'GMT'"))
        .when(kind == 3, fmt("yyyyMMdd"))
        .when(kind == 4, F.concat(fmt("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))
        .otherwise(F.concat(F.lit(" at "), F.col("event_id").cast("string"), F.lit(" ")))
    )
    return t.events.select("event_id", V.timestamp_text(spelled).alias("published_at"))


@query(
    "titles",
    f"""WITH {POSTS_SQL}, k AS (SELECT ord, title, trim(regexp_replace({fold('title')}, '\\s+', ' ', 'g')) AS n FROM posts)
SELECT ord, title, CASE WHEN length(n) < 24 AND len(string_split(n, ' ')) < 4 THEN NULL ELSE n END AS title_key,
 left(regexp_replace(regexp_replace(lower(title), '[^a-z0-9._-]+', '-', 'g'), '^[._-]+|[._-]+$', '', 'g'), 80) AS slug FROM k""",
)
def titles(t):
    d = t.marked().select(F.col("doc_id").alias("ord"), T.derive_title(F.col("text")).alias("title"))
    return d.select("ord", "title", T.title_key(F.col("title")).alias("title_key"), T.slugify(F.col("title")).alias("slug"))


@query(
    "engagement_values",
    """SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE floor(value * 100) END AS likes,
 CASE WHEN event_id % 4 = 2 THEN floor(value) END AS retweets, 1234.0 + event_id AS views FROM events""",
)
def engagement_values(t):
    n = F.floor(F.col("value") * 100).cast("string")
    views = F.format_number(F.col("event_id") + 1234, 0)
    kind = F.col("event_id") % 4
    body = (
        F.when(kind == 0, F.concat(F.lit('"likes":'), n))
        .when(kind == 1, F.concat(F.lit('"like_count":" '), n, F.lit('"')))
        .when(kind == 2, F.concat(F.lit('"metrics":{"likes_count":'), n, F.lit(',"retweet_count":'), F.floor("value").cast("string"), F.lit("}")))
        .otherwise(F.lit('"likes":true'))
    )
    js = F.concat(F.lit("{"), body, F.lit(',"page_views_count":"'), views, F.lit('"}'))
    e = t.events.select("event_id", V.normalize_engagement(F.parse_json(js)).alias("m"))
    return e.select("event_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("likes", "retweets", "views")])


_ERR = """CASE event_id % 9 WHEN 0 THEN 'http_429' WHEN 1 THEN 'HTTP 409 while fetching' WHEN 2 THEN 'request timed out'
 WHEN 3 THEN '{"error":{"code":"not_found","message":"none"}}' WHEN 4 THEN 'please login first' WHEN 5 THEN 'status: 503'
 WHEN 6 THEN 'Rate Limit reached' WHEN 7 THEN 'not_authenticated' ELSE concat('code ', event_type) END"""


@query(
    "error_categories",
    f"""WITH r AS (SELECT event_id, {_ERR} AS raw FROM events),
c AS (SELECT event_id, raw, CASE event_id % 9 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'http_409' WHEN 3 THEN 'not_found'
   WHEN 6 THEN 'rate_limited' WHEN 7 THEN 'not_authenticated' END AS code FROM r),
k AS (SELECT *, CASE event_id % 9 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'upstream_unavailable' WHEN 2 THEN 'timeout'
   WHEN 3 THEN 'no_results' WHEN 4 THEN 'auth_required' WHEN 5 THEN 'unknown' WHEN 6 THEN 'rate_limited'
   WHEN 7 THEN 'auth_required' ELSE 'unknown' END AS category FROM c)
SELECT coalesce(code, '-') AS code, category, category IN ('timeout','rate_limited','upstream_unavailable') AS retryable,
 (event_id % 9) IN (0, 1, 6) AS throttle, count(*) AS n FROM k GROUP BY ALL""",
)
def error_categories(t):
    r = t.events.select(F.expr(_ERR).alias("raw"))
    r = r.withColumn("code", V.structured_error_code(F.col("raw")))
    r = r.withColumn("category", V.error_category(F.col("code"), F.col("raw")))
    return (
        r.select(
            F.coalesce("code", F.lit("-")).alias("code"),
            "category",
            V.error_retryable(F.col("category")).alias("retryable"),
            V.throttle_sensitive(F.col("category"), F.col("code"), F.col("raw")).alias("throttle"),
        )
        .groupBy("code", "category", "retryable", "throttle")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "query_tokens",
    f"""WITH {POSTS_SQL}, w AS (SELECT unnest(string_split_regex(concat('lang:en "', title, '" #', author, ' from:x a'), '\\s+')) AS w FROM posts),
n AS (SELECT {fold('''regexp_replace(trim(w, '"''()[]{}<>.,!?;:'), '^#+', '')''')} AS token FROM w
 WHERE NOT regexp_matches(lower(w), '^(from|to|lang|type|since|until|has|exclude|min_likes|min-likes|min_retweets|min-retweets|min_views|min-views):')),
d AS (SELECT token FROM n WHERE length(token) > 1 OR (length(token) = 1 AND NOT regexp_matches(token, '^[\\x00-\\x7F]$')))
SELECT token, count(*) AS n FROM d GROUP BY token""",
)
def query_tokens(t):
    d = t.marked().select(T.derive_title(F.col("text")).alias("title"), "author")
    q = F.concat(F.lit('lang:en "'), "title", F.lit('" #'), "author", F.lit(" from:x a"))
    # tokens are distinct per query; count every occurrence here to compare whole distributions
    words = d.select(F.explode(F.split(q, f"[{P.SPACE}]+")).alias("w"))
    return words.select(F.explode(T.query_tokens(F.col("w"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "folded_text",
    f"""WITH f AS (SELECT doc_id, trim(regexp_replace({fold('text')}, '\\s+', ' ', 'g')) AS n FROM documents)
SELECT doc_id, CAST(length(n) AS BIGINT) AS length, md5(n) AS digest FROM f""",
)
def folded_text(t):
    d = t.documents.select("doc_id", T.norm_text(F.col("text")).alias("n"))
    return d.select("doc_id", F.length("n").cast("bigint").alias("length"), F.md5(F.col("n").cast("binary")).alias("digest"))


@query(
    "normalized_posts",
    """SELECT e.event_id, CAST(e.event_id AS VARCHAR) AS id, concat('https://x.com/u', CAST(e.user_id AS VARCHAR), '/status/', CAST(e.event_id AS VARCHAR)) AS url,
 concat('https://x.com/u', CAST(e.user_id AS VARCHAR), '/status/', CAST(e.event_id AS VARCHAR)) AS canonical_url,
 concat('u', CAST(e.user_id AS VARCHAR)) AS author, strftime(e.ts, '%Y-%m-%dT%H:%M:%SZ') AS published_at,
 CASE WHEN e.event_type = 'signup' THEN 'retweet' WHEN e.event_type = 'purchase' THEN 'reply' WHEN e.event_type = 'click' THEN 'quote' ELSE 'original' END AS kind,
 floor(e.value * 10) AS likes, 'x.com' AS domain, concat('c', CAST(e.event_id % 10 AS VARCHAR)) AS conversation_id,
 CASE WHEN e.event_id % 2 = 0 THEN 'video:https://cdn.example/v.mp4,image:https://cdn.example/i.png' ELSE '' END AS media
FROM events e""",
)
def normalized_posts(t):
    e = t.events
    number = F.col("event_id").cast("string")
    media = '[{"type":"animated_gif","url":"https://cdn.example/v.mp4","width":10},{"type":"photo","mediaUrl":" https://cdn.example/i.png"},{"type":"photo","media_url":"https://cdn.example/i.png"},{"type":"photo","url":"ftp://x"}]'
    null = F.lit(None).cast("string")
    payload = F.to_json(
        F.struct(
            number.alias("id"),
            F.concat(F.lit("post "), number).alias("text"),
            F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("screenName")).alias("author"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAtISO"),
            (F.col("event_type") == "signup").alias("isRetweet"),
            F.when(F.col("event_type") == "purchase", number).otherwise(null).alias("inReplyToStatusId"),
            F.when(F.col("event_type") == "click", F.struct(number.alias("id"))).alias("quotedTweet"),
            F.struct(F.floor(F.col("value") * 10).alias("likes")).alias("metrics"),
            F.concat(F.lit("c"), (F.col("event_id") % 10).cast("string")).alias("conversationId"),
            F.when(F.col("event_id") % 2 == 0, F.parse_json(F.lit(media))).alias("media"),
        )
    )
    items = I.normalize_posts(e.select("event_id", F.parse_json(payload).alias("payload")))
    return items.select(
        "event_id",
        "id",
        "url",
        "canonical_url",
        "author",
        "published_at",
        F.col("timeline_item_kind").alias("kind"),
        F.try_element_at("engagement", F.lit("likes")).alias("likes"),
        I.identifier("domain").alias("domain"),
        I.identifier("conversation_id").alias("conversation_id"),
        F.array_join(F.transform("media_references", lambda m: F.concat(m["type"], F.lit(":"), m["url"])), ",").alias("media"),
    )


@query(
    "text_retention",
    """SELECT doc_id, left(text, 500) AS snippet, left(text, 280) AS broad_snippet, CAST(NULL AS VARCHAR) AS nothing,
 CAST(length(text) AS BIGINT) AS full_length FROM documents""",
)
def text_retention(t):
    text = F.col("text")
    return t.documents.select(
        "doc_id",
        I.retain_text(text, "snippet").alias("snippet"),
        I.retain_text(text, "snippet", I.BROAD_SNIPPET_CHARS).alias("broad_snippet"),
        I.retain_text(text, "none").alias("nothing"),
        F.length(I.retain_text(text)).cast("bigint").alias("full_length"),
    )


@query(
    "raw_retention",
    """SELECT event_id, CAST(strlen(replace(props, ' ', '')) AS BIGINT) AS bytes, 'dict' AS kind, 'k' AS keys,
 CASE WHEN strlen(replace(props, ' ', '')) > 7 THEN left(replace(props, ' ', ''), 7) END AS preview FROM events""",
)
def raw_retention(t):
    e = t.events.select("event_id", F.parse_json("props").alias("raw"))
    small = I.retain_raw(e, mode="minimal").select(
        "event_id",
        F.col("raw_payload_bytes").cast("bigint").alias("bytes"),
        F.col("raw_summary.type").alias("kind"),
        F.array_join("raw_summary.keys", ",").alias("keys"),
    )
    cut = I.retain_raw(e, mode="full", max_bytes=7).select("event_id", F.col("raw_summary.preview").alias("preview"))
    return small.join(cut, "event_id")
