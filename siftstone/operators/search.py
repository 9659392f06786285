"""Post lookups over tables: search with structured or inline filters, hashtags, timelines, profiles, threads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.patterns import SPACE
from ..functions.values import metric
from ..plans.skew import durable, fetch_rows, top_per_group
from . import noise
from . import topic_fit as tf
from .terms import match_groups

_KEYS = {
    "from": "from_user",
    "to": "to_user",
    "lang": "lang",
    "since": "since",
    "until": "until",
    "type": "search_type",
    "min_likes": "min_likes",
    "min-likes": "min_likes",
    "min_retweets": "min_retweets",
    "min-retweets": "min_retweets",
}
_LISTS = {"has": "has", "exclude": "exclude"}
_FIELDS = list(dict.fromkeys(_KEYS.values()))


def parse_inline(queries: DataFrame, query: str = "query") -> DataFrame:
    """Split inline ``key:value`` tokens of a query column into predicate columns and the remaining ``words``.

    A column of the same name that the frame already has is an explicit option and wins over the token.
    """
    words = F.filter(F.split(F.col(query), f"[{SPACE}]+"), lambda w: F.length(w) > 0)
    key = lambda w: F.lower(F.split_part(w, F.lit(":"), F.lit(1)))
    value = lambda w: F.substr(w, F.instr(w, ":") + 1)
    known = lambda w: F.contains(w, F.lit(":")) & (F.length(value(w)) > 0) & key(w).isin(*_KEYS, *_LISTS)
    staged = queries.withColumn("__words", words)

    def last_value(field: str) -> Column:
        names = [k for k, f in _KEYS.items() if f == field]
        found = F.filter("__words", lambda w: known(w) & key(w).isin(*names))
        return F.when(F.size(found) > 0, value(F.element_at(found, -1)))

    def all_values(name: str) -> Column:
        found = F.filter("__words", lambda w: known(w) & (key(w) == name))
        return F.when(F.size(found) > 0, F.transform(found, value))

    made: dict[str, Column] = {}
    for field in _FIELDS:
        token = last_value(field)
        if field.startswith("min_"):
            token = token.try_cast("bigint")
        made[field] = F.coalesce(F.col(field), token) if field in queries.columns else token
    for name in _LISTS:
        made[name] = F.coalesce(F.col(name), all_values(name)) if name in queries.columns else all_values(name)
    made["words"] = F.array_join(F.filter("__words", lambda w: ~known(w)), " ")
    return staged.withColumns(made).drop("__words")


def mentions_in(text: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"@(?<![a-zA-Z0-9_\p{L}\p{N}]@)([A-Za-z0-9_]{1,15})"), F.lit(1)), F.lower
    )


def _has(kind: str) -> Column:
    media = lambda t: F.exists("media_references", lambda m: m["type"] == t)
    tests = {
        "links": F.size("urls") > 0,
        "images": media("image"),
        "videos": media("video"),
        "media": F.size("media_references") > 0,
    }
    if kind not in tests:
        raise ValueError(f"has must be one of: {', '.join(tests)}")
    return F.coalesce(tests[kind], F.lit(False))


def _excluded(kind: str) -> Column:
    tests = {
        "retweets": F.col("timeline_item_kind") == "retweet",
        "replies": F.col("timeline_item_kind") == "reply",
        "links": F.size("urls") > 0,
    }
    if kind not in tests:
        raise ValueError(f"exclude must be one of: {', '.join(tests)}")
    return F.coalesce(tests[kind], F.lit(False))


def search_filter(
    posts: DataFrame,
    *,
    since: str | None = None,
    until: str | None = None,
    from_user: str | None = None,
    to_user: str | None = None,
    lang: str | None = None,
    has: Sequence[str] = (),
    exclude: Sequence[str] = (),
    min_likes: int | None = None,
    min_retweets: int | None = None,
    min_views: int | None = None,
) -> DataFrame:
    """Structured post filter. Time, author and language tests are plain comparisons, so they reach the file scan."""
    if since is not None:
        posts = posts.where(F.col("published_ts") >= F.lit(since).cast("timestamp"))
    if until is not None:
        posts = posts.where(F.col("published_ts") < F.lit(until).cast("timestamp"))
    if from_user is not None:
        posts = posts.where(F.lower("author") == F.lower(U.screen_name(F.lit(from_user))))
    if to_user is not None:
        posts = posts.where(F.array_contains(mentions_in(F.col("text")), F.lower(U.screen_name(F.lit(to_user)))))
    if lang is not None:
        posts = posts.where(F.col("lang") == lang)
    for kind in has:
        posts = posts.where(_has(kind))
    for kind in exclude:
        posts = posts.where(~_excluded(kind))
    for name, floor in (("likes", min_likes), ("retweets", min_retweets), ("views", min_views)):
        if floor is not None:
            posts = posts.where(metric(F.col("engagement"), name) >= floor)
    return posts


def merge_excludes(exclude: Sequence[str], profile: str | None) -> list[str]:
    given = [v.strip() for v in exclude if v.strip()]
    return list(dict.fromkeys([*given, *noise.DEFAULT_EXCLUDES.get(profile or "", ())]))


_FILTERS = ("since", "until", "from_user", "to_user", "lang", "min_likes", "min_retweets", "has")


def _options(spark: SparkSession, queries: Sequence[str], profile: str | None, given: dict[str, object]) -> list[dict[str, object]]:
    """Filters, words, exclusions and order of each query: given options win over inline tokens. One row per query text, so driver-sized."""
    parsed = parse_inline(spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "n int, query string")).orderBy("n").collect()
    out = []
    for row in parsed:
        chosen = {n: given.get(n) if given.get(n) not in (None, (), []) else row[n] for n in _FILTERS}
        exclude = merge_excludes(given.get("exclude") or (), profile) or list(row["exclude"] or ())
        kind = given.get("search_type") or row["search_type"] or ("top" if profile in ("precision", "balanced") else "latest")
        chosen |= {"has": chosen["has"] or (), "exclude": exclude, "min_views": given.get("min_views")}
        out.append({"filters": chosen, "kind": str(kind).lower(), "words": row["words"].split()})
    return out


def search_many(
    posts: DataFrame,
    queries: Sequence[str],
    *,
    limit: int,
    profile: str | None = "balanced",
    order: str = "ord",
    **options,
) -> noise.QualityFilter:
    """Posts for each query text, its inline tokens applied: structured filter, a pool of its own in result order, then the quality filter with backfill.

    A query's words must all occur (the backend's matching). ``top`` orders by likes, ``latest`` by time, ``photos`` and ``videos`` ask for that medium.
    Rows carry ``query_id`` (the text), ``search_rank`` (place in the pool) and ``unbounded_time_window``. Posts are read once per query for its filter
    to reach the scan; the pools are bounded by the limit.
    """
    pools = None
    for text, o in zip(queries, _options(posts.sparkSession, queries, profile, options), strict=True):
        found = search_filter(posts, **o["filters"])
        folded = T.casefold(F.coalesce("text", F.lit("")))
        for word in o["words"]:
            found = found.where(F.contains(folded, F.lit(word.casefold())))
        if o["kind"] in ("photos", "videos"):
            found = found.where(_has("images" if o["kind"] == "photos" else "videos"))
        by = [F.desc("published_ts"), F.col(order)]
        if o["kind"] == "top":
            by = [F.desc(F.coalesce(metric(F.col("engagement"), "likes"), F.lit(0.0))), F.col(order)]
        pool = found.orderBy(*by).limit(noise.fetch_limit(limit, profile))
        pool = pool.withColumns(
            {
                "query_id": F.lit(text),
                "query_tokens": T.query_tokens(F.lit(text)),
                "search_rank": F.row_number().over(Window.orderBy(*by)),  # over the bounded pool
                "unbounded_time_window": F.lit(o["filters"]["since"] is None and o["filters"]["until"] is None),
            }
        )
        pools = pool if pools is None else pools.unionByName(pool)
    return noise.QualityFilter(pools, query="query_id", order="search_rank", limit=limit, profile=profile)


_KINDS_HAS = ("links", "images", "videos", "media")
_KINDS_EXCLUDED = ("retweets", "replies", "links")


def search_table(
    posts: DataFrame, queries: DataFrame, *, limit: int, profile: str | None = "balanced", order: str = "ord", query: str = "query"
) -> noise.QualityFilter:
    """:func:`search_many` for a table of queries: all of them are found in one pass over the posts' texts.

    ``queries`` has a text column and any of the option columns of :func:`parse_inline` (an option there wins over an inline token); equal rows count once,
    and ``query_id`` is the query's text, or the column of that name. All words of a query must occur in the post. Pairs of post and query meet the
    query's filters as narrow rows, pools are cut per query with a group limit, and only the posts in a pool are fetched with all their columns.
    Queries without any word have nothing to be found by and are refused: they are plain filters, for :func:`search_filter`.
    """
    named = queries if "query_id" in queries.columns else queries.withColumn("query_id", F.col(query))
    parsed = durable(parse_inline(named.distinct(), query), "queries")
    if parsed.where("coalesce(words, '') = ''").limit(1).count():
        raise ValueError("a query of a query table needs at least one word")
    unknown = F.array_except(F.coalesce("has", F.array()), F.array(*map(F.lit, _KINDS_HAS)))
    wrong = F.array_except(F.coalesce("exclude", F.array()), F.array(*map(F.lit, _KINDS_EXCLUDED)))
    if parsed.where((F.size(unknown) > 0) | (F.size(wrong) > 0)).limit(1).count():
        raise ValueError(f"has must be one of {', '.join(_KINDS_HAS)}, exclude one of {', '.join(_KINDS_EXCLUDED)}")
    default = "top" if profile in ("precision", "balanced") else "latest"
    excluded = merge_excludes((), profile)
    asked = parsed.select(
        "query_id",
        F.col(query).alias("__text"),
        *[F.col(c).alias(f"__{c}") for c in ("to_user", "lang", "min_likes", "min_retweets")],
        F.lower(U.screen_name(F.col("from_user"))).alias("__from_user"),
        *[F.col(c).cast("timestamp").alias(f"__{c}") for c in ("since", "until")],
        F.coalesce("has", F.array().cast("array<string>")).alias("__has"),
        (F.array(*map(F.lit, excluded)) if excluded else F.coalesce("exclude", F.array().cast("array<string>"))).alias("__exclude"),
        F.lower(F.coalesce("search_type", F.lit(default))).alias("__kind"),
    )
    words = parsed.select("query_id", F.explode(F.split(T.casefold(F.col("words")), " ")).alias("word"))
    pairs = match_groups(posts, T.casefold(F.coalesce("text", F.lit(""))), words, row_id=order, group="query_id", term="word")
    likes = F.coalesce(metric(F.col("engagement"), "likes"), F.lit(0.0))
    narrow = posts.select(
        F.col(order).alias("__ord"),
        F.lower("author").alias("__author"),
        F.col("lang").alias("__lang_of"),
        F.col("published_ts").alias("__at"),
        likes.alias("__likes"),
        metric(F.col("engagement"), "likes").alias("__n_likes"),
        metric(F.col("engagement"), "retweets").alias("__n_retweets"),
        mentions_in(F.col("text")).alias("__mentions"),
        F.array_compact(F.array(*[F.when(_has(k), F.lit(k)) for k in _KINDS_HAS])).alias("__with"),
        F.array_compact(F.array(*[F.when(_excluded(k), F.lit(k)) for k in _KINDS_EXCLUDED])).alias("__without"),
    )
    met = pairs.join(narrow, F.col(order) == F.col("__ord")).join(asked, "query_id")
    optional = lambda column, test: F.col(column).isNull() | F.coalesce(test, F.lit(False))
    medium = F.when(F.col("__kind") == "photos", F.lit("images")).when(F.col("__kind") == "videos", F.lit("videos"))
    met = met.where(
        optional("__since", F.col("__at") >= F.col("__since"))
        & optional("__until", F.col("__at") < F.col("__until"))
        & optional("__from_user", F.col("__author") == F.col("__from_user"))
        & optional("__to_user", F.array_contains("__mentions", F.lower(U.screen_name(F.col("__to_user")))))
        & optional("__lang", F.col("__lang_of") == F.col("__lang"))
        & optional("__min_likes", F.col("__n_likes") >= F.col("__min_likes"))
        & optional("__min_retweets", F.col("__n_retweets") >= F.col("__min_retweets"))
        & (F.size(F.array_except("__has", "__with")) == 0)
        & ~F.arrays_overlap("__exclude", "__without")
        & (medium.isNull() | F.array_contains("__with", medium))
    )
    top = F.col("__kind") == "top"
    by = [F.desc(F.when(top, F.col("__likes"))), F.desc(F.when(~top, F.col("__at"))), F.col("__ord")]
    pool = top_per_group(met, ["query_id"], by, noise.fetch_limit(limit, profile), "search_rank").select(
        "query_id",
        T.query_tokens(F.col("__text")).alias("query_tokens"),
        F.col("search_rank").cast("int").alias("search_rank"),
        (F.col("__since").isNull() & F.col("__until").isNull()).alias("unbounded_time_window"),
        F.col("__ord").alias("__chosen"),
    )
    wide = posts.drop("query_id", "query_tokens", "search_rank", "unbounded_time_window")
    pools = fetch_rows(durable(pool, "pools"), wide, "__chosen", row_id=order).withColumnRenamed("__chosen", order)
    return noise.QualityFilter(pools, query="query_id", order="search_rank", limit=limit, profile=profile)


def search_posts(posts: DataFrame, query: str, *, limit: int, **options) -> noise.QualityFilter:
    """Posts for one query (see :func:`search_many`)."""
    return search_many(posts, [query], limit=limit, **options)


def hashtag_posts(posts: DataFrame, tag: str) -> DataFrame:
    """Posts that carry a hashtag, compared folded."""
    text = str(tag).strip().removeprefix("#").strip()
    if not text or any(c.isspace() for c in text):
        raise ValueError("a hashtag must be one word")
    tags = F.transform(U.hashtags_in(F.coalesce("text", F.lit(""))), T.casefold)
    return posts.where(F.array_contains(tags, f"#{text.casefold()}"))


def user_posts(
    posts: DataFrame,
    *,
    originals_only: bool = True,
    min_likes: int | None = None,
    min_retweets: int | None = None,
    min_views: int | None = None,
    rules: tf.TopicRules = tf.TopicRules(),
    limit: int = 20,
    profile: str | None = "balanced",
    order: str = "ord",
) -> tuple[noise.QualityFilter, DataFrame]:
    """Timelines of all authors at once: originals, metric floors, topic fit, then the quality filter per author.

    Returns the quality filter (its groups are authors) and the metric and topic drop counts per author.
    """
    if originals_only:
        posts = posts.where(F.coalesce(F.col("timeline_item_kind") != "retweet", F.lit(True)))
    failed = noise.metric_reasons(F.col("engagement"), min_likes=min_likes, min_retweets=min_retweets, min_views=min_views)
    staged = posts.withColumn("__failed", failed.cast("array<string>"))
    staged = tf.evaluate(staged, noise.collected_parts(), rules)
    reasons = F.when(F.size("__failed") > 0, F.col("__failed")).otherwise(F.col("topic_fit.drop_reasons"))
    # filters on the reasons would else build each text's haystack a second time
    staged = T.evaluate_once(staged, __reasons=reasons)
    drops = (
        staged.select("author", F.explode("__reasons").alias("reason"))
        .groupBy("author", "reason")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    kept = staged.where(F.size("__reasons") == 0).drop("__failed", "__reasons")
    kept = kept.withColumn("query_tokens", F.array().cast("array<string>"))
    chosen = noise.QualityFilter(
        kept,
        query="author",
        order=order,
        limit=limit,
        profile=profile,
        require_query_match=False,
        drop_retweets=originals_only,
        drop_replies=False,
    )
    return chosen, drops


def profiles(accounts: DataFrame, names: DataFrame) -> DataFrame:
    """Profile rows for requested names (``@name``, URL or bare)."""
    wanted = names.select(T.casefold(U.screen_name(F.col("name"))).alias("__h")).distinct()
    return accounts.withColumn("__h", T.casefold(F.col("handle"))).join(wanted, "__h", "left_semi").drop("__h")


def threads(posts: DataFrame, requested: DataFrame) -> DataFrame:
    """All posts of the conversations that hold the requested post ids or URLs; a requested post outside any conversation is its own thread."""
    ids = requested.select(U.post_id(F.col("post")).alias("id")).distinct()
    found = posts.select("id", "conversation_id").join(ids, "id", "left_semi")
    conversations = found.where("conversation_id IS NOT NULL").select("conversation_id").distinct()
    alone = posts.where("conversation_id IS NULL").join(ids, "id", "left_semi")
    return posts.join(conversations, "conversation_id", "left_semi").unionByName(alone.select(posts.columns))


