"""Noise predicates, drop reasons, and the per-query quality filter with backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions.values import metric
from ..plans.skew import top_per_group

# fixed values: engagement thresholds and fetch oversampling of the quality profiles
ENGAGEMENT_THRESHOLDS = {
    "precision": {"views": 5000, "likes": 100, "retweets": 20},
    "balanced": {"views": 1000, "likes": 25, "retweets": 5},
}
FETCH_MULTIPLIER = {"precision": 5, "balanced": 3, "recall": 1}
FETCH_CAP = {"precision": 150, "balanced": 100, "recall": None}
DEFAULT_EXCLUDES = {"precision": ("retweets", "replies"), "balanced": ("retweets", "replies")}


def fetch_limit(requested: int, profile: str | None) -> int:
    """Candidate pool per query: oversampled and capped, never below the request."""
    if profile in (None, "recall"):
        return requested
    return max(requested, min(requested * FETCH_MULTIPLIER[profile], FETCH_CAP[profile]))


def structural_counts(text: Column, urls: Column | None = None) -> dict[str, Column]:
    body = F.coalesce(text, F.lit(""))
    in_text = F.regexp_count(T.plain_lower(body), F.lit(P.URL_RE))
    listed = F.lit(0) if urls is None else F.coalesce(F.size(F.filter(urls, lambda u: F.length(u) > 0)), F.lit(0))
    return {
        "hashtags": F.regexp_count(body, F.lit(P.HASHTAG_RE)),
        "cashtags": F.regexp_count(body, F.lit(P.CASHTAG_RE)),
        "mentions": F.regexp_count(body, F.lit(P.MENTION_RE)),
        "urls": F.greatest(in_text, listed),
    }


def structural_noise(text: Column, urls: Column | None = None) -> Column:
    c = structural_counts(text, urls)
    return (c["hashtags"] >= 5) | (c["cashtags"] >= 3) | (c["mentions"] >= 4) | (c["urls"] >= 2)


def promo_phrase(text: Column) -> Column:
    return T.contains_any(T.casefold(F.coalesce(text, F.lit(""))), list(P.PROMO_PHRASES))


def low_content(text: Column, kind: Column | None = None) -> Column:
    text = F.coalesce(text, F.lit(""))
    quote = F.lit(False) if kind is None else F.coalesce(kind == "quote", F.lit(False))
    # what a beginning is squeezed to, the whole begins with; so the whole is squeezed for few texts only
    short = F.when(F.length(T.squeeze(F.left(text, F.lit(200)))) > 12, False).otherwise(F.length(T.squeeze(text)) <= 12)
    stub = F.when(quote & F.endswith(T.strip(text), F.lit(":")), F.size(F.split(T.squeeze(text), " ")) <= 8).otherwise(False)
    return short | stub


def engagement_gate(engagement: Column, profile: str | None) -> Column:
    limits = ENGAGEMENT_THRESHOLDS.get(profile or "")
    if limits is None:
        return F.lit(True)
    passed = F.lit(False)
    for name, floor in limits.items():
        passed = passed | (metric(engagement, name) >= floor)
    return passed


def metric_reasons(engagement: Column, **minimums: int | None) -> Column:
    """Every failed threshold among min_likes, min_retweets and min_views (absent counts are 0)."""
    fields = {"min_likes": "likes", "min_retweets": "retweets", "min_views": "views"}
    return T.reason_list(
        *[
            (name, metric(engagement, fields[name]) < minimums[name])
            for name in fields
            if minimums.get(name) is not None
        ]
    )


def noise_reasons(
    *,
    text: Column,
    urls: Column | None = None,
    kind: Column,
    query_miss: Column | None = None,
    engagement: Column | None = None,
    profile: str | None = None,
    drop_retweets: bool = False,
    drop_replies: bool = False,
    drop_low_content: bool = False,
) -> Column:
    """Ordered drop reasons of one item. Structural noise and promo phrases always count."""
    k = F.coalesce(F.lower(T.strip(kind)), F.lit(""))
    pairs = []
    if drop_retweets:
        pairs.append(("retweet", k == "retweet"))
    if drop_replies:
        pairs.append(("reply", k == "reply"))
    if query_miss is not None:
        pairs.append(("query_miss", query_miss))
    pairs += [("structural_noise", structural_noise(text, urls)), ("promo_phrase", promo_phrase(text))]
    if drop_low_content:
        pairs.append(("low_content", low_content(text, k)))
    if profile in ENGAGEMENT_THRESHOLDS:
        pairs.append(("engagement_gate", ~engagement_gate(engagement, profile)))
    return T.reason_list(*pairs)


def reason_counts(df: DataFrame, reasons: str | Column, name: str = "reason") -> DataFrame:
    """Rows per reason; a row counts once under each of its reasons."""
    col = F.col(reasons) if isinstance(reasons, str) else reasons
    return df.select(F.explode(col).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("count"))


def collected_parts() -> list[Column]:
    """Search parts at collection time, in order."""
    names = ("text", "author", "author_name", "quoted_author_handle", "quoted_author_name")
    return [*[F.col(n) for n in names], F.array_join(F.col("urls"), " ")]


def folded_parts(parts: list[Column]) -> Column:
    """Non-empty parts joined by spaces, then folded."""
    return T.casefold(T.strip(F.concat_ws(" ", *[F.when(F.length(p) > 0, p) for p in parts])))


def query_hit(parts: list[Column], tokens: Column) -> Column:
    """Any token is a substring of the folded, space-joined non-empty parts."""
    hay = folded_parts(parts)
    return T.let(hay, lambda h: F.exists(tokens, lambda t: (F.length(t) > 0) & F.contains(h, t)))


class QualityFilter:
    """Per-query quality filter with backfill.

    Clean rows come first in arrival order, then rows that failed nothing but the engagement gate, up to the query's limit.
    ``kept`` holds the chosen rows, ``drop_counts`` the reason counts per query: hard reasons plus backfill rows left unused.
    """

    def __init__(
        self,
        posts: DataFrame,
        *,
        query: str,
        order: str,
        limit: int,
        profile: str | None = "balanced",
        require_query_match: bool = True,
        drop_retweets: bool = True,
        drop_replies: bool = True,
    ):
        self.query, self.order, self.limit = query, order, limit
        if profile not in ENGAGEMENT_THRESHOLDS:
            self.kept = top_per_group(posts, [query], [F.col(order)], limit).drop("__rn")
            self.drop_counts = posts.select(query, F.lit("").alias("reason"), F.lit(0).alias("count")).limit(0)
            return
        tokens = F.col("query_tokens")
        miss = (F.size(tokens) > 0) & ~query_hit(collected_parts(), tokens) if require_query_match else None
        reasons = noise_reasons(
            text=F.col("text"),
            urls=F.col("urls"),
            kind=F.col("timeline_item_kind"),
            query_miss=miss,
            engagement=F.col("engagement"),
            profile=profile,
            drop_retweets=drop_retweets,
            drop_replies=drop_replies,
        )
        judged = T.evaluate_once(posts, drop_reasons=reasons)
        backfill = (F.size("drop_reasons") == 1) & (F.get("drop_reasons", F.lit(0)) == "engagement_gate")
        judged = judged.withColumn("__class", F.when(F.size("drop_reasons") == 0, 0).when(backfill, 1).otherwise(2))
        self.kept = top_per_group(
            judged.where("__class < 2"), [query], [F.col("__class"), F.col(order)], limit, "position"
        ).withColumn("backfilled", F.col("__class") == 1).drop("__class")
        hard = (
            judged.where("__class = 2")
            .select(query, F.explode("drop_reasons").alias("reason"))
            .groupBy(query, "reason")
            .agg(F.count(F.lit(1)).alias("count"))
        )
        unused = (
            judged.groupBy(query)
            .agg(F.count_if(F.col("__class") == 0).alias("clean"), F.count_if(F.col("__class") == 1).alias("spare"))
            .select(
                query,
                F.lit("engagement_gate").alias("reason"),
                (F.col("spare") - F.least("spare", F.greatest(F.lit(limit) - F.col("clean"), F.lit(0)))).alias("count"),
            )
            .where("count > 0")
        )
        # hard rows can carry engagement_gate beside another reason, so the two parts are added up
        self.drop_counts = (
            hard.unionByName(unused).groupBy(query, "reason").agg(F.sum("count").cast("long").alias("count"))
        )


def first_samples(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """First n example rows per group (bounded audit samples)."""
    return top_per_group(df, [group], [F.col(order)], n, "sample")


