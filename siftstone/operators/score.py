"""Explainable evidence score: row signals, additive points with ordered reason codes, diagnostics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions import patterns as P
from ..functions import text as T
from ..functions import values as V
from . import noise
from . import topic_fit as tf
from .items import ITEM_COLUMNS, with_columns

RUBRIC_VERSION = "deterministic_evidence_v3"
# fixed values: reason groups used by the diagnostics and by near-duplicate detection
NEGATIVE_REASONS = (
    "query_miss_penalty", "reply", "retweet", "thin_quote", "thin_content", "promo_language", "commerce_language",
    "cta_language", "generic_announcement", "low_evidence_promo", "cta_over_evidence", "weak_evidence_density",
    "coverage_topic_only", "media_only", "near_duplicate_downrank", "near_duplicate_promo_cluster",
    "near_duplicate_template",
)
DOWNRANK_REASONS = ("near_duplicate_downrank", "near_duplicate_promo_cluster", "near_duplicate_template")
PROMOISH_REASONS = (
    "promo_language", "commerce_language", "cta_language", "generic_announcement", "low_evidence_promo",
    "weak_evidence_density",
)


def concrete_details(text: Column) -> Column:
    """Number of distinct concrete details (numbers, dates, units, versions) in lower-case text."""
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(P.CONCRETE_DETAIL_RE), F.lit(0))))


def search_text() -> Column:
    return T.casefold(T.joined(*[F.col(c) for c in ("title", "text", "author", "url", "canonical_url")]))


def planner_text() -> Column:
    """Haystack of the query-match filter over candidates."""
    names = ("title", "text", "author", "author_name", "quoted_author_handle", "quoted_author_name", "url")
    parts = [*[F.col(n) for n in names], F.array_join(F.col("urls"), " ")]
    return noise.folded_parts(parts)


def with_query_hits(df: DataFrame, tokens: str = "query_tokens") -> DataFrame:
    """Token counts for rows that carry their own query's tokens as an array."""
    toks = F.array_distinct(
        F.filter(F.transform(F.col(tokens), lambda t: T.casefold(T.strip(t))), lambda t: F.length(t) > 0)
    )
    staged = df.withColumns({"__toks": toks, "__hay": search_text(), "__hay2": planner_text()})
    return staged.withColumns(
        {
            "query_token_count": F.coalesce(F.size("__toks"), F.lit(0)),
            "query_token_hits": F.size(T.shared_parts(F.col("__hay"), F.col("__toks"))),
            "query_found": F.exists("__toks", lambda t: F.contains(F.col("__hay2"), t)),
        }
    ).drop("__toks", "__hay", "__hay2")


_HINT_GROUPS = tuple(P.SIGNAL_HINTS.values())  # a plain value, so that it travels with the function


@F.arrow_udf(IntegerType())
def _signal_hints(texts: pa.Array) -> pa.Array:
    """Bit n: the text may hold signal n of :data:`~siftstone.functions.patterns.SIGNAL_HINTS`. All patterns together cost a text less here, without
    look-around and backtracking, than one of the exact ones."""
    known: dict[str, np.ndarray] = {}

    def found(pattern: str) -> np.ndarray:
        if pattern not in known:
            known[pattern] = pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_numpy(zero_copy_only=False)
        return known[pattern]

    bits = np.zeros(len(texts), np.int32)
    for n, groups in enumerate(_HINT_GROUPS):
        for group in groups:
            bits |= np.logical_and.reduce([found(p) for p in group]).astype(np.int32) << n
    return pa.array(bits)


def with_signals(df: DataFrame) -> DataFrame:
    """Boolean and count signal columns, prefixed ``sig_``."""
    staged = df.withColumn("__body", T.main_text(F.col("text"), F.col("title")))
    body = F.col("__low")
    staged = T.evaluate_once(staged, __low=T.plain_lower(F.col("__body"))).withColumn("__hints", _signal_hints(body))
    hinted = {name: F.col("__hints").bitwiseAND(F.lit(1 << n)) != 0 for n, name in enumerate(P.SIGNAL_HINTS)}
    holds = lambda name, pattern: F.when(hinted[name], body.rlike(pattern)).otherwise(False)
    staged = staged.withColumns(
        {
            "sig_concrete": F.when(hinted["concrete"], concrete_details(body)).otherwise(0),
            "sig_process": holds("process", P.PROCESS_RE),
            "sig_first_person": holds("first_person", P.FIRST_HAND_RE),
            "sig_observable_text": holds("observable_text", P.OBSERVABLE_RE),
            "sig_comparison": holds("comparison", P.COMPARISON_RE),
            "sig_specific": holds("specific", P.SPECIFICITY_RE),
            "sig_promo": noise.promo_phrase(F.col("__body")) | holds("promo", P.PROMO_RE),
            "sig_commerce": holds("commerce", P.COMMERCE_RE),
            "sig_cta": holds("cta", P.CTA_RE),
            "sig_announcement": holds("announcement", P.ANNOUNCEMENT_RE),
            "sig_media": F.coalesce(F.size("media_references") > 0, F.lit(False)),
            "sig_kind": F.coalesce(F.lower(F.col("timeline_item_kind")), F.lit("")),
            "sig_engagement": V.engagement_score(F.col("engagement")),
        }
    )
    first_hand = F.col("sig_first_person") | F.col("sig_process")
    supported = (F.col("sig_concrete") > 0) | first_hand | F.col("sig_specific")
    staged = staged.withColumns(
        {
            "sig_first_hand": first_hand,
            "sig_observable": F.col("sig_observable_text") | (F.col("sig_media") & supported),
        }
    )
    support = [F.col("sig_concrete") > 0] + [
        F.col(f"sig_{n}") for n in ("first_hand", "process", "observable", "comparison", "specific")
    ]
    total = F.lit(0)
    for flag in support:
        total = total + flag.cast("int")
    return staged.withColumn("sig_support", total).drop("__low", "__hints")


def score(df: DataFrame) -> DataFrame:
    """Add ``quality_score`` and ``quality_reasons``.

    Expects item columns plus ``seen_in_count``, ``source_role`` and ``topic_fit`` where known, and the query-hit columns of
    :func:`with_query_hits` (or of the candidate plan). Missing ones count as absent.
    """
    keep = list(df.columns)
    df = with_columns(
        df,
        {
            **ITEM_COLUMNS,
            "seen_in_count": "bigint",
            "source_role": "string",
            "query_token_count": "int",
            "query_token_hits": "int",
            "topic_fit": "struct<matched:boolean,match_reasons:array<string>,score_bonus:double>",
        },
    )
    df = with_signals(df)
    signals = [c for c in df.columns if c.startswith("sig_")]
    df = T.evaluate_once(df, **{c: F.col(c) for c in signals})
    body, kind = F.col("__body"), F.col("sig_kind")
    seen = F.coalesce(F.col("seen_in_count"), F.lit(0))
    tokens, hits = F.coalesce("query_token_count", F.lit(0)), F.coalesce("query_token_hits", F.lit(0))
    engagement, concrete, support = F.col("sig_engagement"), F.col("sig_concrete"), F.col("sig_support")
    # signals are regular expressions over the whole text, so they are fixed before the points refer to them many times
    promo, commerce, cta, news = (F.col(f"sig_{n}") for n in ("promo", "commerce", "cta", "announcement"))
    fit = F.col("topic_fit")
    bonus = F.coalesce(tf.score_bonus(fit), F.lit(0.0))
    fit_reasons = F.coalesce(tf.quality_reasons(fit), F.array().cast("array<string>"))
    strong = (bonus >= 4) | F.arrays_overlap(fit_reasons, F.array(*[F.lit(r) for r in tf.STRONG_REASONS]))
    declared = F.coalesce(F.size("coverage_topics") > 0, F.lit(False)) | F.coalesce(
        T.casefold(T.strip(F.col("source_role"))) == "coverage_gap_fill", F.lit(False)
    )
    match = (tokens > 0) & (hits > 0)
    topical = match | (bonus > 0)
    length = F.length(body)
    without_urls = F.length(T.strip(F.regexp_replace(body, P.HTTP_URL_RE, "")))
    low_support = support <= 1
    # (reason, condition, points) in the order points are added and reasons listed
    table: list[tuple[str, Column, Column | float]] = [
        ("multi_seen", seen > 1, F.least(seen, F.lit(5)) * 6.0),
        ("original", kind == "original", 8.0),
        ("quote", kind == "quote", 3.0),
        ("reply", kind == "reply", -4.0),
        ("retweet", kind == "retweet", -8.0),
        ("query_match", match, 2.0 + F.least(hits * 1.5, F.lit(4.0))),
        ("strong_query_match", match & (hits * 4 >= tokens * 3), 2.0),
        ("query_miss_penalty", (tokens > 0) & (hits == 0), -3.0),
        ("engagement_capped", engagement > 4, 0.0),
        ("engagement", engagement > 0, F.least(engagement, F.lit(4.0))),
        ("substantial_text", length >= 80, 3.0),
        ("some_text", (length >= 35) & (length < 80), 1.5),
        ("media", F.col("sig_media"), 0.5),
        ("media_only", F.col("sig_media") & ~F.col("sig_observable"), 0.0),
        ("has_url", F.coalesce(F.length("url") > 0, F.lit(False)), 0.5),
        ("concrete_detail", concrete > 0, F.least(2.0 + concrete * 0.75, F.lit(4.0))),
        ("process_evidence", F.col("sig_process"), 2.0),
        ("first_hand_signal", F.col("sig_first_hand"), 4.0),
        ("observable_signal", F.col("sig_observable"), 1.5),
        ("comparison_signal", F.col("sig_comparison"), 1.5),
        ("specificity_signal", F.col("sig_specific"), 1.0),
        ("novel_signal", declared, 0.75),
        ("coverage_topic_only", declared & (support == 0), -1.5),
        ("thin_quote", (kind == "quote") & (without_urls < 80), -3.0),
        ("thin_content", noise.low_content(body, kind), -3.0),
        ("promo_language", promo, -4.0),
        ("commerce_language", commerce, -2.0),
        ("cta_language", cta, -3.0),
        ("generic_announcement", news & low_support, -1.5),
        ("low_evidence_promo", (promo | commerce | cta | news) & low_support, -4.0),
        ("cta_over_evidence", cta & low_support, -2.0),
    ]
    tail: list[tuple[str, Column, Column | float]] = [
        ("topic_fit_strong", (bonus > 0) & strong, 1.0),
        ("weak_evidence_density", topical & (support == 0), -3.0),
        ("evidence_dense", topical & (support >= 3), 2.5),
    ]
    points = F.lit(0.0)
    for _, cond, value in table:
        points = points + F.when(cond, value).otherwise(0.0)
    points = points + F.when(bonus > 0, F.least(bonus, F.lit(3.0))).otherwise(0.0)
    for _, cond, value in tail:
        points = points + F.when(cond, value).otherwise(0.0)
    reasons = F.concat(
        T.reason_list(*[(name, cond) for name, cond, _ in table]),
        F.when(bonus > 0, fit_reasons).otherwise(F.array().cast("array<string>")),
        T.reason_list(*[(name, cond) for name, cond, _ in tail]),
    )
    out = T.evaluate_once(df, quality_score=F.round(points, 3), quality_reasons=F.array_distinct(reasons))
    return out.select(*[c for c in keep if c not in ("quality_score", "quality_reasons")], "quality_score", "quality_reasons")


def promoish(reasons: Column) -> Column:
    return F.arrays_overlap(reasons, F.array(*[F.lit(r) for r in PROMOISH_REASONS]))


def diagnostics(scored: DataFrame) -> DataFrame:
    """Long-form (section, key, count): scored rows, all reasons, and the negative and downrank subsets."""
    reasons = F.col("quality_reasons")

    def tag(section: str, values: Column) -> Column:
        return F.transform(values, lambda r: F.struct(F.lit(section).alias("section"), r.alias("key")))

    subset = lambda names: F.filter(reasons, lambda r: r.isin(*names))
    scored_row = F.when(
        F.col("quality_score").isNotNull(),
        F.array(F.struct(F.lit("scored").alias("section"), F.lit(RUBRIC_VERSION).alias("key"))),
    ).otherwise(F.array().cast("array<struct<section:string,key:string>>"))
    rows = F.concat(
        scored_row, tag("reason", reasons), tag("negative", subset(NEGATIVE_REASONS)), tag("downrank", subset(DOWNRANK_REASONS))
    )
    return (
        scored.select(F.explode(rows).alias("r"))
        .groupBy(F.col("r.section").alias("section"), F.col("r.key").alias("key"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def downrank_samples(ranked: DataFrame, order: str, n: int = 5) -> DataFrame:
    """First n downranked rows with their reasons and a short preview."""
    hit = F.filter("quality_reasons", lambda r: r.isin(*DOWNRANK_REASONS))
    return (
        ranked.where(F.size(hit) > 0)
        .orderBy(order)
        .limit(n)
        .select(
            "id",
            "source_item_id",
            hit.alias("reasons"),
            "quality_score",
            F.left(T.main_text(F.col("text"), F.col("title")), F.lit(160)).alias("text_preview"),
        )
    )
