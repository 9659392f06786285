"""Curation of one mission: candidate plan → keyword drop → coverage topics → re-rank → diversity → topic spread → reports."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coverage, curate, judge, neardup, noise, score, search
from ..operators import topic_fit as tf
from ..operators.items import SIGHTING_COLUMNS, with_columns
from .candidates import CandidatePlan, plan_candidates
from .skew import durable, number_within, top_per_group


@dataclass(frozen=True)
class Mission:
    """Checked mission options. Defaults follow the quality profile where one decides."""

    target_posts: int = 100
    quality_profile: str = "balanced"
    topic_rules: tf.TopicRules = field(default_factory=tf.TopicRules)
    excluded_keywords: tuple[str, ...] = ()
    max_posts_per_author: int | None = None
    max_posts_per_thread: int | None = None
    max_posts_per_url: int | None = None
    min_seen_in: int | None = None
    require_topic_spread: bool = False
    drop_low_content: bool | None = None
    require_query_match: bool | None = None
    topics: tuple[coverage.Topic, ...] = ()
    languages: tuple[str, ...] = ()
    objective: str = ""
    max_gap_queries: int = 4
    min_posts_per_topic: int = 1

    def __post_init__(self) -> None:
        if self.target_posts < 1:
            raise ValueError("target_posts must be greater than or equal to 1")
        if self.quality_profile not in ("precision", "balanced", "recall"):
            raise ValueError("quality_profile must be one of: precision, balanced, recall")

    @property
    def scan_limit(self) -> int:
        return self.target_posts * 3

    @property
    def drops_noise(self) -> bool:
        if self.drop_low_content is not None:
            return self.drop_low_content
        return self.quality_profile in noise.ENGAGEMENT_THRESHOLDS

    @property
    def needs_query_match(self) -> bool:
        return self.quality_profile != "recall" if self.require_query_match is None else self.require_query_match

    def per_query_limit(self, queries: int) -> int:
        return max(math.ceil(self.target_posts / max(queries, 1)), 1)

    def fair_share(self, items: DataFrame, queries: DataFrame, *, query: str = "query_id", order: str = "ord") -> DataFrame:
        """Sightings cut to their query's share: its own ``limit`` where the query table has one, else an equal part of the target.

        ``queries`` is the whole list of planned queries (also those without any sighting); the first sightings of each query stay, in ``order``. Sightings
        without a query are not cut, those of a query that is not planned are dropped.
        """
        own = F.col("limit") if "limit" in queries.columns else F.lit(None)
        planned = durable(queries.where(F.col(query).isNotNull()).groupBy(query).agg(F.max(own.cast("int")).alias("__own")), "planned")
        share = self.per_query_limit(planned.count())
        planned = planned.select(F.col(query).alias("__query"), F.greatest(F.coalesce("__own", F.lit(share)), F.lit(1)).alias("__share"))
        most = planned.agg(F.max("__share")).first()[0] or share
        # the greatest share bounds what any task ships of a query; the query's own one is applied to what is left
        first = top_per_group(items.where(F.col(query).isNotNull()), [query], [F.col(order)], most, "__place")
        kept = first.join(planned, F.col(query) == F.col("__query")).where("__place <= __share")
        return kept.select(items.columns).unionByName(items.where(F.col(query).isNull()))


@dataclass
class Curated:
    mission: Mission
    plan: CandidatePlan
    keyword_dropped: DataFrame
    diversity_dropped: DataFrame
    ranked: DataFrame
    spread: DataFrame

    @cached_property
    def drop_counts(self) -> DataFrame:
        """Rows dropped per reason over all stages."""
        parts = self.plan.filtered.drop_counts
        parts = parts.unionByName(
            self.keyword_dropped.select(F.lit("excluded_keyword").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("count"))
        )
        parts = parts.unionByName(self.diversity_dropped.groupBy("reason").agg(F.count(F.lit(1)).alias("count")))
        return parts.groupBy("reason").agg(F.sum("count").alias("count"))

    def coverage_report(self) -> DataFrame:
        return coverage.report(
            self.ranked, self.mission.topics, min_posts_per_topic=self.mission.min_posts_per_topic
        )

    def judge_rows(self, limit: int | None = None) -> DataFrame:
        return judge.fallback_rows(judge.evidence(self.ranked, limit or min(self.mission.target_posts, judge.DEFAULT_LIMIT)))

    def report(self) -> DataFrame:
        """Long-form run report (section, key, count) over the ranked selection and the drops."""
        drops = self.drop_counts.select(F.lit("filter_drop").alias("section"), F.col("reason").alias("key"), "count")
        quality = score.diagnostics(self.ranked)
        fit = (
            self.ranked.select(F.explode(tf.quality_reasons(F.col("topic_fit"))).alias("key"))
            .groupBy("key")
            .agg(F.count(F.lit(1)).alias("count"))
            .select(F.lit("topic_fit_reason").alias("section"), "key", "count")
            if "topic_fit" in self.ranked.columns
            else quality.limit(0)
        )
        totals = self.ranked.agg(F.count(F.lit(1)).alias("count")).select(
            F.lit("total").alias("section"), F.lit("ranked").alias("key"), "count"
        )
        return drops.unionByName(quality).unionByName(fit).unionByName(totals)

    def target(self) -> DataFrame:
        status = self.spread.select("status").first()[0] if self.mission.require_topic_spread else None
        return curate.target_diagnostics(
            target=self.mission.target_posts,
            ranked=self.ranked,
            summary=self.plan.history.summary(),
            filtered=self.plan.filtered.survivors,
            drops=self.drop_counts,
            spread_status=status,
        )


def curate_mission(items: DataFrame, mission: Mission) -> Curated:
    """Run the curation over item sightings.

    The pool that gets ranked is the first ``3 * target_posts`` survivors in first-seen order; that bound is part of the
    result's definition. Everything before it runs over all sightings.
    """
    plan = plan_candidates(
        items,
        by="post",
        limit=mission.scan_limit,
        prefer_originals=True,
        drop_noise=mission.drops_noise,
        require_query_match=mission.needs_query_match,
        topic_rules=mission.topic_rules,
        min_seen_in=mission.min_seen_in,
        drop_title_duplicates=True,
        max_per_author=mission.max_posts_per_author,
        near_duplicates=False,  # scores are computed afresh below, so the pool's own penalties would be thrown away
    )
    pool = durable(plan.returned.drop("quality_score", "quality_reasons"), "pool")
    kept, keyword_dropped = curate.drop_keywords(pool, mission.excluded_keywords)
    annotated = coverage.annotate(kept, mission.topics) if mission.topics else kept
    scored = durable(score.score(annotated), "rescored")
    adjusted = neardup.downrank(scored, "candidate_key", "first_ord")
    ranked = durable(curate.final_rank(adjusted), "ranked")
    caps = {
        "author_diversity": mission.max_posts_per_author,
        "thread_diversity": mission.max_posts_per_thread,
        "url_diversity": mission.max_posts_per_url,
    }
    diverse, dropped = curate.apply_diversity(ranked, caps)
    chosen, spread = curate.topic_spread(
        _renumber(diverse), [t.topic_id for t in mission.topics], mission.target_posts, requested=mission.require_topic_spread
    )
    final = chosen.drop("rank").withColumnRenamed("position", "rank")
    return Curated(mission, plan, keyword_dropped, dropped, durable(final, "final"), spread)


@dataclass
class GapFill:
    """A mission before and after its follow-up round."""

    first: Curated
    final: Curated
    queries: DataFrame
    marked: DataFrame
    found: DataFrame

    def gaps(self) -> DataFrame:
        """Per topic: gap before and after, the follow-up queries asked for it and the new posts they brought."""
        after = self.final.coverage_report().select("topic_id", F.col("count").alias("count_after"), F.col("gap").alias("gap_after"))
        asked = self.queries.groupBy("topic_id").agg(F.count(F.lit(1)).alias("queries"))
        brought = self.found.join(self.queries.select("query_id", "topic_id"), "query_id").groupBy("topic_id").agg(F.count_distinct("id").alias("found_posts"))
        rows = self.marked.select("topic_id", F.col("count").alias("count_before"), F.col("gap").alias("gap_before"), "blocked_reason")
        rows = rows.join(after, "topic_id").join(asked, "topic_id", "left").join(brought, "topic_id", "left")
        return rows.fillna(0, ["queries", "found_posts"]).withColumn(
            "status", F.when(F.col("gap_before") == 0, "covered").when(F.col("gap_after") == 0, "closed").when(F.col("gap_after") < F.col("gap_before"), "narrowed").otherwise("open")
        )


def fill_gaps(items: DataFrame, corpus: DataFrame, mission: Mission, planned: DataFrame | None = None) -> GapFill:
    """A mission with one follow-up round: curate, report the gaps, ask the topics' queries, merge what they find, curate again.

    ``items`` are the sightings collected so far and ``corpus`` the posts that can be searched (columns of :func:`search.search_table`); ``planned`` has the
    queries (input, lang) asked already. At most ``mission.max_gap_queries`` queries are asked, in the topics' order, each for its probe limit of posts. What
    they find is appended as sightings behind the collected ones, with the query's id, intent and role, so posts seen before only gain a sighting.
    Without a queryable gap nothing is searched and the first selection is final.
    """
    spark, items = items.sparkSession, with_columns(items, SIGHTING_COLUMNS)  # the follow-ups bring their query's id, intent and role
    first = curate_mission(items, mission)
    report = durable(first.coverage_report(), "gap-report")
    follow = coverage.follow_ups(spark, mission.topics, list(mission.languages) or [None], objective=mission.objective, target_posts=mission.target_posts)
    planned = spark.createDataFrame([], "input string, lang string") if planned is None else planned
    queries, marked = coverage.gap_queries(report, follow, planned, max_queries=mission.max_gap_queries)
    queries, marked = durable(queries, "gap-queries"), durable(marked, "gap-marks")
    limits = [r["limit"] for r in queries.select("limit").distinct().collect()]  # at most max_gap_queries rows
    if not limits:
        nothing = items.select("id").limit(0).withColumn("query_id", F.lit(None).cast("string"))
        return GapFill(first, first, queries, marked, nothing)
    found = None
    for limit in limits:
        own = queries.where(F.col("limit") == limit).select("query_id", F.col("input").alias("query"), "lang")
        part = search.search_table(corpus, own, limit=limit, profile=mission.quality_profile).kept
        found = part if found is None else found.unionByName(part)
    found = durable(found, "found")
    last = items.agg(F.max("ord")).first()[0] or 0
    numbered = number_within(found.drop("ord"), [], ["query_id", "search_rank"], position="ord").withColumn("ord", F.col("ord") + F.lit(last))
    new = numbered.drop("intent", "source_role", "input").join(F.broadcast(queries.select("query_id", "intent", "source_role", "input")), "query_id")
    new = new.withColumn("operation", F.lit("search"))
    shared = [c for c in items.columns if c in new.columns]
    merged = items.unionByName(new.select(shared), allowMissingColumns=True)
    return GapFill(first, curate_mission(merged, mission), queries, marked, found)


def _renumber(diverse: DataFrame) -> DataFrame:
    """Close the gaps that dropped rows left in ``rank``."""
    return number_within(diverse, [], ["rank"], position="__p").drop("rank").withColumnRenamed("__p", "rank")
