"""Topic coverage: annotation, gap report, follow-up queries, query expansion."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.skew import durable, top_per_group
from .terms import match_terms


@dataclass(frozen=True)
class Topic:
    """A declared coverage topic (caller configuration)."""

    topic_id: str
    label: str
    terms: tuple[str, ...]
    queries: tuple[str, ...] = ()
    min_posts: int | None = None
    probe_limit: int | None = None


def probe_limit(target_posts: int) -> int:
    return min(max(math.ceil(target_posts / 2), 5), 25)


def topic_haystack() -> Column:
    return T.casefold(T.joined(F.col("title"), F.col("text"), F.col("author")))


def _terms(topic: Topic) -> list[str]:
    return [str(t).casefold() for t in topic.terms if str(t).strip()]


def annotate(df: DataFrame, topics: Sequence[Topic]) -> DataFrame:
    """Set ``coverage_topics`` to the matching topics in declared order; rows without a match keep what they had."""
    staged = df.withColumn("__hay", topic_haystack())
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    T.contains_any(F.col("__hay"), _terms(t)),
                    F.struct(F.lit(t.topic_id).alias("topic_id"), F.lit(t.label).alias("label")),
                )
                for t in topics
            ]
        )
    )
    old = F.col("coverage_topics") if "coverage_topics" in df.columns else F.lit(None)
    staged = staged.withColumn("__found", found)
    return staged.withColumn(
        "coverage_topics", F.when(F.size("__found") > 0, F.col("__found")).otherwise(old)
    ).drop("__hay", "__found")


def report(ranked: DataFrame, topics: Sequence[Topic], *, min_posts_per_topic: int = 1, rank: str = "rank") -> DataFrame:
    """Per declared topic: match count, minimum, gap and the first three ids. One pass over the rows, no join with topics."""
    entries = F.array_compact(
        F.array(*[F.when(T.contains_any(F.col("__hay"), _terms(t)), F.lit(i)) for i, t in enumerate(topics)])
    )
    hits = ranked.withColumn("__hay", topic_haystack()).select(
        F.col(rank).alias("r"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.explode(entries).alias("t")
    )
    counts = hits.groupBy("t").agg(F.count(F.lit(1)).alias("count"))
    samples = (
        top_per_group(hits, ["t"], [F.col("r"), F.col("id")], 3, "k")
        .groupBy("t")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda s: s["id"]).alias("sample_ids"))
    )
    minimum = [t.min_posts or min_posts_per_topic for t in topics]
    declared = ranked.sparkSession.createDataFrame(
        [(i, t.topic_id, t.label, minimum[i]) for i, t in enumerate(topics)],
        "t int, topic_id string, label string, min_posts int",
    )
    joined = declared.join(counts, "t", "left").join(samples, "t", "left")
    n = F.coalesce("count", F.lit(0)).cast("long")
    return joined.select(
        F.col("t").alias("topic_order"),
        "topic_id",
        "label",
        n.alias("count"),
        "min_posts",
        F.greatest(F.col("min_posts") - n, F.lit(0)).cast("long").alias("gap"),
        F.coalesce("sample_ids", F.array().cast("array<string>")).alias("sample_ids"),
    )


def topic_hits(df: DataFrame, topics: DataFrame, *, row_id: str = "ord") -> DataFrame:
    """Pairs (``row_id``, topic_id) of a table of topics, one row a term: (topic_id, term). Any number of topics in one pass over the rows."""
    folded = topics.select("topic_id", T.casefold(F.col("term")).alias("term")).where(F.length(T.strip(F.col("term"))) > 0)
    folded = durable(folded.distinct(), "topic-terms")
    found = match_terms(df, topic_haystack(), folded, row_id=row_id)
    return found.join(folded, "term").select(row_id, "topic_id").distinct()


def annotate_table(df: DataFrame, topics: DataFrame, *, row_id: str = "ord") -> DataFrame:
    """:func:`annotate` for a table of topics (topic_id, label, position, term): ``coverage_topics`` in order of position."""
    names = topics.groupBy("topic_id").agg(F.min("position").alias("position"), F.min_by("label", "position").alias("label"))
    found = topic_hits(df, topics, row_id=row_id).join(names, "topic_id")
    lists = found.groupBy(row_id).agg(F.sort_array(F.collect_list(F.struct("position", "topic_id", "label"))).alias("__found"))
    lists = lists.select(F.col(row_id).alias("__row"), F.transform("__found", lambda t: F.struct(t["topic_id"].alias("topic_id"), t["label"].alias("label"))).alias("__found"))
    old = F.col("coverage_topics") if "coverage_topics" in df.columns else F.lit(None)
    return df.join(lists, F.col(row_id) == F.col("__row"), "left").withColumn("coverage_topics", F.coalesce("__found", old)).drop("__row", "__found")


def report_table(ranked: DataFrame, topics: DataFrame, *, min_posts_per_topic: int = 1, row_id: str = "ord", rank: str = "rank") -> DataFrame:
    """:func:`report` for a table of topics (topic_id, label, position, term and, where a topic has its own, min_posts)."""
    own = F.min("min_posts") if "min_posts" in topics.columns else F.lit(None)
    declared = topics.groupBy("topic_id").agg(
        F.min("position").alias("topic_order"), F.min_by("label", "position").alias("label"), F.coalesce(own, F.lit(min_posts_per_topic)).cast("int").alias("min_posts")
    )
    hits = topic_hits(ranked, topics, row_id=row_id).join(
        ranked.select(F.col(row_id), F.col(rank).alias("r"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id")), row_id
    )
    counts = hits.groupBy("topic_id").agg(F.count(F.lit(1)).alias("count"))
    samples = top_per_group(hits, ["topic_id"], [F.col("r"), F.col("id")], 3, "k").groupBy("topic_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda s: s["id"]).alias("sample_ids")
    )
    n = F.coalesce("count", F.lit(0)).cast("long")
    return declared.join(counts, "topic_id", "left").join(samples, "topic_id", "left").select(
        "topic_order", "topic_id", "label", n.alias("count"), "min_posts", F.greatest(F.col("min_posts") - n, F.lit(0)).cast("long").alias("gap"),
        F.coalesce("sample_ids", F.array().cast("array<string>")).alias("sample_ids"),
    )


def follow_ups(
    spark: SparkSession,
    topics: Sequence[Topic],
    languages: Sequence[str | None],
    *,
    objective: str = "",
    first_query: str = "",
    target_posts: int = 100,
    intent: str = "mission",
) -> DataFrame:
    """Every possible follow-up query of the declared topics, in (topic, query, language) order. Configuration-sized.

    A topic without queries of its own asks for the objective (or the mission's first query) together with its label.
    """
    declared = spark.createDataFrame(
        [(i, t.topic_id, t.label, list(t.queries), t.probe_limit or probe_limit(target_posts)) for i, t in enumerate(topics)],
        "topic_order int, topic_id string, label string, queries array<string>, probe int",
    )
    label = T.strip(F.coalesce("label", F.lit("")))
    subject = F.coalesce(*[F.nullif(T.strip(F.lit(x or "")), F.lit("")) for x in (objective, first_query)], F.lit(""))
    told = F.contains(T.casefold(subject), T.casefold(label))
    general = F.when(told, subject).otherwise(T.strip(F.concat_ws(" ", subject, label)))
    asked = F.when(F.size("queries") > 0, F.col("queries")).otherwise(F.array(general))
    spoken = F.array(*[F.lit(x).cast("string") for x in (languages or (None,))])
    name = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.lit("topic"))
    each = declared.withColumn("slug", T.slugify(name)).select("*", F.posexplode(asked).alias("q", "text"))
    each = each.select("*", F.posexplode(spoken).alias("l", "spoken")).withColumn("input", T.strip(F.coalesce("text", F.lit(""))))
    each = each.where(F.length("input") > 0)
    return each.select(
        (F.row_number().over(Window.orderBy("topic_order", "q", "l")) - 1).alias("ord"),
        "topic_order",
        "topic_id",
        "slug",
        "input",
        F.nullif(T.strip("spoken"), F.lit("")).alias("lang"),
        "probe",
        F.concat(F.lit(f"{intent}:coverage:"), "slug").alias("intent"),
    )


def _query_key(input_: Column, lang: Column) -> list[Column]:
    folded = lambda c: T.casefold(T.strip(F.coalesce(c, F.lit(""))))
    return [folded(input_).alias("k_input"), folded(lang).alias("k_lang")]


def gap_queries(
    topic_report: DataFrame, follow: DataFrame, planned: DataFrame, *, max_queries: int = 4, declared: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """New queries for topics with a gap, within the budget, and the report marked with what blocked the rest.

    A reported topic that is not among the ``declared`` ids (by default: every reported one is) has no queries and is marked so.

    Planned queries (input, lang) are removed by an anti join; a key proposed twice stays with its first topic.
    """
    known = F.lit(True) if declared is None else F.col("topic_id").isin(*declared)
    gaps = topic_report.where("gap > 0").where(known).select("topic_order", "gap")
    keyed = follow.join(gaps, "topic_order").select("*", *_query_key(F.col("input"), F.col("lang")))
    taken = planned.select(*_query_key(F.col("input"), F.col("lang"))).distinct()
    fresh = keyed.join(taken, ["k_input", "k_lang"], "left_anti")
    first = Window.partitionBy("k_input", "k_lang").orderBy("ord")
    fresh = fresh.withColumn("__c", F.row_number().over(first)).where("__c = 1")
    # follow-ups are configuration, a few rows per topic, so one ordered window over them is bounded
    fresh = fresh.withColumn("n", F.row_number().over(Window.orderBy("ord")))
    picked = fresh.where(F.col("n") <= max_queries).withColumn(
        "k", F.row_number().over(Window.partitionBy("topic_order").orderBy("ord"))
    )
    number = F.lpad(F.col("n").cast("string"), 2, "0")
    suffix = F.when(F.col("lang").isNotNull(), F.concat(F.lit("-"), T.slugify(F.col("lang")))).otherwise(F.lit(""))
    queries = picked.select(
        F.concat(F.lit("gap"), number, F.lit("-"), F.col("slug"), suffix).alias("query_id"),
        "topic_id",
        "input",
        "lang",
        F.col("probe").alias("limit"),
        "intent",
        F.lit("coverage_gap_fill").alias("source_role"),
    )
    planned_n = picked.groupBy("topic_order").agg(F.count(F.lit(1)).alias("planned"))
    fresh_n = fresh.groupBy("topic_order").agg(F.min("n").alias("first_n"))
    ordered = topic_report.join(planned_n, "topic_order", "left").join(fresh_n, "topic_order", "left")
    spent = F.coalesce(
        F.sum(F.coalesce("planned", F.lit(0))).over(
            Window.orderBy("topic_order").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    marked = ordered.withColumn("spent", spent).select(
        *topic_report.columns,
        (F.coalesce("planned", F.lit(0)) > 0).alias("queryable"),
        F.coalesce("planned", F.lit(0)).cast("long").alias("planned_query_count"),
        F.when(F.col("gap") <= 0, F.lit(None))
        .when(F.col("spent") >= max_queries, F.lit("query_budget_exhausted"))
        .when(~known, F.lit("topic_not_declared"))
        .when(F.coalesce("planned", F.lit(0)) == 0, F.lit("no_new_followup_query"))
        .alias("blocked_reason"),
    )
    return queries, marked


def coverage_summary(marked: DataFrame, ranked_count: Column | int, target: int, max_queries: int) -> DataFrame:
    """One row over a marked report: gaps, queryable gaps, used and remaining budget, exhausted flag."""
    gap = F.col("gap") > 0
    n = F.lit(ranked_count) if isinstance(ranked_count, int) else ranked_count
    used = F.coalesce(F.sum("planned_query_count"), F.lit(0)).cast("long")
    agg = marked.agg(
        F.count_if(gap).alias("topic_gap_count"),
        F.count_if(gap & F.col("queryable")).alias("queryable_topic_gap_count"),
        used.alias("used_queries"),
    )
    target_gap = F.greatest(F.lit(target) - n, F.lit(0)).cast("long")
    return agg.select(
        "topic_gap_count",
        "queryable_topic_gap_count",
        (F.col("topic_gap_count") - F.col("queryable_topic_gap_count")).alias("unqueryable_topic_gap_count"),
        "used_queries",
        F.greatest(F.lit(max_queries) - F.col("used_queries"), F.lit(0)).cast("long").alias("remaining_queries"),
        ((F.col("used_queries") >= max_queries) & (F.col("topic_gap_count") > 0)).alias("query_budget_exhausted"),
        target_gap.alias("target_gap"),
        (target_gap > 0).alias("target_gap_report_only"),
    )


def expand_queries(queries: DataFrame, languages: DataFrame | Sequence[str]) -> DataFrame:
    """One copy of each search query per language; queries with a language of their own or another operation pass through.

    ``languages`` is a list or a one-column table of any length, joined to the queries that take part.
    """
    own = (F.col("operation") != "search") | (F.length("lang") > 0)
    if not isinstance(languages, DataFrame):
        languages = queries.sparkSession.createDataFrame([(x,) for x in languages], "lang string")
    spoken = languages.toDF("__lang").distinct().withColumn("__takes", F.lit(True))
    marked = queries.withColumn("__takes", ~F.coalesce(own, F.lit(False)))
    return marked.join(spoken, "__takes", "left").withColumn("lang", F.coalesce("lang", "__lang")).drop("__takes", "__lang")
