"""Selection steps over candidates: post filters, final rank, diversity caps, topic spread, concentration reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..plans.skew import durable, number_within, side_by_side, top_per_group
from . import noise
from . import topic_fit as tf
from .items import identifier


#: ids that may be broadcast as a filter
FEW = 1 << 22


@dataclass
class PostFiltered:
    survivors: DataFrame
    drop_counts: DataFrame
    staged: DataFrame


def post_filter(
    candidates: DataFrame,
    *,
    drop_noise: bool = False,
    require_query_match: bool = False,
    rules: tf.TopicRules = tf.TopicRules(),
    min_seen_in: int | None = None,
    drop_title_duplicates: bool = False,
    max_per_author: int | None = None,
) -> PostFiltered:
    """Noise, topic fit, seen-in, title duplicate and author cap, in this order; each row is dropped by the first stage it
    fails. With active topic rules the query-match fallback is off.

    Decisions are written with the row's ``candidate_key`` and ``first_ord``, which name it, and no other column; the rows themselves are joined to them
    afterwards, so a text moves only where the caller asks for it.
    """
    require_query_match = require_query_match and not rules.enabled
    none = F.array().cast("array<string>")
    stages: list[Column] = []
    if drop_noise or require_query_match:
        stages.append(
            noise.noise_reasons(
                text=F.coalesce("text", "title"),
                urls=F.col("urls"),
                kind=F.col("timeline_item_kind"),
                query_miss=(
                    (F.coalesce("query_token_count", F.lit(0)) > 0) & ~F.coalesce("query_found", F.lit(False))
                    if require_query_match
                    else None
                ),
                drop_retweets=drop_noise,
                drop_replies=drop_noise,
                drop_low_content=drop_noise,
            )
        )
    if rules.enabled:
        candidates = tf.evaluate(candidates, tf.candidate_parts(), rules)
        stages.append(F.col("topic_fit.drop_reasons"))
    if min_seen_in is not None:
        stages.append(F.when(F.col("seen_in_count") < min_seen_in, F.array(F.lit("seen_in"))).otherwise(none))
    staged = candidates.withColumns({f"__stage{i}": s for i, s in enumerate(stages)})
    first = none
    for i in reversed(range(len(stages))):
        first = F.when(F.size(f"__stage{i}") > 0, F.col(f"__stage{i}")).otherwise(first)
    groups = {}
    if drop_title_duplicates:
        groups["__title"] = T.title_key(F.col("title"))
    if max_per_author is not None:
        groups["__author"] = T.author_key(F.col("author"))
    named = ("candidate_key", "first_ord")
    staged = durable(staged.select(*named, first.alias("drop_reasons"), *[key.alias(name) for name, key in groups.items()]), "staged")
    kept = staged.where(F.size("drop_reasons") == 0)
    counts = [noise.reason_counts(staged, "drop_reasons")]
    alone = F.concat(F.lit("\0"), F.col("candidate_key"))  # rows without a key form a group of their own

    def rows_of(decided: DataFrame, how: str) -> DataFrame:
        few = decided.select(*[F.col(n).alias(f"__{n}") for n in named], *[c for c in decided.columns if c == "drop_reasons"])
        on = [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in named]
        return candidates.join(few, on, how).drop(*[f"__{n}" for n in named])

    def chosen_rows(chosen: DataFrame) -> DataFrame:
        # numbers that name one row each are few bytes, so up to some millions of them go to the rows instead of the rows through a shuffle
        if dict(candidates.dtypes)["first_ord"] == "bigint" and chosen.count() <= FEW:
            twice = staged.groupBy("first_ord").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR first_ord IS NULL")
            if twice.isEmpty():
                ids = F.broadcast(chosen.select(F.col("first_ord").alias("__first_ord")))
                return candidates.join(ids, F.col("first_ord") == F.col("__first_ord"), "left_semi")
        return rows_of(chosen, "left_semi")

    def over_cap(df: DataFrame, key: Column, cap: int, reason: str) -> DataFrame:
        sizes = df.where(key.isNotNull()).groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
        dropped = F.coalesce(F.sum(F.greatest(F.col("n") - cap, F.lit(0))), F.lit(0)).cast("long")
        return sizes.agg(dropped.alias("count")).where("count > 0").select(F.lit(reason).alias("reason"), "count")

    if drop_title_duplicates:
        key = F.col("__title")
        counts.append(over_cap(kept, key, 1, "title_duplicate"))
        kept = top_per_group(kept, [F.coalesce(key, alone)], [F.col("first_ord")], 1).drop("__rn")
    if max_per_author is not None:
        key = F.col("__author")
        counts.append(over_cap(kept, key, max_per_author, "author_cap"))
        kept = top_per_group(kept, [F.coalesce(key, alone)], [F.col("first_ord")], max_per_author).drop("__rn")
    survivors = chosen_rows(durable(kept.select(*named), "kept"))
    return PostFiltered(survivors, reduce(DataFrame.unionByName, counts), rows_of(staged, "inner"))


def drop_keywords(df: DataFrame, keywords: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Split on excluded keywords in title, text or author. Returns (kept, dropped)."""
    terms = [str(k).casefold() for k in keywords if str(k).strip()]
    hit = T.contains_any(T.casefold(T.joined(F.col("title"), F.col("text"), F.col("author"))), terms)
    marked = df.withColumn("__hit", hit)
    return marked.where(~F.col("__hit")).drop("__hit"), marked.where("__hit").drop("__hit")


def final_rank(scored: DataFrame, name: str = "rank") -> DataFrame:
    """1-based rank by falling score, falling seen-in count, published_at, id and first-seen order."""
    keyed = scored.withColumns(
        {
            "__a": F.lit(0.0) - F.col("quality_score"),
            "__b": -F.coalesce(F.col("seen_in_count"), F.lit(0)).cast("long"),
            "__c": F.coalesce(F.col("published_at").cast("string"), F.lit("")),
            "__d": F.coalesce(F.col("id").cast("string"), F.lit("")),
        }
    )
    order = ["__a", "__b", "__c", "__d"] + (["first_ord"] if "first_ord" in scored.columns else [])
    return number_within(keyed, [], order, position=name).drop("__a", "__b", "__c", "__d")


# ---- diversity ---------------------------------------------------------------------------------------------------


def diversity_keys() -> dict[str, Column]:
    """Grouping keys of the three caps, in checking order."""
    folded = lambda c: T.author_key(c)  # noqa: E731  trimmed, folded, empty to null
    return {
        "author_diversity": folded(F.col("author")),
        "thread_diversity": folded(identifier("conversation_id")),
        "url_diversity": folded(F.coalesce(F.nullif(F.col("canonical_url"), F.lit("")), F.col("url"))),
    }


#: open rows that one round folds in rank order
FOLD_ROWS = 4096


def _fold_first(state: DataFrame, active: dict[str, int]) -> DataFrame:
    """``state`` with its first :data:`FOLD_ROWS` open rows decided by one walk in rank order.

    All rows before the last of them are decided, so the walk needs no more than how many kept rows stand before each of them in each of its groups; those
    counts come from a join with the narrow block (a group has at most ``cap`` kept rows) and the block's own kept rows are added on the way.
    """
    spark, names = state.sparkSession, list(active)
    block = state.where("status = 'open'").select("r", *names).orderBy("r").limit(FOLD_ROWS)
    rows = block.collect()
    if not rows:
        return state
    small, kept, carried = F.broadcast(spark.createDataFrame(rows, block.schema)), state.where("status = 'kept'"), {}
    counts = None
    for name in names:
        met = kept.select(F.col("r").alias("kr"), name).join(small.select("r", name), name).where("kr < r")
        part = met.groupBy("r").agg(F.count(F.lit(1)).alias("n")).select("r", F.lit(name).alias("name"), "n")
        counts = part if counts is None else counts.unionByName(part)
    for found in counts.collect():  # at most a row per block row and cap
        carried[found["r"], found["name"]] = found["n"]
    used: dict[tuple[str, str], int] = {}
    decided = []
    for row in rows:
        groups = [(n, row[n]) for n in names if row[n] is not None]
        fits = all(carried.get((row["r"], n), 0) + used.get((n, v), 0) < active[n] for n, v in groups)
        if fits:
            for group in groups:
                used[group] = used.get(group, 0) + 1
        decided.append((row["r"], "kept" if fits else "dropped"))
    schema = StructType([block.schema["r"], StructField("decided", StringType())])
    joined = state.join(F.broadcast(spark.createDataFrame(decided, schema)), "r", "left")
    return joined.select("r", *names, F.coalesce("decided", "status").alias("status"))


def apply_diversity(ranked: DataFrame, caps: dict[str, int | None], rank: str = "rank") -> tuple[DataFrame, DataFrame]:
    """Greedy caps in rank order where a dropped row uses up no other cap. Returns (kept, dropped with ``reason``).

    Distributed rounds, exact at any size: among the rows not yet dropped, one that lies within the first ``cap`` of each of
    its groups is certainly kept; once a group's first ``cap`` rows are all kept, its later rows are certainly dropped. The
    first rows that are still open then are walked in rank order, so chains of rows that wait for each other take a round per
    :data:`FOLD_ROWS` rows and not one per link. Only narrow key columns move.
    """
    keys = diversity_keys()
    active = {n: c for n, c in caps.items() if c is not None and n in keys}
    if not active:
        return ranked, ranked.withColumn("reason", F.lit("")).limit(0)
    table = durable(ranked.select(F.col(rank).alias("r"), *[keys[n].alias(n) for n in active]), "caps")
    if len(active) == 1:
        ((name, cap),) = active.items()
        inside = top_per_group(table, [F.coalesce(name, F.concat(F.lit("\0"), F.col("r").cast("string")))], [F.col("r")], cap)
        kept_ids = durable(inside.select("r"), "kept")
    else:
        state = table.withColumn("status", F.lit("open"))
        while True:
            safe, full = state, None
            for name, cap in active.items():
                heads = top_per_group(
                    state.where(F.col(name).isNotNull() & (F.col("status") != "dropped")).select("r", name, "status"),
                    [name],
                    [F.col("r")],
                    cap,
                )
                heads = durable(heads, "heads")
                inside = heads.select("r", F.lit(True).alias(f"in_{name}"))
                closed = (
                    heads.groupBy(name)
                    .agg(F.count_if(F.col("status") == "kept").alias("n"), F.max("r").alias(f"last_{name}"))
                    .where(F.col("n") >= cap)
                    .drop("n")
                )
                safe = safe.join(inside, "r", "left").join(closed, name, "left")
            ok, over = F.lit(True), F.lit(False)
            for name in active:
                ok = ok & (F.col(name).isNull() | F.coalesce(F.col(f"in_{name}"), F.lit(False)))
                over = over | F.coalesce(F.col("r") > F.col(f"last_{name}"), F.lit(False))
            status = (
                F.when(F.col("status") != "open", F.col("status"))
                .when(over, F.lit("dropped"))
                .when(ok, F.lit("kept"))
                .otherwise(F.lit("open"))
            )
            state = durable(safe.select("r", *active, status.alias("status")), "diversity")
            if state.where("status = 'open'").isEmpty():
                break
            state = _fold_first(state, active)
        kept_ids = state.where("status = 'kept'").select("r")
    dropped = table.join(kept_ids, "r", "left_anti")
    # the reported reason is the first cap, in checking order, that earlier kept rows had used up
    kept_rows = table.join(kept_ids, "r", "left_semi")
    reason = F.lit(None).cast("string")
    for name, cap in reversed(list(active.items())):
        last = (
            top_per_group(kept_rows.where(F.col(name).isNotNull()).select("r", name), [name], [F.col("r")], cap)
            .groupBy(name)
            .agg(F.max("r").alias(f"last_{name}"), F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= cap)
            .drop("n")
        )
        dropped = dropped.join(last, name, "left")
        reason = F.when(F.coalesce(F.col("r") > F.col(f"last_{name}"), F.lit(False)), F.lit(name)).otherwise(reason)
    dropped = dropped.select(F.col("r").alias(rank), reason.alias("reason"))
    return (
        ranked.join(kept_ids.withColumnRenamed("r", rank), rank, "left_semi"),
        ranked.join(dropped, rank),
    )


# ---- topic spread ------------------------------------------------------------------------------------------------


def _picked(pool: Column, topics: list[str], target: int) -> Column:
    """Chosen entries of an array of (rank, identity, topics, in_original) in rank order: one per uncovered topic first, then by rank."""

    def has(entries: Column, test) -> Column:
        return F.exists(entries, test)

    def for_topic(chosen: Column, topic: Column) -> Column:
        free = F.filter(pool, lambda p: F.array_contains(p["topics"], topic) & ~has(chosen, lambda c: c["identity"] == p["identity"]))
        done = (F.size(chosen) >= target) | has(chosen, lambda c: F.array_contains(c["topics"], topic))
        return F.when(done, chosen).otherwise(F.concat(chosen, F.slice(free, 1, 1)))

    def fill(chosen: Column, entry: Column) -> Column:
        done = (F.size(chosen) >= target) | has(chosen, lambda c: c["identity"] == entry["identity"])
        return F.when(done, chosen).otherwise(F.concat(chosen, F.array(entry)))

    declared = F.array(*[F.lit(t) for t in topics])
    return F.aggregate(pool, F.aggregate(declared, F.slice(pool, 1, 0), for_topic), fill)


def topic_spread(
    ranked: DataFrame, topics: Sequence[str], target: int, *, requested: bool = True, rank: str = "rank"
) -> tuple[DataFrame, DataFrame]:
    """Spread the selection over declared topics. Returns (selected rows with ``position``, one-row diagnostics).

    The sequential choice only ever looks at the first rows of each topic and the first rows overall: with T topics at most
    T - 1 rows can be used up before a topic's turn. That pool is cut out with group limits, so the grouped step below is
    bounded by T * T + 2 * target + T rows for any table size.
    """
    topics = list(dict.fromkeys(str(t) for t in topics))
    head = ranked.where(F.col(rank) <= target) if target > 0 else ranked.limit(0)
    declared = F.array(*[F.lit(t) for t in topics]).cast("array<string>")
    names = F.array_intersect(
        F.coalesce(F.transform("coverage_topics", lambda t: t["topic_id"]), F.array().cast("array<string>")), declared
    )
    filled = lambda n: F.when(F.length(T.strip(F.col(n))) > 0, F.concat(F.lit(f"{n}:"), F.col(n)))
    identity = F.coalesce(
        *[filled(n) for n in ("id", "source_item_id", "canonical_url", "url")], F.concat(F.lit("row:"), F.col(rank))
    )
    narrow = durable(ranked.select(F.col(rank).alias("rank"), identity.alias("identity"), names.alias("topics")), "spread")
    available = [r[0] for r in narrow.select(F.explode("topics").alias("t")).distinct().collect()]  # at most T values
    skip = None
    if not requested:
        skip = "not_requested"
    elif target <= 0:
        skip = "skipped_no_target"
    elif not topics:
        skip = "skipped_no_topics"
    elif narrow.isEmpty():
        skip = "skipped_no_candidates"
    elif not available:
        skip = "skipped_no_matches"
    if skip:
        # the early exits report no availability, only the declared topics
        empty = F.array().cast("array<string>")
        diag = ranked.sparkSession.range(1).select(
            F.lit(skip).alias("status"),
            F.lit(0).alias("available_topic_count"),
            empty.alias("selected_topic_ids"),
            declared.alias("unavailable_topic_ids"),
            empty.alias("unselected_available_topic_ids"),
            F.lit(0).alias("promoted_count"),
            F.lit(False).alias("reordered"),
        )
        return number_within(head, [], [rank], position="position"), diag
    per_topic = (
        narrow.select("rank", "identity", F.explode("topics").alias("topic"))
        .groupBy("topic", "identity")
        .agg(F.min("rank").alias("rank"))
    )
    heads = top_per_group(per_topic, ["topic"], [F.col("rank")], len(topics), "k").select("rank")
    fill = narrow.groupBy("identity").agg(F.min("rank").alias("rank")).orderBy("rank").limit(target + len(topics)).select("rank")
    first = narrow.orderBy("rank").limit(target).select("rank", F.lit(True).alias("in_original"))
    wanted = heads.unionByName(fill).unionByName(first.select("rank")).distinct()
    pool = (
        narrow.join(F.broadcast(wanted), "rank", "left_semi")
        .join(F.broadcast(first), "rank", "left")
        .fillna(False, ["in_original"])
    )
    entry = F.struct("rank", "identity", "topics", "in_original")
    one = pool.groupBy().agg(F.sort_array(F.collect_list(entry)).alias("pool"))
    one = one.select("pool", _picked(F.col("pool"), topics, target).alias("chosen"))
    names_of = lambda c: F.transform(c, lambda e: e["identity"])
    on_offer = F.array(*[F.lit(t) for t in available])
    got = F.filter(declared, lambda t: F.exists("chosen", lambda c: F.array_contains(c["topics"], t)))
    before, now = names_of(F.filter("pool", lambda e: e["in_original"])), names_of(F.col("chosen"))
    moved = now != F.slice(before, F.lit(1), F.greatest(F.size(now), F.lit(1)))
    diag = durable(
        one.select(
            "chosen",
            F.when(F.size(got) < min(len(available), target), "applied_partial").when(moved, "applied").otherwise("already_satisfied").alias("status"),
            F.lit(len(available)).alias("available_topic_count"),
            got.alias("selected_topic_ids"),
            F.array_except(declared, on_offer).alias("unavailable_topic_ids"),
            F.filter(declared, lambda t: F.array_contains(on_offer, t) & ~F.array_contains(got, t)).alias("unselected_available_topic_ids"),
            F.size(F.filter(now, lambda x: ~F.array_contains(before, x))).alias("promoted_count"),
            moved.alias("reordered"),
        ),
        "picked",
    )
    picked = diag.select(F.posexplode("chosen").alias("p", "e")).select((F.col("p") + 1).alias("position"), F.col("e.rank").alias("rank"))
    diag = diag.drop("chosen")
    chosen = picked.select(F.col("rank").alias(rank), "position")
    return ranked.join(F.broadcast(chosen), rank), diag


# ---- reports -----------------------------------------------------------------------------------------------------


def concentration(df: DataFrame, top: int = 5) -> DataFrame:
    """Unique, missing and most frequent keys for author, thread and URL: (dimension, kind, key, count)."""
    keys = diversity_keys()
    author = F.coalesce(T.author_key(identifier("author_handle")), T.author_key(F.col("author")), T.author_key(F.col("author_name")))
    dims = {"authors": author, "threads": keys["thread_diversity"], "urls": keys["url_diversity"]}
    entry = [F.struct(F.lit(n).alias("dimension"), k.alias("key")) for n, k in dims.items()]
    counts = durable(
        df.select(F.explode(F.array(*entry)).alias("e")).groupBy("e.dimension", "e.key").agg(F.count(F.lit(1)).alias("count")),
        "concentration",
    )
    totals = counts.groupBy("dimension").agg(
        F.count_if(F.col("key").isNotNull()).alias("unique"),
        F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("count"))), F.lit(0)).alias("missing"),
    )
    flat = totals.select(
        "dimension",
        F.explode(F.create_map(F.lit("unique"), F.col("unique"), F.lit("missing"), F.col("missing"))).alias("kind", "count"),
    ).select("dimension", "kind", F.lit(None).cast("string").alias("key"), "count")
    heads = top_per_group(counts.where(F.col("key").isNotNull()), ["dimension"], [F.desc("count"), F.col("key")], top)
    return flat.unionByName(heads.select("dimension", F.lit("top").alias("kind"), "key", "count"))


def time_spread(df: DataFrame) -> DataFrame:
    """(bucket, count, earliest, latest) per day (first 10 characters of the timestamp text)."""
    stamp = F.col("published_at").cast("string")
    return (
        df.where(F.length(stamp) > 0)
        .groupBy(F.left(stamp, F.lit(10)).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("count"), F.min(stamp).alias("earliest"), F.max(stamp).alias("latest"))
    )


def target_diagnostics(
    *, target: int, ranked: DataFrame, summary: DataFrame, filtered: DataFrame, drops: DataFrame, spread_status: str | None = None
) -> DataFrame:
    """One row: target, ranked, gap, status and the shortfall reasons."""
    drop_names = drops.where("count > 0").agg(F.collect_set("reason").alias("names"))  # a fixed set of reason codes
    one = side_by_side(
        ranked.agg(F.count(F.lit(1)).alias("ranked")),
        summary.select("candidate_count"),
        filtered.agg(F.count(F.lit(1)).alias("filtered_candidate_count")),
        drop_names,
    )
    gap = F.greatest(F.lit(target) - F.col("ranked"), F.lit(0))
    not_applied = spread_status not in (None, "not_requested", "already_satisfied", "applied")
    reasons = T.reason_list(
        ("collection_yield_below_target", F.col("candidate_count") < target),
        ("filters_dropped_candidates", F.size("names") > 0),
        ("topic_fit_filters_dropped_candidates", F.exists("names", lambda r: F.startswith(r, F.lit("topic_fit_")))),
        ("diversity_limits_dropped_candidates", F.exists("names", lambda r: F.endswith(r, F.lit("_diversity")))),
        ("post_filter_ranking_pool_larger_than_final_ranked", F.col("filtered_candidate_count") > F.col("ranked")),
        ("topic_spread_not_fully_applied", F.lit(not_applied)),
    )
    reasons = F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("insufficient_ranked_candidates")))
    return one.select(
        F.lit(target).cast("long").alias("target"),
        F.col("ranked").cast("long").alias("ranked"),
        gap.cast("long").alias("gap"),
        F.when(gap == 0, F.lit("met")).otherwise(F.lit("short")).alias("status"),
        F.when(gap == 0, F.array().cast("array<string>")).otherwise(reasons).alias("reasons"),
        F.col("candidate_count").cast("long").alias("candidate_count"),
        F.col("filtered_candidate_count").cast("long").alias("filtered_candidate_count"),
    )
