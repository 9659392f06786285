"""Plan and execution-log operators: resume keys, pending queries, summaries, checkpoints."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.skew import number_within, side_by_side
from .noise import DEFAULT_EXCLUDES

# the fields that identify a query for resuming; query_id and source_role are deliberately not among them
KEY_FIELDS = (
    "channel operation input limit intent since until from_user to_user lang search_type has exclude min_likes "
    "min_retweets min_views originals_only topic_fit quality_profile raw_mode raw_max_bytes item_text_mode "
    "item_text_max_chars"
).split()
#: fixed values: the scalar fields a run may fill in by itself
DEFAULTABLE = ("search_type", "originals_only", "raw_mode", "item_text_mode", "item_text_max_chars")


def _key_part(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("string")
    kind = dict(df.dtypes)[name]
    if kind.startswith(("array", "map", "struct", "variant")):
        return F.to_json(F.col(name))
    if name == "topic_fit":
        # equal rules in any spelling and order of keys are one query
        return F.coalesce(F.to_json(F.try_parse_json(F.col(name).cast("string"))), F.col(name).cast("string"))
    return F.col(name).cast("string")


def query_key(df: DataFrame) -> Column:
    """Digest of the identity fields; null and missing are the same, arrays keep their order, ``topic_fit`` is compared as JSON."""
    return F.sha2(F.to_json(F.struct(*[_key_part(df, n).alias(n) for n in KEY_FIELDS]), {"ignoreNullFields": "false"}), 256)


def _was_default(completed: DataFrame, name: str, defaulted: str, applied: str) -> Column:
    """Whether the run filled in a field: by the value it recorded for it, or by the field's name alone where only names are recorded."""
    if applied in completed.columns:
        return F.coalesce(F.element_at(F.col(applied), name) == F.col(name).cast("string"), F.lit(False))
    return F.array_contains(F.coalesce(F.col(defaulted), F.array().cast("array<string>")), name)


def _exclude_variants(completed: DataFrame) -> Column:
    """The excludes of a finished query and all it may have been asked with, by the default excludes of its own quality profile.

    Without default excludes (no profile, or one that sets none) the query may have been asked with none at all.
    """
    values = F.col("exclude")
    profile = F.col("quality_profile") if "quality_profile" in completed.columns else F.lit(None).cast("string")

    def without(removed: list[str]) -> Column:
        return F.filter(values, lambda v: ~v.isin(*removed))

    variants = F.array(values, F.lit(None).cast("array<string>"))
    for name, defaults in DEFAULT_EXCLUDES.items():
        dropped = [c for size in range(len(defaults), 0, -1) for c in combinations(defaults, size)]
        variants = F.when(profile == name, F.array(values, *[without(list(c)) for c in dropped])).otherwise(variants)
    return variants


def resume_keys(completed: DataFrame, defaulted: str = "defaulted_fields", applied: str = "applied_defaults") -> DataFrame:
    """Keys a finished query may be resumed under.

    A run records the defaults it filled in, so the same query is also known without them: scalar defaults removed, and each way of leaving out default
    excludes of the row's quality profile (at most four variants with two default excludes). ``applied`` is a map from field to the value filled in, which
    counts only while the field still has that value; without such a column ``defaulted`` lists the names of the fields.
    """
    if applied not in completed.columns and defaulted not in completed.columns:
        return completed.select(query_key(completed).alias("query_key")).distinct()
    stripped = {n: F.when(~_was_default(completed, n, defaulted, applied), F.col(n)) for n in DEFAULTABLE if n in completed.columns}
    # each row as it is and without its defaults; one pass, as the rows may be parsed out of a ledger's lines
    both = completed
    if stripped:
        both = completed.withColumn("__bare", F.explode(F.array(F.lit(False), F.lit(True))))
        both = both.withColumns({n: F.when(F.col("__bare"), c).otherwise(F.col(n)) for n, c in stripped.items()}).drop("__bare")
    if "exclude" not in completed.columns:
        return both.select(query_key(both).alias("query_key")).distinct()
    filled = F.map_contains_key(F.col(applied), "exclude") if applied in completed.columns else F.array_contains(F.col(defaulted), "exclude")
    can_vary = F.coalesce(filled, F.lit(False)) & (F.coalesce(F.size("exclude"), F.lit(0)) > 0)
    varied = both.withColumn("exclude", F.explode(F.when(can_vary, _exclude_variants(completed)).otherwise(F.array("exclude"))))
    varied = varied.withColumn("exclude", F.when(F.size("exclude") > 0, F.col("exclude")))
    return varied.select(query_key(varied).alias("query_key")).distinct()


def pending_queries(plan: DataFrame, completed: DataFrame, *, only_ok: bool = False, defaulted: str = "defaulted_fields") -> DataFrame:
    """Plan queries not yet in the log, all columns kept. Failed queries count as finished unless ``only_ok``.

    ``completed`` may be a run's log or the queries a ledger holds (:func:`siftstone.sources.ledger.executed_queries`). The keys of a log are as many as its
    lines, and Spark's guess of their size, taken through the expressions that parse a line, is far too low: both sides are sorted, none is broadcast.
    """
    done = completed.where("ok") if only_ok else completed
    keyed = plan.withColumn("query_key", query_key(plan))
    return keyed.join(resume_keys(done, defaulted).hint("merge"), "query_key", "left_anti").drop("query_key")


def plan_summary(plan: DataFrame) -> DataFrame:
    """(dimension, value, count) over channel, operation, intent and source role."""
    dims = [F.struct(F.lit(n).alias("dimension"), F.col(n).cast("string").alias("value")) for n in ("channel", "operation", "intent", "source_role")]
    return (
        plan.select(F.explode(F.array(*dims)).alias("d"))
        .where(F.length("d.value") > 0)
        .groupBy("d.dimension", "d.value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def _status_counts() -> list[Column]:
    wait = F.coalesce(F.col("applied_wait_seconds"), F.lit(0.0))
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("items"),
        F.count_if(wait > 0).alias("waits_applied"),
        F.round(F.greatest(F.coalesce(F.sum(wait), F.lit(0.0)), F.lit(0.0)), 6).alias("total_wait_seconds"),
        F.count_if(F.col("throttle_sensitive")).alias("throttle_sensitive_errors"),
        F.coalesce(F.bool_or(F.col("reason") == "throttle_guard"), F.lit(False)).alias("throttle_guard_triggered"),
    ]


def batch_summary(log: DataFrame) -> DataFrame:
    """One row of run totals, with unique and duplicate URL counts over the exploded URL lists."""
    urls = log.select(F.explode("urls").alias("u")).where(F.length("u") > 0).groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    url_counts = urls.agg(
        F.count(F.lit(1)).alias("unique_urls"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_urls"),
    )
    return side_by_side(log.agg(*_status_counts()), url_counts)


def source_roles(log: DataFrame) -> DataFrame:
    return log.where(F.length("source_role") > 0).groupBy("source_role").agg(F.count(F.lit(1)).alias("count"))


def pacing_summary(log: DataFrame) -> DataFrame:
    return log.agg(*[c for c in _status_counts()[5:]])


def checkpoint_summaries(log: DataFrame, order: list[str], every: int) -> DataFrame:
    """Running totals after every n-th finished query, without a one-task window over the whole log."""
    one = lambda cond: F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("long")
    running = number_within(
        log,
        [],
        order,
        position="completed",
        running={
            "ok_total": one(F.col("status") == "ok"),
            "errors": one(F.col("status") == "error"),
            "skipped": one(F.col("status") == "skipped"),
            "items": F.coalesce(F.col("count"), F.lit(0)).cast("long"),
            "throttle_sensitive_errors": one(F.coalesce(F.col("throttle_sensitive"), F.lit(False))),
        },
    )
    return running.where(F.col("completed") % every == 0).select(
        "completed", F.col("ok_total").alias("ok"), "errors", "skipped", "items", "throttle_sensitive_errors"
    )


def query_yield(log: DataFrame) -> DataFrame:
    """One report row per executed query."""
    wanted = (
        "query_id input channel operation source_role status ok count error_code error_category error_retryable "
        "started_at finished_at duration_seconds planned_wait_seconds applied_wait_seconds throttle_sensitive"
    ).split()
    return log.select(*[c for c in wanted if c in log.columns], F.coalesce(F.size("urls"), F.lit(0)).alias("url_count"))
