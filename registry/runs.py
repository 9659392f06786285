"""Plan and execution-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftstone.functions.values import error_category, error_retryable, throttle_sensitive
from siftstone.operators import batch
from siftstone.sources import ledger

from .base import query

_LOG_SQL = """log AS (SELECT event_id, concat('q', CAST(event_id AS VARCHAR)) AS query_id, ts, event_type,
 CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'skipped' ELSE 'ok' END AS status,
 CASE WHEN event_type IN ('error', 'signup') THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS count, floor(value * 8) / 8 AS wait,
 event_type = 'error' AND event_id % 2 = 0 AS throttle, CASE WHEN event_id % 3 = 0 THEN 'gap' WHEN event_id % 3 = 1 THEN 'broad' END AS source_role,
 CAST(user_id AS VARCHAR) AS url FROM events)"""


def log(t):
    e, kind, n = t.events, F.col("event_type"), F.col("event_id")
    code = F.when(kind == "error", F.when(n % 2 == 0, "http_429").otherwise("parse_failed"))
    staged = e.select(
        "event_id",
        F.concat(F.lit("q"), n.cast("string")).alias("query_id"),
        F.lit("web").alias("channel"),
        F.when(n % 5 == 0, "user_posts").otherwise("search").alias("operation"),
        F.concat(F.lit("input "), F.col("user_id").cast("string")).alias("input"),
        F.col("ts").alias("finished_at"),
        F.when(kind == "error", "error").when(kind == "signup", "skipped").otherwise("ok").alias("status"),
        F.when(kind == "signup", "throttle_guard").alias("reason"),
        F.when(kind.isin("error", "signup"), F.lit(0)).otherwise(F.floor("value").cast("bigint")).alias("count"),
        (F.floor(F.col("value") * 8) / 8).alias("applied_wait_seconds"),
        F.when(n % 3 == 0, "gap").when(n % 3 == 1, "broad").alias("source_role"),
        F.lit("research").alias("intent"),
        F.array(F.col("user_id").cast("string")).alias("urls"),
        code.alias("error_code"),
        F.when(kind == "error", F.lit("upstream said no")).alias("error_message"),
        kind.alias("event_type"),
    )
    category = F.when(F.col("error_code").isNotNull(), error_category(F.col("error_code"), F.col("error_message")))
    staged = staged.withColumn("error_category", category)
    return staged.withColumns(
        {
            "error_retryable": error_retryable(F.col("error_category")),
            "ok": F.col("status") != "error",
            "throttle_sensitive": (F.col("status") == "error")
            & throttle_sensitive(F.col("error_category"), F.col("error_code"), F.col("error_message")),
        }
    )


@query("batch_summary", f"""WITH {_LOG_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'error') AS errors,
 count(*) FILTER (WHERE status = 'skipped') AS skipped, CAST(sum(count) AS BIGINT) AS items, count(*) FILTER (WHERE wait > 0) AS waits_applied,
 round(sum(wait), 2) AS total_wait_seconds, count(*) FILTER (WHERE throttle) AS throttle_sensitive_errors, bool_or(status = 'skipped') AS throttle_guard_triggered,
 count(DISTINCT url) AS unique_urls, count(*) - count(DISTINCT url) AS duplicate_urls FROM log""")
def batch_summary(t):
    return batch.batch_summary(log(t)).withColumn("total_wait_seconds", F.round("total_wait_seconds", 2))


@query("pacing_summary", f"""WITH {_LOG_SQL} SELECT count(*) FILTER (WHERE wait > 0) AS waits_applied, round(sum(wait), 2) AS total_wait_seconds,
 count(*) FILTER (WHERE throttle) AS throttle_sensitive_errors, bool_or(status = 'skipped') AS throttle_guard_triggered FROM log""")
def pacing_summary(t):
    return batch.pacing_summary(log(t)).withColumn("total_wait_seconds", F.round("total_wait_seconds", 2))


@query("combined_batches", f"""WITH {_LOG_SQL} SELECT 2 * count(*) AS total, 2 * CAST(sum(count) AS BIGINT) AS items, count(DISTINCT url) AS unique_urls,
 2 * count(*) - count(DISTINCT url) AS duplicate_urls FROM log""")
def combined_batches(t):
    both = log(t).unionByName(log(t).withColumn("source_role", F.lit("coverage_gap_fill")))
    return batch.batch_summary(both).select("total", "items", "unique_urls", "duplicate_urls")


@query("source_roles", f"WITH {_LOG_SQL} SELECT source_role, count(*) AS count FROM log WHERE source_role IS NOT NULL GROUP BY 1")
def source_roles(t):
    return batch.source_roles(log(t))


@query("plan_summary", """SELECT 'channel' AS dimension, 'web' AS value, count(*) AS count FROM events UNION ALL
SELECT 'operation', CASE WHEN event_id % 5 = 0 THEN 'user_posts' ELSE 'search' END, count(*) FROM events GROUP BY 2 UNION ALL
SELECT 'intent', 'research', count(*) FROM events UNION ALL
SELECT 'source_role', CASE WHEN event_id % 3 = 0 THEN 'gap' ELSE 'broad' END, count(*) FROM events WHERE event_id % 3 < 2 GROUP BY 2""")
def plan_summary(t):
    return batch.plan_summary(log(t))


@query("checkpoint_summaries", f"""WITH {_LOG_SQL}, c AS (SELECT row_number() OVER w AS completed, count(*) FILTER (WHERE status = 'ok') OVER w AS ok, count(*) FILTER (WHERE status = 'error') OVER w AS errors,
  count(*) FILTER (WHERE status = 'skipped') OVER w AS skipped, CAST(sum(count) OVER w AS BIGINT) AS items, count(*) FILTER (WHERE throttle) OVER w AS throttle_sensitive_errors
  FROM log WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT * FROM c WHERE completed % 100 = 0""")
def checkpoint_summaries(t):
    return batch.checkpoint_summaries(log(t), ["finished_at", "event_id"], 100)


@query("query_yield", f"""WITH {_LOG_SQL} SELECT query_id, status, count, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'rate_limited' ELSE 'parse_error' END END AS error_category,
 throttle AS throttle_sensitive, 1 AS url_count FROM log""")
def query_yield(t):
    return batch.query_yield(log(t)).select("query_id", "status", "count", "error_category", "throttle_sensitive", "url_count")


@query("error_code_counts", f"""WITH {_LOG_SQL} SELECT CASE WHEN event_id % 2 = 0 THEN 'http_429' ELSE 'parse_failed' END AS error_code, event_id % 2 = 0 AS retryable, count(*) AS n
FROM log WHERE status = 'error' GROUP BY ALL""")
def error_code_counts(t):
    failed = log(t).where("status = 'error'")
    return failed.groupBy("error_code", F.col("error_retryable").alias("retryable")).agg(F.count(F.lit(1)).alias("n"))


_DONE = "o_orderkey % 3 <> 0"


@query("resume_anti_join", f"""WITH done AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE {_DONE})
SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.o_custkey = o.o_custkey AND d.o_orderpriority = o.o_orderpriority)""")
def resume_anti_join(t):
    o = t.orders
    text = F.concat(F.lit("customer "), F.col("o_custkey").cast("string"))
    plan = o.select("o_orderkey", F.lit("web").alias("channel"), F.lit("search").alias("operation"), text.alias("input"), F.col("o_orderpriority").alias("intent"))
    given = F.array(F.lit("retweets"), F.lit("links"), F.lit("replies"))
    # the log recorded defaults (search type and two excludes) that the plan leaves out or spells in part
    plan = plan.withColumns(
        {
            "search_type": F.lit(None).cast("string"),
            "exclude": F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("links"))).otherwise(F.array(F.lit("links"), F.lit("replies"))),
            "quality_profile": F.lit("balanced"),
        }
    )
    done = o.where(_DONE).select(
        F.lit("web").alias("channel"), F.lit("search").alias("operation"), text.alias("input"), F.col("o_orderpriority").alias("intent"),
        F.lit("top").alias("search_type"), given.alias("exclude"), F.lit("balanced").alias("quality_profile"),
        F.array(F.lit("search_type"), F.lit("exclude")).alias("defaulted_fields"), (F.col("o_orderstatus") != "F").alias("ok"),
    )
    return batch.pending_queries(plan, done).select("o_orderkey")


@query("resume_only_ok", f"""WITH done AS (SELECT DISTINCT o_custkey FROM orders WHERE {_DONE} AND o_orderstatus <> 'F')
SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.o_custkey = o.o_custkey)""")
def resume_only_ok(t):
    text = F.concat(F.lit("customer "), F.col("o_custkey").cast("string"))
    plan = t.orders.select("o_orderkey", F.lit("web").alias("channel"), text.alias("input"))
    done = t.orders.where(_DONE).select(
        F.lit("web").alias("channel"), text.alias("input"), F.array().cast("array<string>").alias("defaulted_fields"), (F.col("o_orderstatus") != "F").alias("ok")
    )
    return batch.pending_queries(plan, done, only_ok=True).select("o_orderkey")


@query("resume_from_ledger", """WITH done AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 7 > 1)
SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.o_custkey = o.o_custkey AND d.o_orderpriority = o.o_orderpriority
 AND o.o_custkey % 2 = 0 AND (o.o_orderkey % 2 = 0 OR o.o_custkey % 3 = 2))""")
def resume_from_ledger(t):
    """Plan queries that no ledger line of an earlier run answers, by the defaults each line recorded and its own quality profile."""
    o, n, c = t.orders, F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat(F.lit("customer "), c.cast("string"))
    profile = F.when(c % 3 == 0, "precision").when(c % 3 == 1, "balanced").otherwise("recall")
    given = F.when(c % 3 == 2, F.array(F.lit("links"))).otherwise(F.array(F.lit("retweets"), F.lit("links"), F.lit("replies")))
    meta = F.struct(
        text.alias("input"),
        F.lit(50).alias("requested_limit"),
        profile.alias("quality_profile"),
        F.lit("top").alias("search_type"),
        F.lit(280).alias("item_text_max_chars"),
        given.alias("exclude"),
        # a default that the field no longer has stays part of the query
        F.struct(F.when(c % 2 == 0, "top").otherwise("latest").alias("search_type"), F.lit(280).alias("item_text_max_chars"), given.alias("exclude")).alias("applied_defaults"),
    )
    result = F.struct((F.col("o_orderstatus") != "F").alias("ok"), F.lit("web").alias("channel"), F.lit("search").alias("operation"), meta.alias("meta"))
    kind = F.when(n % 7 == 1, "note").otherwise("collection_result")
    line = F.to_json(F.struct(kind.alias("record_type"), F.lit("web").alias("channel"), F.col("o_orderpriority").alias("intent"), result.alias("result")))
    line = F.when(n % 7 == 0, F.substring(line, 1, 40)).otherwise(line)
    lines = o.where(_DONE).select(line.alias("value"), F.lit("run.jsonl").alias("file"), F.lit(0).cast("bigint").alias("block_start"), n.alias("seq"))
    plan = o.select(
        "o_orderkey", F.lit("web").alias("channel"), F.lit("search").alias("operation"), text.alias("input"), F.lit(50).alias("limit"),
        F.col("o_orderpriority").alias("intent"), profile.alias("quality_profile"), F.when(n % 2 == 0, F.array(F.lit("links"))).alias("exclude"),
    )
    return batch.pending_queries(plan, ledger.executed_queries(ledger.parse(lines))).select("o_orderkey")
