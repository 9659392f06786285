"""Ledger queries over JSON lines that Spark derives from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftstone.operators import dedupe
from siftstone.sources import ledger

from .base import KIND, query

_GOOD = "event_id % 20 > 3"


def lines(t):
    """One ledger line per event: most are records, some are blank, malformed, arrays or foreign objects."""
    n, null = F.col("event_id"), F.lit(None).cast("string")
    number = n.cast("string")
    failed = F.col("event_type") == "error"
    item = lambda tag: F.struct(
        F.concat(F.lit(tag), number).alias("id"),
        F.concat(F.lit("https://example.com/"), F.lit(tag), number).alias("url"),
        F.concat(F.lit("text of "), number).alias("text"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("author"),
        F.struct(F.expr(KIND).alias("timeline_item_kind")).alias("extras"),
        F.struct(F.floor(F.col("value") * 10).alias("likes")).alias("engagement"),
    )
    both = F.array(item("a"), item("b"))
    items = F.filter(both, lambda i: (~failed) & (F.startswith(i["id"], F.lit("a")) | (n % 3 == 0)))
    meta = F.struct(
        F.when(n % 4 == 0, "none").alias("raw_mode"),
        F.when(n % 5 == 0, "from-meta").alias("source_role"),
        F.struct((n % 3).alias("promo_phrase"), F.lit("n/a").alias("bad")).alias("filter_drop_counts"),
        F.struct((n % 6 == 0).alias("unbounded_time_window")).alias("diagnostics"),
        F.lit(1).alias("attempt"),
    )
    record = F.struct(
        F.lit("collection_result").alias("record_type"),
        F.concat(F.lit("run-"), (n % 3).cast("string")).alias("run_id"),
        F.when(n % 2 == 0, "web").otherwise("feed").alias("channel"),
        F.lit("search").alias("operation"),
        F.concat(F.lit("q"), (F.col("user_id") % 10).cast("string")).alias("input"),
        (~failed).alias("ok"),
        F.size(items).alias("count"),
        F.when(failed, "http_429").alias("error_code"),
        F.when(n % 4 != 1, F.concat(F.lit("intent-"), (n % 3).cast("string"))).alias("intent"),
        null.alias("query_id"),
        null.alias("source_role"),
        F.struct(
            (~failed).alias("ok"),
            F.when(n % 2 == 0, "web").otherwise("feed").alias("channel"),
            F.lit("search").alias("operation"),
            items.alias("items"),
            F.when(n % 4 != 0, F.parse_json("props")).alias("raw"),
            meta.alias("meta"),
            F.when(failed, F.struct(F.lit("http_429").alias("code"))).alias("error"),
        ).alias("result"),
    )
    good = F.to_json(record, {"ignoreNullFields": "false"})
    value = (
        F.when(n % 20 == 0, "  ")
        .when(n % 20 == 1, F.concat(F.lit('{"oops": '), number))
        .when(n % 20 == 2, F.concat(F.lit("["), number, F.lit("]")))
        .when(n % 20 == 3, F.concat(F.lit('{"record_type":"note","n":'), number, F.lit("}")))
        .otherwise(good)
    )
    file = F.concat(F.lit("shard-"), (n % 4).cast("string"), F.lit(".jsonl"))
    return t.events.select(value.alias("value"), file.alias("file"), F.lit(0).cast("bigint").alias("block_start"), n.alias("seq"))


_REC = f"""r AS (SELECT event_id AS n, CASE WHEN event_id % 2 = 0 THEN 'web' ELSE 'feed' END AS channel, event_type = 'error' AS failed,
  CASE WHEN event_type = 'error' THEN 0 WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS items, {KIND} AS kind, user_id, value, props,
  CASE WHEN event_id % 4 <> 1 THEN concat('intent-', CAST(event_id % 3 AS VARCHAR)) END AS intent,
  CASE WHEN event_id % 5 = 0 THEN 'from-meta' END AS source_role,
  CASE WHEN event_id % 4 = 0 THEN 0 ELSE length(replace(props, ' ', '')) END AS raw_size FROM events WHERE {_GOOD})"""


@query("ledger_health", f"""WITH {_REC}, o AS (
 SELECT 'total' AS section, CASE WHEN event_id % 20 = 0 THEN 'empty_lines' WHEN event_id % 20 = 1 THEN 'invalid_lines' WHEN event_id % 20 IN (2, 3) THEN 'invalid_records' ELSE 'records_scanned' END AS key, 1 AS n FROM events
 UNION ALL SELECT 'total', 'records', 1 FROM r UNION ALL SELECT 'total', CASE WHEN failed THEN 'error_records' ELSE 'ok_records' END, 1 FROM r
 UNION ALL SELECT 'total', 'items_seen', items FROM r UNION ALL SELECT 'total', 'raw_payload_bytes_total', raw_size FROM r
 UNION ALL SELECT 'total', 'item_text_chars_total', items * length(concat('text of ', CAST(n AS VARCHAR))) FROM r
 UNION ALL SELECT 'total', 'large_text_fields', 0 FROM r UNION ALL SELECT 'total', 'large_raw_payloads', 0 FROM r
 UNION ALL SELECT 'total', 'unbounded_time_window_records', (n % 6 = 0)::INT FROM r
 UNION ALL SELECT 'missing_metadata', 'records', 1 FROM r UNION ALL SELECT 'missing_metadata', 'query_id', 1 FROM r
 UNION ALL SELECT 'missing_metadata', 'intent', 1 FROM r WHERE intent IS NULL UNION ALL SELECT 'missing_metadata', 'source_role', 1 FROM r WHERE source_role IS NULL
 UNION ALL SELECT 'channel', channel, 1 FROM r UNION ALL SELECT 'operation', 'search', 1 FROM r UNION ALL SELECT 'error_code', 'http_429', 1 FROM r WHERE failed
 UNION ALL SELECT 'intent', intent, 1 FROM r WHERE intent IS NOT NULL UNION ALL SELECT 'source_role', source_role, 1 FROM r WHERE source_role IS NOT NULL
 UNION ALL SELECT 'raw_mode', CASE WHEN n % 4 = 0 THEN 'none' ELSE 'full' END, 1 FROM r
 UNION ALL SELECT 'item_text_mode', CASE WHEN failed THEN 'none' ELSE 'full' END, 1 FROM r
 UNION ALL SELECT 'timeline_item_kind', kind, items FROM r WHERE kind IS NOT NULL AND items > 0
 UNION ALL SELECT 'filter_drop_reason', 'promo_phrase', n % 3 FROM r
 UNION ALL SELECT 'total', 'files_checked', count(DISTINCT event_id % 4) FROM events
 UNION ALL SELECT 'total', 'valid', (count(*) FILTER (event_id % 20 IN (1, 2, 3)) = 0)::INT FROM events)
SELECT section, key, CAST(sum(n) AS BIGINT) AS count FROM o GROUP BY ALL""")
def ledger_health(t):
    return ledger.health(ledger.parse(lines(t)))


@query("ledger_health_filtered", f"""WITH {_REC} SELECT key, count FROM (SELECT 'records' AS key, count(*) AS count, 0 AS x FROM r WHERE channel = 'web' AND NOT failed
 UNION ALL SELECT 'items_seen', CAST(sum(items) AS BIGINT), 0 FROM r WHERE channel = 'web' AND NOT failed)""")
def ledger_health_filtered(t):
    found = ledger.health(ledger.parse(lines(t)), filters=["channel == web", "result.ok == true"])
    return found.where("section = 'total' AND key IN ('records', 'items_seen')").select("key", "count")


@query("ledger_valid_flag", "SELECT CAST(0 AS BIGINT) AS valid FROM (SELECT count(*) AS n FROM events) WHERE n > 0")
def ledger_valid_flag(t):
    found = ledger.health(ledger.parse(lines(t)), require_metadata=True)
    return found.where("key = 'valid'").select(F.col("count").alias("valid"))


@query("ledger_valid_clean", f"""WITH {_REC} SELECT CAST(count(*) > 0 AS BIGINT) AS valid FROM r""")
def ledger_valid_clean(t):
    """Only well-formed lines, one of their channels named like a problem counter."""
    good = lines(t).where(F.col("seq") % 20 > 3).withColumn("value", F.replace("value", F.lit('"channel":"web"'), F.lit('"channel":"invalid_lines"')))
    return ledger.health(ledger.parse(good)).where("section = 'total' AND key = 'valid'").select(F.col("count").alias("valid"))


@query("ledger_health_source_filter", f"""WITH {_REC} SELECT key, count FROM (SELECT 'records' AS key, count(*) AS count FROM r WHERE n % 4 = 2
 UNION ALL SELECT 'items_seen', CAST(sum(items) AS BIGINT) FROM r WHERE n % 4 = 2)""")
def ledger_health_source_filter(t):
    found = ledger.health(ledger.parse(lines(t)), filters=["source.file == shard-2.jsonl"])
    return found.where("section = 'total' AND key IN ('records', 'items_seen')").select("key", "count")


@query("ledger_query_totals", f"""WITH {_REC} SELECT (SELECT count(*) FROM events WHERE event_id % 20 > 2) AS scanned_records,
 (SELECT count(*) FROM r WHERE channel = 'feed') AS matched_records, (SELECT count(*) FROM events WHERE event_id % 20 = 1) AS invalid_lines""")
def ledger_query_totals(t):
    return ledger.query_totals(ledger.parse(lines(t)), ["channel == feed"])


@query("ledger_filter_big_ids", "SELECT event_id AS n FROM events WHERE event_id > 100 AND event_id <= 200 OR event_id = 7")
def ledger_filter_big_ids(t):
    """Ids of 19 digits, which doubles cannot tell apart, in lines that start with a tab."""
    ids = t.events.select(F.col("event_id").alias("seq"), (F.lit(1790000000000000000) + F.col("event_id")).alias("post"))
    made = ids.select(F.concat(F.lit('\t{"post":'), F.col("post").cast("string"), F.lit("}")).alias("value"), F.lit("a.jsonl").alias("file"), F.lit(0).cast("bigint").alias("block_start"), "seq")
    parsed = ledger.parse(made)
    some = ledger.query(parsed, filters=["post > 1790000000000000100", "post <= 1790000000000000200"])
    return some.unionByName(ledger.query(parsed, filters=["post == 1790000000000000007"])).select(F.col("seq").alias("n"))


@query("ledger_round_trip", f"""WITH {_REC} SELECT n FROM r""")
def ledger_round_trip(t):
    """What the append sink writes, the ledger scan reads."""
    import uuid

    from siftstone.plans.skew import scratch_folder

    base = f"{scratch_folder(t.spark)}/trip-{uuid.uuid4().hex}"
    records = ledger.parse(lines(t)).where("state = 'ok'").select(
        F.try_variant_get("rec", "$.result", "variant").alias("result"), F.col("seq").cast("string").alias("query_id")
    )
    ledger.append_records(ledger.build_records(records, "run-1"), base)
    back = ledger.parse(ledger.read_lines(t.spark, base)).where("state = 'ok'")
    return back.select(F.try_variant_get("rec", "$.query_id", "string").cast("bigint").alias("n"))


@query("ledger_summary", f"""WITH {_REC} SELECT 'records' AS key, count(*) AS count FROM r UNION ALL SELECT 'ok_records', count(*) FROM r WHERE NOT failed
 UNION ALL SELECT 'error_records', count(*) FROM r WHERE failed UNION ALL SELECT 'items_seen', CAST(sum(items) AS BIGINT) FROM r""")
def ledger_summary(t):
    return ledger.summary(ledger.parse(lines(t))).where("key IN ('records', 'ok_records', 'error_records', 'items_seen')").select("key", "count").where(
        "key <> 'records' OR count > 0"
    ).groupBy("key").agg(F.max("count").alias("count"))


@query("ledger_problem_samples", """WITH p AS (SELECT CASE WHEN event_id % 20 = 1 THEN 'invalid_line' WHEN event_id % 20 = 2 THEN 'not_object' WHEN event_id % 20 = 3 THEN 'invalid_record' ELSE 'missing_metadata' END AS problem,
  concat('shard-', CAST(event_id % 4 AS VARCHAR), '.jsonl') AS file, event_id AS seq FROM events WHERE event_id % 20 > 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY problem ORDER BY file, seq) AS k FROM p) SELECT problem, file, seq FROM r WHERE k <= 50""")
def ledger_problem_samples(t):
    return ledger.health_samples(ledger.parse(lines(t))).select("problem", "file", "seq")


@query("ledger_line_numbers", """SELECT concat('shard-', CAST(event_id % 4 AS VARCHAR), '.jsonl') AS file, event_id AS seq,
 row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS line FROM events""")
def ledger_line_numbers(t):
    return ledger.with_line_numbers(lines(t)).select("file", "seq", "line")


@query("ledger_file_lines", """SELECT event_id, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS line FROM events""")
def ledger_file_lines(t):
    """Lines of ledger files as written, numbered from their splits' counts."""
    import uuid

    from siftstone.plans.skew import scratch_folder

    base = f"{scratch_folder(t.spark)}/lines-{uuid.uuid4().hex}"
    shards = t.events.select((F.col("event_id") % 4).alias("shard"), "event_id", F.to_json(F.struct("event_id", "event_type", "props")).alias("value"))
    shards.repartition(4, "shard").sortWithinPartitions("shard", "event_id").select("shard", "value").write.partitionBy("shard").text(base)
    return ledger.read_lines(t.spark, base, numbered=True).select(F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), "line")


_FILTERS = {
    "ledger_filter_numbers": (["count >= 1", "result.meta.attempt != 5", "count < 2"], "items = 1"),
    "ledger_filter_equal": (["channel == feed", "ok == true", "result.items.0.author == user7"], "channel = 'feed' AND NOT failed AND user_id = 7"),
    "ledger_filter_null": (["error_code != null", "query_id == null"], "failed"),
    "ledger_filter_bool_number": (["result.ok == 1", "result.meta.attempt == true"], "NOT failed"),
    "ledger_filter_contains": (["result.meta contains attempt", 'intent contains "-1"'], "n % 4 <> 1 AND n % 3 = 1"),
    "ledger_filter_text_order": (["input > q5", "result.items.0.engagement.likes >= 30"], "user_id % 10 > 5 AND NOT failed AND floor(value * 10) >= 30"),
    "ledger_filter_list_contains": (["result.raw == {\"k\": 7}"], "n % 4 <> 0 AND CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) = 7"),
}


def _register_filters():
    for name, (filters, where) in _FILTERS.items():

        def run(t, filters=filters):
            return ledger.query(ledger.parse(lines(t)), filters=filters).select(F.col("seq").alias("n"))

        query(name, f"WITH {_REC} SELECT n FROM r WHERE {where}")(run)


_register_filters()


@query("ledger_query_limit", f"""WITH {_REC} SELECT n FROM r WHERE failed ORDER BY n % 4, n LIMIT 15""")
def ledger_query_limit(t):
    return ledger.query(ledger.parse(lines(t)), filters=["ok == false"], limit=15).select(F.col("seq").alias("n"))


@query("ledger_query_source", """WITH l AS (SELECT event_id AS n, event_id % 4 AS f, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS line FROM events)
SELECT n FROM l WHERE f = 2 AND line <= 100 AND n % 20 > 2""")
def ledger_query_source(t):
    numbered = ledger.parse(ledger.with_line_numbers(lines(t)))
    return ledger.query(numbered, filters=["source.file == shard-2.jsonl", "source.line <= 100"]).select(F.col("seq").alias("n"))


@query("ledger_projection", f"""WITH {_REC} SELECT n, concat('"', channel, '"') AS channel,
 CASE items WHEN 0 THEN '[]' WHEN 1 THEN concat('["https://example.com/a', CAST(n AS VARCHAR), '"]') ELSE concat('["https://example.com/a', CAST(n AS VARCHAR), '","https://example.com/b', CAST(n AS VARCHAR), '"]') END AS urls,
 CASE WHEN items > 1 THEN concat('"b', CAST(n AS VARCHAR), '"') END AS second, CAST(NULL AS VARCHAR) AS missing FROM r""")
def ledger_projection(t):
    fields = ["channel", "result.items[*].url", "result.items[1].id", "result.nope[*].x"]
    parsed = ledger.parse(lines(t)).where("state = 'ok'")
    return ledger.query(parsed, fields=fields).select(
        F.col("seq").alias("n"), "channel", F.col("`result.items[*].url`").alias("urls"), F.col("`result.items[1].id`").alias("second"),
        F.col("`result.nope[*].x`").alias("missing"),
    )


@query("canonical_items", f"""WITH {_REC} SELECT concat('run-', CAST(n % 3 AS VARCHAR)) AS run_id, channel, concat('q', CAST(user_id % 10 AS VARCHAR)) AS input, intent,
 unnest(CASE items WHEN 0 THEN [] WHEN 1 THEN [concat('a', CAST(n AS VARCHAR))] ELSE [concat('a', CAST(n AS VARCHAR)), concat('b', CAST(n AS VARCHAR))] END) AS id FROM r""")
def canonical_items(t):
    rows = ledger.canonical_items(ledger.parse(lines(t)))
    return rows.select("run_id", "channel", "input", "intent", F.try_variant_get("item", "$.id", "string").alias("id"))


@query("ledger_items", f"""WITH {_REC}, i AS (SELECT *, unnest(CASE items WHEN 0 THEN [] WHEN 1 THEN ['a'] ELSE ['a', 'b'] END) AS tag FROM r)
SELECT concat(tag, CAST(n AS VARCHAR)) AS id, concat('user', CAST(user_id AS VARCHAR)) AS author, kind, floor(value * 10) AS likes, intent, source_role,
 concat('q', CAST(user_id % 10 AS VARCHAR)) AS tokens FROM i""")
def ledger_items(t):
    items = ledger.items_of(ledger.coerce(ledger.parse(lines(t))))
    return items.select(
        "id", "author", F.col("timeline_item_kind").alias("kind"), F.try_element_at("engagement", F.lit("likes")).alias("likes"), "intent", "source_role",
        F.array_join("query_tokens", ",").alias("tokens"),
    )


@query("ledger_skipped_records", "SELECT count(*) AS skipped_records FROM events WHERE event_id % 20 IN (2, 3)")
def ledger_skipped_records(t):
    return ledger.skipped_records(ledger.parse(lines(t))).select(F.col("skipped_records").cast("bigint").alias("skipped_records"))


@query("ledger_candidates", f"""WITH {_REC} SELECT concat('author:', channel, ':user', CAST(user_id AS VARCHAR)) AS candidate_key, CAST(sum(items) AS BIGINT) AS seen_in_count
FROM r WHERE items > 0 GROUP BY 1""")
def ledger_candidates(t):
    items = ledger.items_of(ledger.coerce(ledger.parse(lines(t))))
    return dedupe.dedupe(items, "author").candidates.select("candidate_key", "seen_in_count")


@query("ledger_records", """SELECT doc_id, 'search' AS operation, true AS ok, CAST(1 AS BIGINT) AS count, concat('d', CAST(doc_id AS VARCHAR)) AS ids, 'given' AS intent, source AS query_id FROM documents""")
def ledger_records(t):
    item = F.struct(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("text"))
    result = F.struct(
        F.lit(True).alias("ok"), F.lit("docs").alias("channel"), F.lit("search").alias("operation"), F.array(item).alias("items"),
        F.struct(F.lit("ignored").alias("intent"), F.col("source").alias("query_id")).alias("meta"), F.lit(None).cast("string").alias("error"),
    )
    docs = t.documents.select(F.to_variant_object(result).alias("result"), F.lit("given").alias("intent"))
    made = ledger.build_records(docs, "run-1", "2026-01-01T00:00:00Z")
    number = F.substr(F.get("item_ids", F.lit(0)), F.lit(2)).cast("bigint")
    return made.select(
        number.alias("doc_id"), "operation", "ok", F.col("count").cast("bigint").alias("count"), F.array_join("item_ids", ",").alias("ids"), "intent", "query_id"
    )


@query("ledger_written_shards", f"""WITH {_REC} SELECT channel, count(*) AS records, CAST(sum(items) AS BIGINT) AS items FROM r GROUP BY channel""")
def ledger_written_shards(t):
    """Write records sharded by channel and operation, merge the shards in order, read them back."""
    import uuid

    from siftstone.plans.skew import scratch_folder

    base = f"{scratch_folder(t.spark)}/shards-{uuid.uuid4().hex}"
    records = ledger.parse(lines(t)).where("state = 'ok'").select(
        F.try_variant_get("rec", "$.result", "variant").alias("result"), F.try_variant_get("rec", "$.intent", "string").alias("intent")
    )
    ledger.append_records(ledger.build_records(records, "run-9"), f"{base}/in", shard_by=["channel", "operation"])
    ledger.merge(ledger.read_lines(t.spark, f"{base}/in"), f"{base}/merged")
    back = ledger.coerce(ledger.parse(ledger.read_lines(t.spark, f"{base}/merged")))
    return back.groupBy("channel").agg(F.count(F.lit(1)).alias("records"), F.sum(F.size("items")).cast("bigint").alias("items"))
