"""Resuming a plan from the ledger lines of earlier runs."""

import json

from pyspark.sql import functions as F

from siftstone.operators.batch import pending_queries, query_key, resume_keys
from siftstone.sources import ledger


def _parsed(spark, records):
    rows = [(r if isinstance(r, str) else json.dumps(r), "a.jsonl", 0, i) for i, r in enumerate(records)]
    return ledger.parse(spark.createDataFrame(rows, "value string, file string, block_start long, seq long"))


def _record(text, ok=True, top=None, **meta):
    return {"record_type": "collection_result", "channel": "web", "operation": "search", "input": text, "result": {"ok": ok, "items": [], "meta": meta}} | (top or {})


PLAN = "id int, channel string, operation string, input string, limit int, search_type string, exclude array<string>, quality_profile string, topic_fit string, item_text_max_chars int"


def _plan(spark, *rows):
    keys = [c.split()[0] for c in PLAN.split(", ")]
    return spark.createDataFrame([tuple({"channel": "web", "operation": "search", "id": i, **r}.get(k) for k in keys) for i, r in enumerate(rows)], PLAN)


def test_defaults_of_each_rows_own_profile(spark):
    both = ["retweets", "replies"]
    done = ledger.executed_queries(
        _parsed(
            spark,
            [
                _record("balanced", quality_profile="balanced", exclude=["links", *both], applied_defaults={"exclude": both}),
                _record("recall", quality_profile="recall", exclude=["links"], applied_defaults={"exclude": ["links"]}),
                _record("asked", quality_profile="balanced", exclude=["links", *both]),
                _record("typed", search_type="top", item_text_max_chars=280, applied_defaults={"search_type": "top", "item_text_max_chars": 280}),
                _record("changed", search_type="latest", applied_defaults={"search_type": "top"}),
                _record("one", exclude="links", requested_limit=5, limit=9),
            ],
        )
    )
    plan = _plan(
        spark,
        {"input": "balanced", "quality_profile": "balanced", "exclude": ["links"]},
        {"input": "balanced", "quality_profile": "balanced", "exclude": ["links", "replies"]},
        {"input": "balanced", "quality_profile": "balanced"},  # open: links were asked for
        {"input": "recall", "quality_profile": "recall"},
        {"input": "recall", "quality_profile": "recall", "exclude": ["links"]},
        {"input": "asked", "quality_profile": "balanced", "exclude": ["links"]},  # open: nothing was filled in
        {"input": "typed"},
        {"input": "typed", "search_type": "top", "item_text_max_chars": 280},
        {"input": "typed", "search_type": "top"},  # open: defaults of one kind go together
        {"input": "changed"},  # open: the field has not the default's value
        {"input": "changed", "search_type": "latest"},
        {"input": "one", "exclude": ["links"], "limit": 5},
        {"input": "one", "exclude": ["links"], "limit": 9},  # open: the requested limit counts
    )
    assert sorted(r["id"] for r in pending_queries(plan, done).collect()) == [2, 5, 8, 9, 12]


def test_lines_that_are_no_result_are_left_out(spark):
    records = [
        '{"record_type": "collection_result", "channel": "web"',
        "[1]",
        "",
        _record("note", top={"record_type": "note"}),
        _record("", quality_profile="balanced"),
        _record("no channel", top={"channel": ""}),
        _record("failed", ok=False),
        {"record_type": "collection_result", "result": {"ok": True, "channel": "web", "operation": "search", "meta": {"input": "by result", "topic_fit": {"b": 1, "a": [2]}}}},
        _record("odd meta", top={"result": {"meta": 5}}),
        _record("twice"),
        _record("twice"),
    ]
    done = ledger.executed_queries(_parsed(spark, records))
    assert sorted(r["input"] for r in done.collect()) == ["by result", "failed", "odd meta", "twice", "twice"]
    assert resume_keys(done).count() == 4
    plan = _plan(spark, {"input": "note"}, {"input": "failed"}, {"input": "by result", "topic_fit": '{ "a": [2], "b": 1 }'}, {"input": "odd meta"}, {"input": "twice"})
    assert [r["id"] for r in pending_queries(plan, done).orderBy("id").collect()] == [0]
    assert [r["id"] for r in pending_queries(plan, done, only_ok=True).orderBy("id").collect()] == [0, 1, 3]
    assert pending_queries(plan, done.limit(0)).count() == 5


def test_keys_ignore_columns_that_are_no_identity(spark):
    plan = _plan(spark, {"input": "x"}, {"input": "x"})
    keys = plan.withColumn("query_id", F.col("id")).select(query_key(plan).alias("k")).distinct()
    assert keys.count() == 1


def test_keys_of_a_ledger_are_not_broadcast_by_a_guess_of_their_size(spark):
    """The ledger's size shrinks in Spark's guess with every expression that parses it, so a guess below the limit says nothing."""
    done = ledger.executed_queries(_parsed(spark, [_record("a", search_type="top", applied_defaults={"search_type": "top"}), _record("b")]))
    pending = pending_queries(_plan(spark, {"input": "a"}, {"input": "b"}, {"input": "c"}), done)
    plan = pending._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert plan.count("Union") == 0  # a row and its variant without defaults come out of one pass over the lines
    assert [r["input"] for r in pending.collect()] == ["c"]
