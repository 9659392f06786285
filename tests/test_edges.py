"""Hooks and helpers that no registered query covers."""

import pandas as pd
from pyspark.sql import functions as F

from siftstone.operators import items, judge, search
from siftstone.plans.skew import lookup, side_by_side
from siftstone.sources import ledger
from siftstone.streaming import jobs


def test_judge_hook_runs_on_batches(spark):
    rows = spark.createDataFrame([("a", 3.0), ("b", -1.0)], "id string, quality_score double")

    def decide(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": part["id"], "decision": ["keep" if s > 0 else "drop" for s in part["quality_score"]], "confidence": 0.5})

    got = judge.run_judge(rows, decide).collect()
    assert {r["id"]: r["decision"] for r in got} == {"a": "keep", "b": "drop"}


def test_late_rows_are_split_off(spark):
    rows = spark.createDataFrame([(1, "2026-01-03 00:00:00"), (2, "2026-01-01 00:00:00")], "id int, t string").withColumn("t", F.col("t").cast("timestamp"))
    on_time, late = jobs.split_late(rows, "t", "1 DAY")
    assert [r["id"] for r in on_time.collect()] == [1] and [r["id"] for r in late.collect()] == [2]


def test_ledger_tail_stream_equals_batch(spark, tmp_path):
    line = '{"record_type":"collection_result","run_id":"r%d","channel":"web","operation":"search","result":{"ok":true,"channel":"web","operation":"search","items":[{"id":"%d"},{"id":"x%d"}],"meta":{},"error":null}}'
    for i in range(3):
        (tmp_path / f"s{i}.jsonl").write_text((line % (i, i, i)) + "\n{bad\n")
    out = jobs.run_available(jobs.canonical_stream(jobs.ledger_stream(spark, str(tmp_path))))
    want = ledger.canonical_items(ledger.parse(ledger.read_lines(spark, str(tmp_path)))).withColumn("item", F.to_json("item"))
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect())) and out.count() == 6


def test_media_entities_and_retention(spark):
    raw = '{"id":"1","text":"t","media":[{"type":"photo","url":"https://e/x?a=1&amp;b=2"}]}'
    posts = items.normalize_posts(spark.createDataFrame([(raw,)], "j string").select(F.parse_json("j").alias("payload")))
    assert items.unescape_media(posts).first()["url"] == "https://e/x?a=1&b=2"
    df = spark.createDataFrame([("abc",), (None,)], "j string").select(F.to_variant_object(F.array("j")).alias("raw"))
    assert items.retain_raw(df, mode="none").where("raw IS NOT NULL").count() == 0


def test_explicit_search_options_win(spark):
    q = spark.createDataFrame([("cats from:bob since:2026-01-01", None, "2025-01-01")], "query string, lang string, since string")
    row = search.parse_inline(q).first()
    assert (row["from_user"], row["since"], row["words"]) == ("bob", "2025-01-01", "cats")


def test_lookup_and_side_by_side(spark):
    facts = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    table = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
    joined = lookup(facts, table, "k", "n", 100)
    assert joined.count() == 1000 and joined.where("low IS NULL").count() == 0
    both = side_by_side(facts.agg(F.max("id").alias("a")), facts.agg(F.min("id").alias("b"))).first()
    assert (both["a"], both["b"]) == (999, 0)
