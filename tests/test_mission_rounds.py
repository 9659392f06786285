"""Fair share of queries and the follow-up round of a mission."""

import pytest
from pyspark.sql import functions as F

from siftstone.operators import coverage
from siftstone.operators.items import build_items
from siftstone.plans.mission import Mission, fill_gaps

POST = "ord long, text string, author string, lang string, query_id string"


def items(spark, rows):
    raw = spark.createDataFrame(rows, POST)
    return build_items(
        raw.withColumns(
            {
                "id": F.concat(F.lit("p"), F.col("ord").cast("string")),
                "source_item_id": F.concat(F.lit("p"), F.col("ord").cast("string")),
                "title": F.col("text"),
                "source": F.lit("s"),
                "published_ts": F.timestamp_seconds(F.col("ord") * 60),
                "engagement": F.create_map(F.lit("likes"), F.lit(40.0)),
                "timeline_item_kind": F.lit("original"),
                "urls": F.array().cast("array<string>"),
            }
        )
    )


@pytest.mark.parametrize(("target", "share"), [(10, 3), (1, 1), (4000, 1000)])
def test_share_of_a_hot_query(spark, target, share):
    rows = [(i, f"t{i}", "a", "en", "hot" if i % 10 else "cold") for i in range(1500)] + [(9000, "x", "a", "en", None), (9001, "x", "a", "en", "unplanned")]
    table = spark.createDataFrame(rows, POST).repartition(4)
    queries = spark.createDataFrame([("hot", None), ("cold", 2), ("never", None), ("zero", None), ("hot", None)], "query_id string, limit int")
    kept = {(r["query_id"], r["ord"]) for r in Mission(target_posts=target).fair_share(table, queries).collect()}
    want = {("hot", i) for i in [i for i in range(1500) if i % 10][:share]} | {("cold", 0), ("cold", 10), (None, 9000)}
    assert kept == want


def test_follow_up_round_closes_gaps(spark):
    common = "notes about the harbour town and its people number"
    corpus = [(i, f"{common} {i} with {'lighthouse' if i % 5 == 0 else 'market'} stories word{i}", f"u{i}", "en" if i % 2 else "de", None) for i in range(60)]
    collected = [r for r in corpus if r[0] % 5 and r[0] < 25]
    topics = (
        coverage.Topic("light", "Light", ("lighthouse",), ("lighthouse",), min_posts=4),
        coverage.Topic("market", "Market", ("market",), min_posts=2),
        coverage.Topic("absent", "Absent", ("submarine",), ("submarine",)),
    )
    mission = Mission(target_posts=50, require_query_match=False, quality_profile="recall", topics=topics, max_gap_queries=2)
    out = fill_gaps(items(spark, collected), items(spark, corpus), mission)
    rows = {r["topic_id"]: r for r in out.gaps().collect()}
    assert (rows["light"]["count_before"], rows["light"]["gap_before"], rows["light"]["status"]) == (0, 4, "closed")
    # all twelve posts on the topic are found: the follow-up's probe limit is 25
    assert rows["light"]["found_posts"] == 12 and rows["light"]["queries"] == 1
    final = out.final.ranked.select("id", "text").collect()
    assert sum("lighthouse" in r["text"] for r in final) == rows["light"]["count_after"] == 12
    assert rows["market"]["status"] == "covered" and rows["market"]["queries"] == 0
    assert rows["absent"]["status"] == "open" and rows["absent"]["queries"] == 1 and rows["absent"]["found_posts"] == 0
    # posts found anew carry the follow-up query, its intent and role
    new = [r for r in out.final.ranked.where(F.contains("text", F.lit("lighthouse"))).select("intent", "source_role", "query_id").collect()]
    assert all(r["source_role"] == "coverage_gap_fill" and r["query_id"].startswith("gap01") for r in new)


def test_undeclared_topics_are_marked(spark):
    report = spark.createDataFrame([(0, "a", "A", 0, 1, 1, []), (1, "b", "B", 0, 1, 1, [])], "topic_order int, topic_id string, label string, count long, min_posts int, gap long, sample_ids array<string>")
    topics = [coverage.Topic("a", "A", ("a",), ("a",)), coverage.Topic("b", "B", ("b",), ("b",))]
    follow = coverage.follow_ups(spark, topics, [None], target_posts=10)
    planned = spark.createDataFrame([], "input string, lang string")
    queries, marked = coverage.gap_queries(report, follow, planned, declared=["a"])
    assert {r["topic_id"]: r["blocked_reason"] for r in marked.collect()} == {"a": None, "b": "topic_not_declared"}
    assert [r["topic_id"] for r in queries.collect()] == ["a"]
