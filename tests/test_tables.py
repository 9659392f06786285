"""Tables of terms, rules, topics and searches against plain checks and against the operators that take them as configuration."""

import random

import pytest
from pyspark.sql import functions as F

from siftstone.operators import coverage, search, terms
from siftstone.operators import topic_fit as tf
from siftstone.operators.items import build_items

RULES = "rule_set_id string, field string, position int, term string, synonym_group int"


@pytest.mark.parametrize("pairs_per_block", [1 << 18, 7])
def test_pairs_equal_contains(spark, monkeypatch, pairs_per_block):
    monkeypatch.setattr(terms, "BLOCK_PAIRS", pairs_per_block)
    monkeypatch.setattr(terms, "BLOCK_BYTES", 200)
    draw = random.Random(4)
    letters = "ab cé日"
    rows = [(i, "".join(draw.choices(letters, k=draw.randrange(50)))) for i in range(120)] + [(900, None), (901, ""), (902, "ab" * 3000)]
    words = list({"".join(draw.choices(letters, k=draw.randrange(1, 7))) for _ in range(60)})
    groups = [(draw.randrange(20), w) for w in words] + [(99, "zzz"), (99, "a"), (98, ""), (97, None), (None, "a"), (3, words[0]), (3, words[0])]
    docs = spark.createDataFrame(rows, "ord long, text string").repartition(3)
    table = spark.createDataFrame(groups, "g int, w string")
    found = {(r["ord"], r["w"]) for r in terms.match_terms(docs, F.col("text"), table, term="w").collect()}
    assert found == {(i, w) for i, t in rows for _, w in groups if w and _ is not None and w in (t or "")} | {(i, "a") for i, t in rows if "a" in (t or "")}
    pairs = terms.match_groups(docs, F.col("text"), table, group="g", term="w").collect()
    need = {}
    for g, w in groups:
        if g is not None and w:
            need.setdefault(g, set()).add(w)
    assert sorted(tuple(r) for r in pairs) == sorted((i, g) for i, t in rows for g, ws in need.items() if all(w in (t or "") for w in ws))
    assert terms.match_groups(docs.limit(0), F.col("text"), table, group="g", term="w").count() == 0
    assert terms.match_groups(docs, F.col("text"), table.limit(0), group="g", term="w").columns == ["ord", "g"]


def posts(spark, n=80):
    draw = random.Random(6)
    vocabulary = "Workflow agent codex pricing feedback coupon logs latency straße test".split()
    rows = [
        (i, " ".join(draw.choices(vocabulary, k=draw.randrange(1, 9))) + f" notes {i} of the run", draw.choice(["Ann", "bob", "@cy"]), draw.choice(["en", "de"]), float(draw.randrange(60)), draw.choice(["original", "reply", "quote"]))
        for i in range(n)
    ]
    raw = spark.createDataFrame(rows, "ord long, text string, author string, lang string, likes double, timeline_item_kind string")
    raw = raw.withColumns({"id": F.col("ord").cast("string"), "engagement": F.create_map(F.lit("likes"), F.col("likes")), "published_ts": F.timestamp_seconds(F.col("ord") * 3600)})
    return build_items(raw.withColumns({"source": F.lit("s"), "urls": F.array().cast("array<string>")}))


def test_rules_table_equals_rule_objects(spark):
    rules = {
        "build": {"required_any_terms": ["Workflow", "agent", "workflow "], "preferred_terms": ["codex", "missing"], "synonym_groups": [["codex", "pricing"], ["pricing", "CODEX"], ["logs", "latency"]]},
        "strict": {"required_all_terms": ["pricing", "codex", "logs"], "excluded_terms": ["coupon"], "exact_phrases": ["agent codex"]},
        "negative": {"negative_phrases": ["pricing feedback"], "preferred_terms": ["STRASSE"]},
    }
    flat = []
    for name, given in rules.items():
        for field, values in given.items():
            for i, value in enumerate(values):
                flat += [(name, field, j, v, i) for j, v in enumerate(value)] if field == "synonym_groups" else [(name, field, i, value, None)]
    rows, parts = posts(spark), [F.col("text"), F.col("author")]
    table = spark.createDataFrame(flat, RULES)
    got = {(r["ord"], r["rule_set_id"]): r["topic_fit"] for r in tf.evaluate_table(rows, parts, table).collect()}
    rest = {r["rule_set_id"]: r["topic_fit"] for r in tf.verdict_without_hits(table).collect()}
    want = tf.evaluate_many(rows, parts, {k: tf.TopicRules.of(v) for k, v in rules.items()}).collect()
    assert len(want) == 240 and got
    for r in want:
        assert got.get((r["ord"], r["rule_set_id"]), rest[r["rule_set_id"]]) == r["topic_fit"], r["text"]


def test_plan_does_not_grow_with_the_rules(spark):
    rows = posts(spark)
    size = {}
    for n in (10, 6000):
        table = spark.createDataFrame([(f"r{i % 50}", "preferred_terms", i, f"term{i}", None) for i in range(n)], RULES)
        plan = tf.evaluate_table(rows, [F.col("text")], table)._jdf.queryExecution().optimizedPlan().toString()
        size[n] = plan.count("\n")
    assert size[10] == size[6000]


def test_topics_table_equals_topics(spark):
    topics = [coverage.Topic("a", "A", ("Codex", "logs")), coverage.Topic("b", "B", ("coupon pricing",)), coverage.Topic("c", "C", ("nowhere",), min_posts=3)]
    table = spark.createDataFrame([(t.topic_id, t.label, i, term, t.min_posts) for i, t in enumerate(topics) for term in t.terms], "topic_id string, label string, position int, term string, min_posts int")
    rows = posts(spark).withColumns({"title": F.lit(None).cast("string"), "rank": F.col("ord")})
    plain = {r["ord"]: r["coverage_topics"] for r in coverage.annotate(rows, topics).collect()}
    assert {r["ord"]: r["coverage_topics"] for r in coverage.annotate_table(rows, table).collect()} == plain
    names = ["topic_order", "topic_id", "label", "count", "min_posts", "gap", "sample_ids"]
    assert sorted(coverage.report_table(rows, table).select(names).collect()) == sorted(coverage.report(rows, topics).select(names).collect())


QUERIES = ["workflow", "Agent codex", "logs type:latest", "pricing lang:de min_likes:10", "feedback from:ann since:1970-01-02", "latency until:1970-01-03 type:latest", "coupon exclude:replies", "nothere at all", "straße"]


@pytest.mark.parametrize("profile", ["balanced", None])
def test_query_table_equals_single_queries(spark, profile):
    rows = posts(spark)
    table = spark.createDataFrame([(q,) for q in QUERIES + QUERIES[:1]], "query string")
    names = ["query_id", "ord", "search_rank", "unbounded_time_window", "text", "query_tokens"]
    one = search.search_many(rows, QUERIES, limit=4, profile=profile).kept.select(names).collect()
    many = search.search_table(rows, table, limit=4, profile=profile).kept.select(names).collect()
    key = lambda r: (r["query_id"], r["search_rank"])
    assert one and sorted(one, key=key) == sorted(many, key=key)


def test_query_table_reads_posts_once_per_step(spark, tmp_path):
    posts(spark).write.parquet(str(tmp_path / "posts"))
    rows = spark.read.parquet(str(tmp_path / "posts"))
    scans = {}
    for n in (3, 500):
        table = spark.createDataFrame([(f"agent w{i}",) for i in range(n)], "query string")
        plan = search.search_table(rows, table, limit=4).kept._jdf.queryExecution().optimizedPlan().toString()
        scans[n] = plan.count("Relation ")
    assert scans[3] == scans[500] <= 3


def test_query_table_refuses_what_it_cannot_find(spark):
    rows = posts(spark)
    for bad in ("from:ann", "agent has:smell"):
        with pytest.raises(ValueError, match="word|has"):
            search.search_table(rows, spark.createDataFrame([(bad,)], "query string"), limit=2)


def test_hits_of_rule_sets_stay_in_their_task(spark):
    """No hit is shuffled; rows under one id still count together."""
    from siftstone.operators import topic_fit as tf

    rules = [("r1", "preferred_terms", 1, "ab", None), ("r1", "preferred_terms", 2, "cd", None), ("r2", "exact_phrases", 1, "cd", None)]
    table = spark.createDataFrame(rules, "rule_set_id string, field string, position int, term string, synonym_group int")
    rows = spark.createDataFrame([(1, "x ab"), (1, "cd y"), (2, "ab cd"), (3, "zz"), (4, None)], "ord long, text string")
    out = tf.evaluate_table(rows, [F.col("text")], table)
    got = {(r["ord"], r["rule_set_id"]): (r["topic_fit"]["matched_terms"], r["topic_fit"]["score_bonus"]) for r in out.collect()}
    both = ({"preferred_terms": ["ab", "cd"]}, 2.0), ({"exact_phrases": ["cd"]}, 2.0)
    assert got == {(1, "r1"): both[0], (1, "r2"): both[1], (2, "r1"): both[0], (2, "r2"): both[1]}
    plan = tf.evaluate_table(rows.where("ord > 1"), [F.col("text")], table)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
