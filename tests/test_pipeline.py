"""Distributed folds against sequential walks, and the published expectation cases as inline rows."""

import random

import pytest
from pyspark.sql import functions as F

from siftstone.operators import coverage, curate, dedupe, noise, score
from siftstone.operators import topic_fit as tf
from siftstone.plans.candidates import plan_candidates
from siftstone.plans.skew import number_within, top_per_group
from siftstone.sources import ledger

KINDS = ["original", "quote", "reply", "retweet", None]
SIGHT = (
    "ord long, id string, source string, url string, author string, timeline_item_kind string, intent string, "
    "query_tokens array<string>, text string, title string"
)


def sight_rows(rng, n):
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.34 else f"p{rng.randint(0, 12)}"
        url = rng.choice([None, "u1", "u2", "u3"])
        intent = rng.choice([None, None, "x", "y", "z"])
        rows.append((i, key, "s", url, f"a{rng.randint(0, 3)}", rng.choice(KINDS), intent, rng.sample(["k1", "k2", "k3"], 2), "t", None))
    return rows


def fold(rows, prefer):
    """One dict per key, walked in order."""
    rank = {k: i for i, k in enumerate(KINDS)}
    out = {}
    for ord_, key, _, url, author, kind, intent, tokens, _, _ in rows:
        have = out.get(key)
        if have is None:
            out[key] = {"first": ord_, "n": 1, "url": url, "author": author, "rank": rank[kind], "intent": intent, "alt": [], "tok": set(tokens)}
            continue
        have["n"] += 1
        have["tok"] |= set(tokens)
        have["intent"] = intent if have["intent"] is None else have["intent"]
        if url and url != have["url"] and url not in have["alt"]:
            have["alt"].append(url)
        if prefer and rank[kind] < have["rank"]:
            have.update(url=url, author=author, rank=rank[kind], intent=intent if intent is not None else have["intent"])
    return out


@pytest.mark.parametrize("prefer", [False, True])
def test_dedupe_equals_sequential_fold(spark, prefer, monkeypatch):
    monkeypatch.setattr(dedupe, "HOT_KEY_ROWS", 50)
    rows = sight_rows(random.Random(5), 400)
    d = dedupe.dedupe(spark.createDataFrame(rows, SIGHT), "id", prefer)
    want = fold(rows, prefer)
    got = {r["id"]: r for r in d.candidates.collect()}
    assert set(got) == set(want)
    for key, w in want.items():
        g = got[key]
        assert (g["first_ord"], g["seen_in_count"], g["url"], g["author"], g["intent"]) == (w["first"], w["n"], w["url"], w["author"], w["intent"])
    alts = {}
    for r in d.alternate_urls.orderBy("ord").collect():
        alts.setdefault(r["candidate_key"].split(":")[-1], []).append(r["url"])
    assert alts == {k: w["alt"] for k, w in want.items() if w["alt"]}
    tokens = {}
    for r in d.query_tokens.collect():
        tokens.setdefault(r["candidate_key"].split(":")[-1], set()).add(r["token"])
    assert tokens == {k: w["tok"] for k, w in want.items()}


def test_sighting_pages_keep_every_sighting(spark):
    rows = sight_rows(random.Random(6), 300)
    pages = dedupe.dedupe(spark.createDataFrame(rows, SIGHT), "id").sighting_pages(20)
    assert pages.agg(F.sum(F.size("seen_in")), F.max(F.size("seen_in"))).first() == (300, 20)


def test_diversity_equals_sequential_walk(spark):
    rng = random.Random(9)
    rows = [
        (i + 1, rng.choice(["a", "b", "c", "hot", "hot", None]), rng.choice(["t1", "t2", "t3", "t4", None]), rng.choice(["u1", "u2", "u3", "u4", "u5", None]))
        for i in range(150)
    ]
    df = spark.createDataFrame(rows, "rank long, author string, thread string, url string").withColumns(
        {"canonical_url": F.lit(None).cast("string"), "identifiers": F.create_map(F.lit("conversation_id"), F.col("thread"))}
    )
    caps = {"author_diversity": 6, "thread_diversity": 4, "url_diversity": 3}
    used, kept, dropped = [{}, {}, {}], [], {}
    for rank, *keys in rows:
        reason = next((n for (n, cap), k, u in zip(caps.items(), keys, used) if k and u.get(k, 0) >= cap), None)
        if reason:
            dropped[rank] = reason
            continue
        kept.append(rank)
        for k, u in zip(keys, used):
            if k:
                u[k] = u.get(k, 0) + 1
    got_kept, got_dropped = curate.apply_diversity(df, caps)
    assert sorted(r["rank"] for r in got_kept.collect()) == kept
    assert {r["rank"]: r["reason"] for r in got_dropped.collect()} == dropped


def test_numbering_and_top_rows_of_a_hot_group(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    numbered = number_within(df, ["k"], ["id"], running={"total": F.col("id")})
    hot = numbered.where("k = 'hot'").orderBy("id").collect()
    assert [r["position"] for r in hot] == list(range(1, 1001))
    assert hot[-1]["total"] == sum(range(0, 3000, 3))
    top = top_per_group(df, ["k"], [F.col("id")], 1000)
    assert top.where("k = 'hot'").count() == 1000 and top.count() == 3000
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "5")
    assert top_per_group(df, ["k"], [F.col("id")], 7).where("k = 'hot'").agg(F.max("id")).first()[0] == 18
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "1000")


def test_url_dedupe_and_id_fallback(spark):
    rows = [(1, "a", "web", "HTTPS://Example.com/post/#section"), (2, "b", "web", "https://example.com/post"), (3, "z", "git", None), (4, "z", "git", None), (5, "z", "rss", None)]
    d = dedupe.dedupe(spark.createDataFrame(rows, "ord long, id string, source string, url string"), "url")
    got = {r["candidate_key"]: (r["id"], r["seen_in_count"]) for r in d.candidates.collect()}
    assert got == {"url:https://example.com/post": ("a", 2), "id:git:z": ("z", 2), "id:rss:z": ("z", 1)}


def test_first_seen_limit_and_noise(spark):
    rows = [(i, f"p{i}", "s", None, "a", "original", None, ["k"], f"some sensible text number {i}", None) for i in range(3)]
    rows.append((9, "ad", "s", None, "a", "original", None, ["k"], "airdrop giveaway for everyone here", None))
    plan = plan_candidates(spark.createDataFrame(rows, SIGHT), by="id", limit=2, drop_noise=True, near_duplicates=False)
    assert [r["id"] for r in plan.returned.orderBy("first_ord").collect()] == ["p0", "p1"]
    assert {r["reason"]: r["count"] for r in plan.filtered.drop_counts.collect()} == {"promo_phrase": 1}
    with pytest.raises(ValueError):
        plan.project(["nope"])


def test_metric_filter_counts_every_reason(spark):
    df = spark.createDataFrame([(9.0, 10.0, 1000.0), (50.0, 2.0, 50.0), (50.0, 10.0, 1000.0)], "l double, r double, v double")
    m = F.create_map(F.lit("likes"), F.col("l"), F.lit("retweets"), F.col("r"), F.lit("views"), F.col("v"))
    reasons = df.select(noise.metric_reasons(m, min_likes=10, min_retweets=5, min_views=100).alias("x")).collect()
    assert [r["x"] for r in reasons] == [["min_likes"], ["min_retweets", "min_views"], []]


def test_backfill_case(spark):
    schema = "q string, ord int, text string, timeline_item_kind string, urls array<string>, author string, author_name string, quoted_author_handle string, quoted_author_name string, query_tokens array<string>, engagement map<string,double>"
    base = [None, None, None]
    rows = [
        ("q", 1, "codex news", "retweet", [], "a", *base, ["codex"], {"likes": 900.0}),
        ("q", 2, "codex airdrop", "original", [], "a", *base, ["codex"], {"likes": 900.0}),
        ("q", 3, "codex notes", "original", [], "a", *base, ["codex"], {"likes": 1.0}),
    ]
    f = noise.QualityFilter(spark.createDataFrame(rows, schema), query="q", order="ord", limit=1)
    assert [(r["ord"], r["backfilled"]) for r in f.kept.collect()] == [(3, True)]
    assert {r["reason"]: r["count"] for r in f.drop_counts.collect()} == {"retweet": 1, "promo_phrase": 1}


def test_topic_rules_synonyms_and_japanese(spark):
    rules = tf.TopicRules.of(
        {"required_any_terms": ["codex"], "preferred_terms": ["CLI"], "synonym_groups": [["codex", "AI coding assistant"], ["cli", "command line"]]}
    )
    df = spark.createDataFrame([("An AI coding assistant on the command line",), ("nothing",)], "text string")
    fits = [r["topic_fit"] for r in tf.evaluate(df, [F.col("text")], rules).collect()]
    assert (fits[0]["matched"], fits[0]["score_bonus"]) == (True, 4.5)
    assert fits[0]["matched_terms"] == {"required_any_terms": ["codex"], "preferred_terms": ["CLI"], "synonym_groups": ["group:0", "group:1"]}
    assert fits[1]["drop_reasons"] == ["topic_fit_missing_required_any"]
    ja = tf.TopicRules.of({"required_all_terms": ["料金", "ＡＰＩ"]})
    got = tf.evaluate(spark.createDataFrame([("新しいapiの料金",)], "text string"), [F.col("text")], ja).first()["topic_fit"]
    assert got["matched"] and got["match_reasons"] == ["topic_fit_required_all"]


def test_score_of_a_specific_and_a_promo_post(spark):
    rows = [
        ("We tested v2.1 and measured 37% less latency against the baseline in our workflow, logs below.", "original"),
        ("Shop now, use code SAVE today, link in bio", "original"),
    ]
    got = score.score(spark.createDataFrame(rows, "text string, timeline_item_kind string")).collect()
    assert got[0]["quality_reasons"] == [
        "original", "substantial_text", "concrete_detail", "process_evidence", "first_hand_signal", "observable_signal", "comparison_signal", "specificity_signal",
    ]
    assert got[0]["quality_score"] == 8 + 3 + 3.5 + 2 + 4 + 1.5 + 1.5 + 1
    assert got[1]["quality_reasons"] == ["original", "some_text", "promo_language", "commerce_language", "cta_language", "low_evidence_promo", "cta_over_evidence"]
    assert got[1]["quality_score"] == 8 + 1.5 - 4 - 2 - 3 - 4 - 2


def test_topic_spread_promotes_declared_topics(spark):
    topics = [coverage.Topic("cyber", "Cyber", ("cyber",)), coverage.Topic("codex", "Codex", ("codex",))]
    rows = [(1, "viral", "viral cats"), (2, "c1", "cyber defence"), (3, "c2", "codex setup")]
    df = spark.createDataFrame(rows, "rank long, id string, text string").withColumns(
        {c: F.lit(None).cast("string") for c in ("title", "author", "source_item_id", "canonical_url", "url")}
    )
    chosen, diag = curate.topic_spread(coverage.annotate(df, topics), ["cyber", "codex"], 2)
    assert [r["id"] for r in chosen.orderBy("position").collect()] == ["c1", "c2"]
    d = diag.first()
    assert (d["status"], d["promoted_count"]) == ("applied", 1)


def test_ledger_file_round_trip(spark, tmp_path):
    sep = chr(0x2028)
    record = '{"record_type":"collection_result","run_id":"r","channel":"web","operation":"search","input":"a b","result":{"ok":true,"channel":"web","operation":"search","items":[{"id":"1","url":"u","text":"x%sy","extras":{}}],"meta":{},"error":null}}' % sep
    bad = record.replace('"ok":true', '"ok":false')
    (tmp_path / "B.jsonl").write_text(record + "\r\n\n{broken\n" + bad + "\n", encoding="utf-8")
    (tmp_path / "a.jsonl").write_text(chr(0xFEFF) + record + "\n[1]\n", encoding="utf-8")
    (tmp_path / "skip.txt").write_text("no\n")
    lines = ledger.with_line_numbers(ledger.read_lines(spark, str(tmp_path)))
    parsed = ledger.parse(lines)
    states = {r["state"]: r["count"] for r in parsed.groupBy("state").count().collect()}
    assert states == {"ok": 3, "empty": 1, "invalid_line": 1, "not_object": 1}
    found = ledger.query(parsed, filters=["result.ok == false", "source.line >= 2"], fields=["source.line", "result.items[*].id"]).collect()
    assert [(r["source.line"], r["result.items[*].id"]) for r in found] == [("4", '["1"]')]
    items = ledger.items_of(ledger.coerce(parsed)).collect()
    assert [i["text"] for i in items] == [f"x{sep}y"] * 3 and items[0]["query_tokens"] == []
    with pytest.raises(ValueError):
        ledger.check_strict(parsed)
    ledger.merge(lines, str(tmp_path / "merged"))
    merged = ledger.read_lines(spark, str(tmp_path / "merged")).select("value").collect()
    assert len(merged) == 5 and not any(sep in r["value"] for r in merged)
