"""Texts are normalised, folded and judged once, and not by patterns over every character."""

import unicodedata

from pyspark.sql import functions as F

from siftstone.functions import patterns as P
from siftstone.functions import text as T
from siftstone.operators import search
from siftstone.operators import topic_fit as tf
from siftstone.operators.items import build_items


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rule_sets_meet_texts_normalised_without_patterns(spark):
    """Before, each text went through two patterns of many ranges and was squeezed by a third."""
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert set(spaces) == set(P.SPACE_CHARS)
    texts = [f"{s}Ａgent{s}{s}Straße{s}" for s in spaces] + ["", " ", "\x1f", "ΟΔΟΣ ſK", "ᴬͅ", "a​b", None]
    df = spark.createDataFrame(list(enumerate(texts)), "ord int, text string")
    got = [r[0] for r in df.select("ord", T.norm_text(F.col("text")).alias("n")).orderBy("ord").select("n").collect()]
    assert got == [None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()) for t in texts]
    sets = {"a": tf.TopicRules.of({"required_any_terms": ["agent strasse"]}), "b": tf.TopicRules.of({"excluded_terms": ["agent"]})}
    out = tf.evaluate_many(df, [F.col("text")], sets)
    rows = {(r["ord"], r["rule_set_id"]): r["topic_fit"]["matched"] for r in out.collect()}
    assert all(rows[n, "a"] == (n < len(spaces)) and rows[n, "b"] == (n >= len(spaces)) for n in range(len(texts)))
    assert "RLIKE" not in plan(out) and "regexp_replace" not in plan(out).lower()
    assert plan(out).count("ArrowEvalPython") == 1


def _posts(spark):
    rows = [(1, "u", "Shop here, everyone", 50.0), (2, "u", "nothing to see, move on", 50.0), (3, "u", "few likes shop", 3.0), (4, "v", "a plain sentence here", 40.0)]
    df = spark.createDataFrame(rows, "ord long, author string, text string, likes double")
    return build_items(df.withColumn("engagement", F.create_map(F.lit("likes"), "likes")).withColumn("timeline_item_kind", F.lit("original")))


def test_timelines_build_a_haystack_once(spark):
    """Before, the filter on the reasons built the haystack of each text, and the reasons did so again."""
    rules = tf.TopicRules.of({"excluded_terms": ["shop"]})
    chosen, drops = search.user_posts(_posts(spark), min_likes=30, rules=rules, limit=5)
    assert sorted(tuple(r) for r in drops.collect()) == [("u", "min_likes", 1), ("u", "topic_fit_excluded_term", 1)]
    assert sorted(r["ord"] for r in chosen.kept.collect()) == [2, 4]
    assert plan(drops).count("ArrowEvalPython") == 1 and plan(chosen.kept.select("author", "ord")).count("ArrowEvalPython") == 1


def test_letters_that_equal_ascii_ones_are_replaced_without_a_table_per_character(spark):
    """Before, translate() looked up every character of a text."""
    every = spark.range(1, 0x3400).where("id < 55296").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    every = every.select(F.concat(F.lit("Aİ"), "c", F.lit("ıſKz")).alias("c"))
    want = F.lower(F.translate("c", "\u0130\u0131\u017f\u212a", "iisk"))
    assert every.where(T.plain_lower(F.col("c")) != want).isEmpty()
    assert "translate" not in plan(every.select(T.plain_lower(F.col("c"))))
