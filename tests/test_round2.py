"""Searches, ledger reports, follow-ups and spread: cases beyond the registered queries."""

import pytest
from pyspark.sql import functions as F

from siftstone.operators import coverage, judge, search
from siftstone.plans.skew import top_per_group
from siftstone.sources import jsonpath, ledger
from siftstone.sources.jsonpath import filter_column, literal_value, parse_filter, project

POST = "id string, conversation_id string, text string"


def test_thread_of_a_post_without_conversation(spark):
    posts = spark.createDataFrame([("1", None, "a"), ("2", "c", "b"), ("3", "c", "d"), ("4", None, "e")], POST)
    asked = spark.createDataFrame([("1",), ("3",)], "post string")
    assert {r["id"] for r in search.threads(posts, asked).collect()} == {"1", "2", "3"}


@pytest.mark.parametrize(
    "text,value",
    [("'a b'", "a b"), ('"x"', "x"), ("TRUE", True), ("null", None), ("-12", -12), ("1.50", 1.5), ("007", 7), ("[1, 2]", [1, 2]), ("1e3", "1e3"), ("web", "web")],
)
def test_literals(text, value):
    assert literal_value(f" {text} ") == value and parse_filter(f"a.b-c >= {text}") == ("a.b-c", ">=", value)


@pytest.mark.parametrize("bad", ["", "a", "a ==", "== 3", "a ~ 3", "a == [1"])
def test_bad_filters(bad):
    with pytest.raises(ValueError):
        parse_filter(bad)


def test_filters_and_projection(spark):
    row = spark.sql("""SELECT parse_json('{"n":1790000000000000001,"f":1.5,"l":[true,"x",3],"a":[{"b":1},{"c":2}]}') AS r""")
    hit = lambda e: row.where(filter_column(F.col("r"), [e])).count() == 1
    assert hit("n == 1790000000000000001") and not hit("n == 1790000000000000002") and not hit("n > 1790000000000000001")
    assert hit("f > 1") and hit("f <= 1.5") and not hit("f == 1")
    assert hit("l contains true") and not hit('l contains "true"') and hit('l contains "True"') and hit("l contains x") and hit("l contains 3")
    text = lambda p: row.select(project(F.col("r"), p)).first()[0]
    assert text("a[*].b") == "[1]" and text("a[1].c") == "2" and text("a.0.b") == "1"
    assert [jsonpath._steps(p) for p in ("", "a.", ".a", "a[0]b", "a[x]", "a..b")] == [None] * 6
    assert jsonpath._steps("a[*][2].b") == ["a", "*", 2, "b"]


def test_read_lines_needs_shards_and_excludes_whole_paths(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        (tmp_path / "empty").mkdir()
        ledger.read_lines(spark, str(tmp_path / "empty"))
    for name in ("raw.jsonl", "xraw.jsonl"):
        (tmp_path / name).write_text('{"a":1}\n')
    files = {r["file"].rpartition("/")[2] for r in ledger.read_lines(spark, str(tmp_path), exclude="raw.jsonl").collect()}
    assert files == {"xraw.jsonl"}


def test_identifiers_come_from_extras(spark):
    line = (
        '{"record_type":"collection_result","channel":"x","result":{"ok":true,"channel":"x","operation":"search","meta":{},"error":null,"items":['
        '{"id":"10","extras":{"post_id":"77","author_handle":"bob"}},{"id":"11","identifiers":{"post_id":"5"},"extras":{"post_id":"6"}}]}}'
    )
    lines = spark.createDataFrame([(line, "a.jsonl", 0, 0)], "value string, file string, block_start long, seq long")
    got = {r["id"]: r["identifiers"] for r in ledger.items_of(ledger.coerce(ledger.parse(lines))).select("id", "identifiers").collect()}
    assert got == {"10": {"post_id": "77", "author_handle": "bob"}, "11": {"post_id": "5"}}


def test_follow_ups_in_order(spark):
    topics = [coverage.Topic("a", "Alpha Beta", ("x",)), coverage.Topic("b", "", ("x",), queries=("q1", " ", "q2"), probe_limit=3)]
    rows = coverage.follow_ups(spark, topics, ["en", None], objective=" Look at alpha beta ", target_posts=40).orderBy("ord").collect()
    assert [(r["ord"], r["slug"], r["input"], r["lang"], r["probe"]) for r in rows] == [
        (0, "alpha-beta", "Look at alpha beta", "en", 20),
        (1, "alpha-beta", "Look at alpha beta", None, 20),
        (2, "topic", "q1", "en", 3),
        (3, "topic", "q1", None, 3),
        (4, "topic", "q2", "en", 3),
        (5, "topic", "q2", None, 3),
    ]
    other = coverage.follow_ups(spark, topics[:1], [], first_query="tools").first()
    assert other["input"] == "tools Alpha Beta" and other["lang"] is None


def test_languages_have_no_limit(spark):
    queries = spark.createDataFrame([("search", None), ("search", "pt"), ("profile", None)], "operation string, lang string")
    many = spark.range(150).select(F.concat(F.lit("l"), F.col("id").cast("string")).alias("lang"))
    assert coverage.expand_queries(queries, many).count() == 152
    assert coverage.expand_queries(queries, ["en"]).count() == 3 and coverage.expand_queries(queries, []).count() == 3


def test_large_groups_take_descending_order(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), "id")
    got = top_per_group(df, ["g"], [F.desc("id")], 1200)
    assert got.count() == 2400 and got.agg(F.min("id")).first()[0] == 600


def test_repeated_judge_results_count_once(spark):
    rows = spark.createDataFrame([("1", 1)], "id string, rank int")
    results = spark.createDataFrame([("1", "keep", 0.4), ("1", "drop", 0.9)], "id string, decision string, confidence double")
    assert [r["decision"] for r in judge.attach_results(rows, results).collect()] == ["drop"]
