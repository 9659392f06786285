"""Scalar expressions against plain-Python expectations written for these tests."""

import random
import unicodedata

from pyspark.sql import functions as F

from siftstone.functions import text as T
from siftstone.functions import urls as U
from siftstone.functions import values as V


def run(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_casefold_matches_python(spark):
    rng = random.Random(3)
    pool = "aZßẞſΣςσİıÉéŉǰﬁﬀᏰꭰԱևK1 #日本"
    words = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    assert run(spark, words, T.casefold) == [w.casefold() for w in words]


def test_norm_text_matches_python(spark):
    values = ["ＡＢＣ　def", "ﬁne  x", "plain  Text\n\nx", "Straße", "カ゛ガ", "é é", "", "½ cup"]
    want = [" ".join(unicodedata.normalize("NFKC", v).casefold().split()) for v in values]
    assert run(spark, values, T.norm_text) == want
    assert [T.norm_literal(v) for v in values] == want


def test_title_helpers(spark):
    assert run(spark, ["\n  \n Hello there \nmore", "", "a b"], lambda c: T.derive_title(c, F.lit("x"))) == [
        "Hello there",
        "x",
        "a",
    ]
    keys = run(spark, ["Short one", "one two three FOUR", "averyveryverylongsingletitle", "", None], T.title_key)
    assert keys == [None, "one two three four", "averyveryverylongsingletitle", None, None]


def test_query_tokens(spark):
    got = run(spark, ['"AI" #Agents from:bob a 犬 lang:ja agents (x)', "foo:bar since:", None], T.query_tokens)
    assert got == [["ai", "agents", "犬"], ["foo:bar"], []]


def test_near_dup_tokens(spark):
    got = run(spark, ["Use CODE dev20 at https://a.b/c @bob #Sale2024 for 1234 x-y and 12", "#a##bcd"], T.near_dup_tokens)
    assert got == [["code", "dev20", "sale2024", "0", "x-y", "0"], ["bcd"]]


def test_canonical_url(spark):
    cases = {
        "HTTPS://Example.com/post/#section": "https://example.com/post",
        "https://www.Twitter.com/a/status/1/?s=1": "https://x.com/a/status/1?s=1",
        "https://example.com/": "https://example.com/",
        "https://example.com": "https://example.com",
        "no scheme/": "no scheme/",
        "  ": None,
        "http://h//a///": "http://h//a",
    }
    assert run(spark, list(cases), U.canonical_url) == list(cases.values())
    assert run(spark, ["HTTPS://m.X.com/a#b", "https://mobile.twitter.com/x", "rel/path"], U.url_domain) == [
        "m.x.com",
        "x.com",
        None,
    ]


def test_handles_and_ids(spark):
    assert run(spark, ["@bob", "https://x.com/amy/status/9", "carl "], U.screen_name) == ["bob", "amy", "carl"]
    assert run(spark, ["https://x.com/a/status/77?s=1", "88", "https://x.com/a"], U.post_id) == [
        "77",
        "88",
        "https://x.com/a",
    ]
    assert run(spark, ["#ai", " ai ", "a b", "#"], U.hashtag) == ["#ai", "#ai", None, None]


def test_images(spark):
    got = run(spark, ['![a](https://e/x.png) <img alt="" src="https://e/y.jpg"> ![b](https://e/x.png)'], U.image_urls)
    assert got == [["https://e/x.png", "https://e/y.jpg"]]
    assert run(spark, ["https://e/x.PNG?z=1", "https://e/x.html", "ftp://e/x.png", None], U.looks_like_image) == [
        True,
        False,
        False,
        False,
    ]


def test_url_list(spark):
    got = run(
        spark,
        ['[{"url":"u1","expandedUrl":"e1"}, " p ", {"displayUrl":"d"}, "", {"x":1}]', "{}"],
        lambda c: U.url_list(F.try_parse_json(c)),
    )
    assert got == [["e1", "p", "d"], None]


def test_numbers_and_engagement(spark):
    assert run(spark, ["1,234", " 5 ", "x", "", "2.5"], V.number_or_null) == [1234.0, 5.0, None, None, 2.5]
    got = run(
        spark,
        [
            '{"likes":"1,234","views":5}',
            '{"like_count":7,"metrics":{"retweet_count":"3","likes":9}}',
            '{"likes":true,"metrics":{"likes":4}}',
            '{"likes":null,"likes_count":2}',
        ],
        lambda c: V.normalize_engagement(F.parse_json(c)),
    )
    assert got == [{"likes": 1234.0, "views": 5.0}, {"likes": 7.0, "retweets": 3.0}, {"likes": 4.0}, {"likes": 2.0}]


def test_timestamps(spark):
    cases = {
        "2026-04-10T12:30:45.9+09:00": "2026-04-10T03:30:45Z",
        "2026-04-10 01:02:03": "2026-04-10T01:02:03Z",
        "2026-04-10": "2026-04-10T00:00:00Z",
        "2026-04-10T01:02:03Z": "2026-04-10T01:02:03Z",
        "20260410": "2026-04-10T00:00:00Z",
        "Fri, 10 Apr 2026 01:02:03 GMT": "2026-04-10T01:02:03Z",
        "10 Apr 2026 01:02:03 +0200": "2026-04-09T23:02:03Z",
        " soon ": "soon",
        "": None,
    }
    assert run(spark, list(cases), V.timestamp_text) == list(cases.values())


def test_error_categories(spark):
    cases = {
        "http_429": "rate_limited",
        "HTTP_409": "upstream_unavailable",
        "not_found": "no_results",
        "x timed out": "timeout",
        "weird 429": "rate_limited",
        "login": "auth_required",
        "zzz": "unknown",
    }
    assert run(spark, list(cases), V.error_category) == list(cases.values())
    raw = ["HTTP 429 Too Many", "Status-409", "boom (429)", "see 4290", '{"error":{"code":"abc"}}', "not_authenticated"]
    assert run(spark, raw, V.structured_error_code) == [
        "rate_limited",
        "http_409",
        "rate_limited",
        None,
        "abc",
        "not_authenticated",
    ]


def test_concrete_details_test_the_boundary_once(spark):
    from siftstone.functions import patterns
    from siftstone.operators import score

    assert patterns.CONCRETE_DETAIL_RE.count(patterns.NOT_AFTER_WORD) == 1
    text = "v2.1 on 2026-04-10 37% less $5 p95 12ms 1.2.3 20 20% x5 5x marching may sec v1 a$9 2024/1/2 3,4 éfeb 7%a 5km g kg-"
    want = ["v2.1", "2026", "04", "10", "37", "$5", "p95", "1.2", "3", "20", "marching", "may", "sec", "$9", "2024", "1", "2", "3,4", "7%", "g", "kg"]
    found = spark.createDataFrame([(text,)], "t string").select(score.concrete_details(F.col("t"))).collect()[0][0]
    assert found == len(set(want))
