"""Winners are found by narrow rows and their items fetched afterwards."""

import random

import pytest
from pyspark.sql import functions as F

from siftstone.operators import dedupe
from siftstone.operators.items import build_items
from siftstone.plans import skew

KINDS = ["original", "quote", "reply", "retweet", None]


def sightings(spark, n=400, seed=1):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        k = draw.choice(["a", "a", "a", *"bcdefgh", None])
        rows.append((i, k, f"title {i}", "x" * draw.randrange(2000), draw.choice(["u", "v", "w"]), draw.choice(KINDS), draw.choice(["i1", None])))
    raw = spark.createDataFrame(rows, "ord long, id string, title string, text string, author string, timeline_item_kind string, intent string")
    return rows, build_items(raw.withColumn("source", F.lit("s")).repartition(5))


@pytest.mark.parametrize("few", [1 << 22, 0])
@pytest.mark.parametrize("promote", [False, True])
def test_winner_rows_equal_a_walk(spark, monkeypatch, few, promote):
    rows, items = sightings(spark)
    fetch = skew.fetch_rows
    monkeypatch.setattr(dedupe, "fetch_rows", lambda *a, **k: fetch(*a, **{**k, "few": few}))
    found = {r["id"]: r for r in dedupe.dedupe(items, "id", promote).candidates.collect()}
    best = {}
    for row in rows:
        if row[1] is None:
            continue
        place = (KINDS.index(row[5]), row[0]) if promote else row[0]
        if row[1] not in best or place < best[row[1]][0]:
            best[row[1]] = (place, row)
    assert found.keys() == best.keys()
    for k, (_, row) in best.items():
        assert (found[k]["title"], found[k]["text"], found[k]["author"]) == (row[2], row[3], row[4])
        mine = [r for r in rows if r[1] == k]
        assert found[k]["seen_in_count"] == len(mine) and found[k]["first_ord"] == mine[0][0]


def test_texts_are_not_in_the_aggregate(spark):
    _, items = sightings(spark)
    narrow = dedupe.dedupe(items, "id")._grouped
    plan = narrow.drop("__first_tokens", "__winner_tokens")._jdf.queryExecution().optimizedPlan().toString()
    assert "title" not in plan.split("Aggregate")[1].split("\n")[0]


def test_fetch_of_nothing(spark):
    rows = spark.createDataFrame([(1, "a")], "ord long, text string")
    none = spark.createDataFrame([], "k string, w long")
    assert skew.fetch_rows(none, rows, "w").count() == 0
    assert skew.fetch_rows(none, rows, "w", few=-1).columns == ["k", "w", "text"]
