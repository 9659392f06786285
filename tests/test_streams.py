"""Author cap with state and expiry, late rows and sessions, over several micro-batches, against plain walks."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from siftstone.streaming import jobs

START = dt.datetime(2024, 1, 1)
SCHEMA = "ord long, author string, ts timestamp, text string"


def plain_cap(rows, cap, ttl):
    kept, state = [], {}
    for o, author, at, text in sorted(rows, key=lambda r: (r[2], r[0])):
        if author is None:
            kept.append(o)
            continue
        n, seen = state.get(author, (0, at))
        if at - seen > ttl:
            n = 0
        if n < cap:
            kept.append(o)
        state[author] = (n + (n < cap), at)
    return sorted(kept)


def batches(n, seed, hot=False):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        author = "hot" if hot and i % 2 else draw.choice(["a", "b", "c", "d", None])
        rows.append((i, author, START + dt.timedelta(minutes=i * 7 + draw.randrange(7)), f"t{i}"))
    rows.append((n, "gone", START + dt.timedelta(minutes=1), "once"))
    return [sorted(rows, key=lambda r: r[2])[k * (n + 1) // 3 : (k + 1) * (n + 1) // 3] for k in range(3)]


@pytest.mark.parametrize(("cap", "minutes", "hot"), [(1, 20, False), (2, 30, True), (3, 100_000, False)])
def test_author_cap_with_expiry_equals_a_walk(spark, cap, minutes, hot):
    parts = batches(150, cap, hot)
    items = jobs.feed([spark.createDataFrame(p, SCHEMA) for p in parts], 2)
    capped = jobs.rolling_author_cap(items, cap, time="ts", ttl=f"{minutes} minutes", delay="10 minutes")
    found = jobs.run_available(capped)
    assert found.columns == ["ord", "author", "ts", "text"]
    rows = found.collect()
    assert sorted(r["ord"] for r in rows) == plain_cap([r for p in parts for r in p], cap, dt.timedelta(minutes=minutes))
    assert all(r["text"] in (f"t{r['ord']}", "once") for r in rows)


def test_state_goes_when_event_time_advances(spark):
    parts = batches(60, 4)
    items = jobs.feed([spark.createDataFrame(p, SCHEMA) for p in parts], 2)
    capped = jobs.rolling_author_cap(items, 2, time="ts", ttl="30 minutes", delay="0 seconds")
    base = f"{jobs.scratch_folder(spark)}/{uuid.uuid4().hex}"
    writer = capped.writeStream.option("checkpointLocation", f"{base}/cp").trigger(availableNow=True)
    writer.format("parquet").option("path", f"{base}/out").start().awaitTermination()
    state = spark.read.format("statestore").option("stateVarName", "used").load(f"{base}/cp")
    authors = {r[0] for r in state.select("key.author").collect()}
    newest = max(r[2] for p in parts for r in p)
    recent = {r[1] for p in parts for r in p if r[1] and newest - r[2] <= dt.timedelta(minutes=30)}
    assert "gone" not in authors and authors == recent


def test_author_cap_without_expiry_and_edges(spark):
    parts = batches(90, 7, True)
    items = jobs.feed([spark.createDataFrame(p, SCHEMA) for p in parts], 2)
    rows = jobs.run_available(jobs.rolling_author_cap(items, 2)).collect()
    want, used = [], {}
    for p in parts:  # without a time the order column decides inside a batch
        for o, author, _, _ in sorted(p):
            used[author] = used.get(author, 0) + 1
            if author is None or used[author] <= 2:
                want.append(o)
    assert sorted(r["ord"] for r in rows) == sorted(want)
    with pytest.raises(ValueError, match="time"):
        jobs.rolling_author_cap(items, 2, ttl="1 hour")


def test_late_rows_go_to_the_second_table(spark):
    hour = lambda h: START + dt.timedelta(hours=h)
    parts = [[(1, hour(0)), (2, hour(10)), (3, None)], [(4, hour(7)), (5, hour(8)), (6, hour(30)), (7, hour(2))], [(8, hour(27)), (9, hour(28)), (10, None), (11, hour(9))]]
    items = jobs.feed([spark.createDataFrame(p, "id long, ts timestamp") for p in parts], 1)
    on_time, late = jobs.quarantine_late(items, "ts", "2 hours")
    assert sorted(r["id"] for r in late.collect()) == [4, 7, 8, 11]
    assert sorted(r["id"] for r in on_time.collect()) == [1, 2, 3, 5, 6, 9, 10]


def test_sessions_close_over_batches(spark):
    hour = lambda h: START + dt.timedelta(hours=h)
    parts = [[("a", hour(0)), ("a", hour(3)), ("b", hour(1))], [("a", hour(6)), ("b", hour(9))], [("c", hour(40))]]
    items = jobs.feed([spark.createDataFrame(p, "k string, ts timestamp") for p in parts], 1)
    done = jobs.run_available(jobs.session_counts(items, "ts", "k", "4 hours", "5 hours"))
    got = sorted((r["k"], r["session_start"], r["count"]) for r in done.select("k", "session_start", F.col("count")).collect())
    assert got == [("a", hour(0), 3), ("b", hour(1), 1), ("b", hour(9), 1)]
