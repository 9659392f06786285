"""Several caps together: chains of rows that wait for each other."""

import random

import pytest
from pyspark.sql import functions as F

from siftstone.operators import curate


def frame(spark, rows):
    return spark.createDataFrame(rows, "rank long, author string, thread string, url string").withColumns(
        {"canonical_url": F.lit(None).cast("string"), "identifiers": F.create_map(F.lit("conversation_id"), F.col("thread"))}
    )


def walk(rows, caps):
    used, kept = [{} for _ in caps], []
    for rank, *keys in rows:
        if all(not k or u.get(k, 0) < cap for k, u, cap in zip(keys, used, caps, strict=False)):
            kept.append(rank)
            for k, u in zip(keys, used, strict=False):
                u[k] = u.get(k, 0) + 1
    return kept


def counted(monkeypatch):
    rounds, keep = [], curate.durable
    monkeypatch.setattr(curate, "durable", lambda df, name="step": (rounds.append(name), keep(df, name))[1])
    return rounds


def test_a_long_chain_ends_in_few_rounds(spark, monkeypatch):
    rounds = counted(monkeypatch)
    rows = [(i + 1, f"a{i // 2}", f"t{(i + 1) // 2}", None) for i in range(2000)]
    kept, dropped = curate.apply_diversity(frame(spark, rows), {"author_diversity": 1, "thread_diversity": 1})
    assert sorted(r["rank"] for r in kept.collect()) == walk(rows, [1, 1]) == list(range(1, 2001, 2))
    assert dropped.count() == 1000
    assert rounds.count("diversity") <= 3


@pytest.mark.parametrize(("block", "caps"), [(7, (2, 3, 1)), (50, (1, 1, 4))])
def test_blocks_equal_a_walk(spark, monkeypatch, block, caps):
    monkeypatch.setattr(curate, "FOLD_ROWS", block)
    draw = random.Random(block)
    pick = lambda c, n: draw.choice([None, *[f"{c}{i}" for i in range(n)]])
    rows = [(i + 1, pick("a", 30), pick("t", 25), pick("u", 40)) for i in range(160)]
    kept, dropped = curate.apply_diversity(frame(spark, rows), dict(zip(("author_diversity", "thread_diversity", "url_diversity"), caps, strict=True)))
    want = walk(rows, caps)
    assert sorted(r["rank"] for r in kept.collect()) == want
    assert dropped.count() == len(rows) - len(want) and dropped.where("reason IS NULL").count() == 0
