"""Findings of round 4: near duplicates meet by rare tokens, signals are looked for where a hint holds, the score is computed once."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siftstone.functions import patterns as P
from siftstone.functions import text as T
from siftstone.operators import neardup, noise, score


def _cell(sets):
    lists = lambda values, kind: pa.array(values, pa.list_(kind))
    n = [len(s) for s in sets]
    zero = [0] * len(sets)
    return pa.table(
        {"id": pa.array(range(1, len(sets) + 1), pa.int64()), "n": pa.array(n, pa.int32()), "author": pa.array(zero, pa.int64()), "promo": [i % 3 == 0 for i in range(len(sets))],
         "text_key": pa.array(range(len(sets)), pa.int64()), "prefix": pa.array(range(len(sets)), pa.int64()), "rare": lists([sorted(s) for s in sets], pa.int64()), "common": lists([[]] * len(sets), pa.int16())}
    )


def test_sets_without_rare_tokens_in_common_are_not_compared(monkeypatch):
    rng = random.Random(3)
    # rare words by value first: the low ones
    sets = [set(rng.sample(range(50_000), 30)) | set(rng.sample(range(50_000, 50_300), 30)) for _ in range(1500)]
    sets += [set(list(s)[:58]) | {60_000 + i} for i, s in enumerate(sets[:100])]
    screened = []
    plain = neardup._screened
    monkeypatch.setattr(neardup, "_screened", lambda x, y, i, j: screened.append(len(i)) or plain(x, y, i, j))
    table = _cell(sets)
    words = np.unique(neardup._flat(table["rare"])[0])
    side = neardup._Side(table, words)
    pivot, node = neardup._cell_pairs(side, side, len(words), True, False)
    of = lambda r: {"n": np.array(len(sets[r])), "author": np.array(0), "promo": np.array(r % 3 == 0), "text_key": np.array(r), "prefix": np.array(r)}
    want = {(a + 1, b + 1) for a in range(len(sets)) for b in range(a + 1, len(sets)) if neardup._rule(np.array(len(sets[a] & sets[b])), of(a), of(b))}
    assert len(want) >= 100 and set(zip(pivot.tolist(), node.tolist())) == want
    assert sum(screened) < len(sets) ** 2 // 2 // 20


def test_hints_hold_wherever_a_signal_does(spark):
    rng = random.Random(1)
    words = [w for part in (P.PROCESS, P.OBSERVABLE, P.PROMO_WORDS, P.CTA_VERBS, P.CTA_ENDINGS, P.ANNOUNCEMENT, P.FIRST_PERSON, P.UNITS, P.MONTHS) for w in part.split("|")]
    words = [w.replace(r" #?\p{Nd}+", " #٣").replace("[- ]?", "-").replace("'?", "") for w in words] + ["our team", "$5", "37%", "v2.1", "٣"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", "\n", "é", "_", "-", ".", "x", ""]) for _ in range(rng.randint(1, 4))),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "t string").select(T.plain_lower(F.col("t")).alias("t")).withColumn("h", score._signal_hints("t"))
    exact = dict(process=P.PROCESS_RE, first_person=P.FIRST_HAND_RE, observable_text=P.OBSERVABLE_RE, comparison=P.COMPARISON_RE, specific=P.SPECIFICITY_RE,
                 promo=P.PROMO_RE, commerce=P.COMMERCE_RE, cta=P.CTA_RE, announcement=P.ANNOUNCEMENT_RE, concrete=P.CONCRETE_DETAIL_RE)
    holds = {n: F.col("t").rlike(exact[n]) for n in P.SIGNAL_HINTS}
    missed = [F.count_if(holds[n] & (F.col("h").bitwiseAND(F.lit(1 << i)) == 0)).alias(n) for i, n in enumerate(P.SIGNAL_HINTS)]
    found = df.agg(*missed, *[F.count_if(h).alias(f"{n}_held") for n, h in holds.items()]).first().asDict()
    assert all(found[n] == 0 for n in exact) and found["process_held"] > 100 and found["concrete_held"] > 100


def test_low_content_of_long_blanks_and_stubs(spark):
    rows = [("  \t a  b" + " " * 500 + "c ", None, True), ("abcdefghijkl" + "\n" * 300 + "x", None, False), ("see this:\n ", "quote", True), ("　" * 300 + "one two three", None, False),
            ("a longer stub than twelve:", "quote", True), ("a longer stub than twelve:", "original", False), ("one two three four five six seven eight nine:", "quote", False), (None, None, True)]
    df = spark.createDataFrame(rows, "text string, kind string, want boolean")
    assert df.where(noise.low_content(F.col("text"), F.col("kind")) != F.col("want")).count() == 0


def test_downrank_carries_wanted_columns(spark):
    words = "alpha bravo carol delta early fancy grant hotel india".split()
    rows = [(f"d{i}", i, "a", " ".join(words), float(i % 3), ["original"]) for i in range(6)] + [("s", 9, "a", "short", 1.0, ["reply"]), (None, 10, "a", "none", 2.0, None)]
    df = spark.createDataFrame(rows, "id string, ord long, author string, text string, quality_score double, quality_reasons array<string>").withColumn("title", F.lit(None).cast("string"))
    full = neardup.downrank(df, "id", "ord").select("ord", "quality_score", "quality_reasons")
    some = neardup.downrank(df, "id", "ord", columns=("ord",))
    assert some.columns == ["ord", "quality_score", "quality_reasons"]
    assert sorted(map(str, full.collect())) == sorted(map(str, some.collect()))


def test_wanted_rows_are_chosen_below_their_expressions(spark, capsys):
    from siftstone.plans.skew import fetch_rows

    rows = spark.range(50).select(F.col("id").alias("ord"), F.nullif(F.concat(F.lit("t"), F.col("id")), F.lit("t7")).alias("x"))
    rows = rows.withColumn("y", F.coalesce("x", F.lit("none")))
    found = spark.createDataFrame([("a", 7), ("b", 9), ("c", 9), ("d", None)], "k string, at long")
    out = fetch_rows(found, rows, "at")
    assert {(r["k"], r["y"]) for r in out.collect()} == {("a", "none"), ("b", "t9"), ("c", "t9")}
    out.explain()
    plan = [line for line in capsys.readouterr().out.splitlines() if "Range (0, 50" in line or "LeftSemi" in line or "AS x#" in line or "AS y#" in line]
    made = max(i for i, line in enumerate(plan) if "AS y#" in line)
    assert any("LeftSemi" in line for line in plan[made + 1 :])


def test_plan_moves_points_not_items(spark):
    from siftstone.plans.candidates import plan_candidates

    rows = [(i, f"d{i % 20}", f"post {i % 20} alpha bravo carol delta early fancy", f"a{i % 3}", "original") for i in range(60)]
    items = spark.createDataFrame(rows, "ord long, id string, text string, author string, timeline_item_kind string").withColumn("source", F.lit("s"))
    plan = plan_candidates(items, by="id", limit=5, sort_by="quality_score", drop_noise=True)
    assert plan.points.columns == ["candidate_key", "first_ord", "quality_score", "quality_reasons"]
    top = [(r["quality_score"], r["first_ord"], r["text"]) for r in plan.returned.collect()]
    every = sorted((-r["quality_score"], r["first_ord"], r["text"]) for r in plan.scored.collect())
    assert len(every) == 20 and [(-s, o, t) for s, o, t in top] == every[:5]
