"""Work that has to stay in proportion to the rows."""

import re
import time

from pyspark.sql import functions as F

from registry.base import Tables
from siftstone.functions import text as T
from siftstone.operators import curate
from siftstone.plans.skew import durable, number_within

TEXTS = ["plain", "Straße", "ſharp K", "日本語テキスト", "ǰ", "ﬁn", "𝐀bc", "ꭰ", "aͅ", "é", "①", "", None, "xµ", "\U0001f600 ok"]


def test_folding_and_nfkc_over_all_kinds_of_characters(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    rows = df.select("t", T.casefold(F.col("t")).alias("f"), T.norm_text(F.col("t")).alias("n")).collect()
    for r in rows:
        assert r["f"] == (None if r["t"] is None else r["t"].casefold())
        assert r["n"] == (None if r["t"] is None else T.norm_literal(r["t"]))


def test_outside_is_the_negated_class(spark):
    every = spark.range(0x80, 0x3400).where("id < 55296").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    every = every.select(F.concat(F.lit("ab"), "c", F.lit("z")).alias("c"))
    for ranges in (T._NFKC_STABLE, "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in T._FOLD_SAFE)):
        assert every.where(F.col("c").rlike(T._outside(ranges)) != F.col("c").rlike(f"[^{ranges}]")).isEmpty()


def test_character_tests_are_not_a_range_scan_per_ascii_letter(spark):
    """Before, each ASCII letter went through a class of many ranges: ten times the time of lowering the text."""
    long = spark.range(4).select(F.concat(F.lit("é"), F.repeat(F.lit("some plain words "), 400_000)).alias("t"))

    def spent(column):
        best = []
        for _ in range(3):
            started = time.time()
            long.agg(F.max(F.xxhash64(column))).collect()
            best.append(time.time() - started)
        return min(best)

    assert re.match(r"\[\^\\x00-\\x7F\]", T._fold_class())
    assert spent(F.col("t").rlike(T._fold_class())) < spent(F.col("t").rlike("[^" + T._NFKC_STABLE + "]")) / 2


def test_numbered_rows_are_computed_once_and_moved_narrow(spark):
    """Before, sampling the range bounds computed every row a second time, and whole rows were range-partitioned."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.range(1000).select("id", F.pmod(F.col("id") * 7919, F.lit(1000)).alias("k"), F.repeat(F.lit("x"), 50).alias("text"))
    numbered = number_within(rows.mapInPandas(count, "id long, k long, text string"), [], ["k"], running={"total": F.col("k")})
    got = numbered.orderBy("position").collect()
    assert numbered.columns == ["id", "k", "text", "position", "total"]
    assert [(r["position"], r["k"], r["total"]) for r in got] == [(i + 1, i, i * (i + 1) // 2) for i in range(1000)]
    assert all(r["text"] == "x" * 50 and (r["id"] * 7919) % 1000 == r["k"] for r in got)
    assert seen.value == 1000


def test_post_filter_writes_decisions_and_no_texts(spark, monkeypatch):
    """Before, whole candidates were written once more with their drop reasons."""
    rows = [(f"k{i}", i, f"a{i % 2}", f"title number {i} of the candidates", "some text", 3) for i in range(9)]
    df = spark.createDataFrame(rows, "candidate_key string, first_ord long, author string, title string, text string, seen_in_count long")
    written = []
    monkeypatch.setattr(curate, "durable", lambda d, name="step": written.append(d.columns) or durable(d, name))
    out = curate.post_filter(df, min_seen_in=2, drop_title_duplicates=True, max_per_author=2)
    assert sorted(r["candidate_key"] for r in out.survivors.collect()) == ["k0", "k1", "k2", "k3"]
    assert out.survivors.columns == df.columns and set(out.staged.columns) == {*df.columns, "drop_reasons"}
    assert written and not any("text" in columns for columns in written)


def test_texts_of_sightings_are_joined_last(spark):
    """Before, the joined texts were moved again by the join with the pages, once per sighting."""
    plan = Tables(spark, "/root/testdata/sf0.001").sightings().select("ord", "text", "url")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    assert "k#" in joins[0] and "page_id#" in joins[1]
