"""Line numbers of ledger files from the counts of their splits."""

import pytest
from pyspark.sql import functions as F

from siftstone.sources import ledger


@pytest.fixture
def shards(tmp_path):
    for k, n in enumerate([700, 1, 0, 55]):
        (tmp_path / "sub").mkdir(exist_ok=True)
        # lines of very different length, a blank one, a CR, a last line without LF
        body = "\n".join(f"{k}:{i}:" + "x" * (i * 37 % 900) + ("\r" if i % 5 == 0 else "") for i in range(1, n + 1))
        (tmp_path / ("sub" if k % 2 else ".") / f"s{k}.jsonl").write_bytes(body.encode())
    return str(tmp_path)


@pytest.mark.parametrize("bound", [1 << 22, 0])
def test_numbers_over_many_splits(spark, shards, monkeypatch, bound):
    monkeypatch.setattr(ledger, "SPLITS_BOUND", bound)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = ledger.read_lines(spark, shards, numbered=True)
        assert lines.select("file", "block_start").distinct().count() > 20
        rows = lines.select("value", "line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 756
    assert all(int(r["value"].split(":")[1]) == r["line"] for r in rows)
    assert not any(r["value"].endswith("\r") for r in rows)


def test_no_exchange_carries_the_lines(spark, shards):
    lines = ledger.read_lines(spark, shards, numbered=True, exclude="s3.jsonl")
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
    assert lines.select(F.max("line")).first()[0] == 700


def test_skipped_records_are_counted_in_one_scan(spark):
    values = ['{"record_type": "collection_result", "result": {"ok": true, "channel": "c", "operation": "o", "items": []}}', "[1]", "", "{", '{"a": 1}', "7"]
    lines = spark.createDataFrame([(v, "f", 0, i) for i, v in enumerate(values)], "value string, file string, block_start long, seq long")
    counted = ledger.skipped_records(ledger.parse(lines))
    assert counted.collect()[0][0] == len(values) - 2 - ledger.coerce(ledger.parse(lines)).count()
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
