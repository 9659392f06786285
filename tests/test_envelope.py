"""Keys of a record's result are read where they are."""

from siftstone.sources import ledger

GOOD = '{"record_type":"collection_result","channel":"c","result":{"channel":"w","operation":"o","ok":true,"items":[{"id":"a"},3],"meta":{},"error":null}}'
LINES = [
    (GOOD, "ok"),
    (GOOD.replace('"ok":true', '"ok":1'), "invalid_record"),
    (GOOD.replace('"meta":{}', '"meta":[]'), "invalid_record"),
    (GOOD.replace(',"error":null', ""), "invalid_record"),
    (GOOD.replace('"items":[{"id":"a"},3]', '"items":{}'), "invalid_record"),
    ('{"record_type":"collection_result","result":"text"}', "invalid_record"),
    ('{"record_type":"collection_result","result":[1]}', "invalid_record"),
    ('{"record_type":"collection_result","result":null}', "invalid_record"),
    ('{"record_type":"collection_result"}', "invalid_record"),
    ("[1]", "not_object"),
    ("{", "invalid_line"),
    (" ", "empty"),
]


def test_envelope_is_not_copied_for_each_key(spark):
    """Before, every key tested or read made a copy of the whole result."""
    rows = [(value, "f", 0, n) for n, (value, _) in enumerate(LINES)]
    parsed = ledger.parse(spark.createDataFrame(rows, "value string, file string, block_start long, seq long"))
    assert [r["state"] for r in parsed.orderBy("seq").collect()] == [state for _, state in LINES]
    items = ledger.canonical_items(parsed)
    assert [(r["channel"], r["operation"]) for r in items.select("channel", "operation").collect()] == [("c", "o")] * 4
    assert "$.result, VariantType" not in items._jdf.queryExecution().optimizedPlan().toString()
