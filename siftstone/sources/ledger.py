"""Evidence ledger: JSONL scan, record coercion, health and query reports, and the sinks.

A *lines* frame has ``value`` (one JSON text per physical line), ``file``, ``block_start`` and ``seq``; the last three order
the lines. A *records* frame adds the parsed VARIANT ``rec`` and a ``state``.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.items import MEDIA_TYPE, raw_type
from ..plans.skew import durable, number_within, top_per_group
from .jsonpath import filter_column, project

SCHEMA_VERSION = "2026-04-10"
LARGE_TEXT_CHARS = 10_000
LARGE_RAW_CHARS = 100_000
SAMPLE_LIMIT = 50
#: splits whose line offsets are broadcast
SPLITS_BOUND = 1 << 22
_META = ("intent", "query_id", "source_role")


# ---- scan --------------------------------------------------------------------------------------------------------


def read_lines(spark: SparkSession, path: str, *, exclude: str | None = None, numbered: bool = False) -> DataFrame:
    """Physical lines of one ledger file or of every text shard below a folder (``*.jsonl``, or ``part-*`` files as written here).

    Lines break on LF only, so Unicode separators inside strings stay; a trailing CR is removed. ``exclude`` is the path of one file to leave out. A
    path that holds no shard is an error. ``numbered`` adds ``line``, the 1-based line of each file, without moving any line.
    """
    reader = spark.read.option("lineSep", "\n")
    if not str(path).endswith(".jsonl"):
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "{*.jsonl,part-*}")
    found = reader.text(str(path))
    if not found.inputFiles():
        raise FileNotFoundError(f"no ledger shard in {path}")
    raw = found.select(
        F.regexp_replace("value", "\r$", "").alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("seq"),
    )
    if numbered:
        raw = _numbered(raw)
    if exclude is not None:
        whole = lambda c: F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
        other = str(exclude) if "/" in str(exclude) else f"{str(path).rstrip('/')}/{exclude}"
        raw = raw.where(whole(F.col("file")) != whole(F.lit(other if other.startswith("/") or ":" in other else os.path.abspath(other))))
    return raw


def _numbered(raw: DataFrame) -> DataFrame:
    """Lines as the reader gives them, with ``line``.

    The lines of one split stand in order in one task, so ``seq`` counts them without gaps: only the counts of the splits are summed up (16 bytes a split,
    broadcast up to :data:`SPLITS_BOUND` of them) and added to the place inside the split.
    """
    split = F.xxhash64("file", "block_start")
    sizes = raw.groupBy("file", "block_start").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(before), F.lit(0)) + 1 - F.col("first")
    offsets = durable(sizes.select(split.alias("__split"), F.col("block_start").alias("__start"), offset.alias("__offset")), "splits")
    offsets = F.broadcast(offsets) if offsets.count() <= SPLITS_BOUND else offsets
    lines = raw.withColumn("__split", split).withColumn("__start", F.col("block_start"))
    return lines.join(offsets, ["__split", "__start"]).select(*raw.columns, (F.col("seq") + F.col("__offset")).alias("line"))


def line_order() -> Column:
    """First-seen order of lines: lower-cased path, path, split start, position inside the split."""
    return F.struct(F.lower("file").alias("f"), F.col("file").alias("g"), F.col("block_start").alias("b"), F.col("seq").alias("s"))


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """Add the 1-based ``line`` inside each file, for lines of any origin: one range shuffle. Files are numbered by :func:`read_lines` itself."""
    return number_within(lines, ["file"], ["block_start", "seq"], position="line")


def _get(value: Column, path: str, dtype: str = "string") -> Column:
    return F.try_variant_get(value, f"$.{path}", dtype)


def _kind(value: Column, path: str) -> Column:
    return F.schema_of_variant(_get(value, path, "variant"))


def is_result(value: Column, below: str = "") -> Column:
    """Strict envelope check used by the ledger reports: six typed keys.

    ``below`` is the path of the envelope in ``value``, as ``result.``: taking the envelope out first would copy all of it for each key.
    """
    return (
        F.coalesce(_kind(value, f"{below}channel") == "STRING", F.lit(False))
        & F.coalesce(_kind(value, f"{below}operation") == "STRING", F.lit(False))
        & F.coalesce(_kind(value, f"{below}ok") == "BOOLEAN", F.lit(False))
        & _get(value, f"{below}items", "array<variant>").isNotNull()
        & _get(value, f"{below}meta", "map<string,variant>").isNotNull()
        & _get(value, f"{below}error", "variant").isNotNull()
    )


def is_result_lenient(value: Column) -> Column:
    """Planner's envelope check: all keys present, items a list."""
    present = _get(value, "items", "array<variant>").isNotNull()
    for name in ("ok", "channel", "operation", "meta", "error"):
        present = present & _get(value, name, "variant").isNotNull()
    return present


def parse(lines: DataFrame) -> DataFrame:
    """Parse each line. ``state`` is empty, invalid_line, not_object, invalid_record or ok; no line is lost."""
    blank = F.length(T.strip(F.col("value"))) == 0
    parsed = T.evaluate_once(lines, rec=F.try_parse_json(F.when(~blank, F.col("value"))))
    an_object = F.startswith(F.schema_of_variant("rec"), F.lit("OBJECT"))
    valid = (_get(F.col("rec"), "record_type") == "collection_result") & is_result(F.col("rec"), "result.")
    state = (
        F.when(blank, F.lit("empty"))
        .when(F.col("rec").isNull(), F.lit("invalid_line"))
        .when(~an_object, F.lit("not_object"))
        .when(F.coalesce(valid, F.lit(False)), F.lit("ok"))
        .otherwise(F.lit("invalid_record"))
    )
    return T.evaluate_once(parsed, state=state)


def objects(parsed: DataFrame) -> DataFrame:
    """Tolerant scan: every line that holds a JSON object."""
    return parsed.where(F.col("state").isin("ok", "invalid_record"))


def check_strict(parsed: DataFrame) -> None:
    """Strict scan: raise on the first malformed line."""
    bad = parsed.where("state = 'invalid_line'").orderBy(line_order()).limit(1).collect()
    if bad:
        raise ValueError(f"invalid JSONL in {bad[0]['file']}: {bad[0]['value'][:80]}")


def _with_result(parsed: DataFrame) -> DataFrame:
    """Each object's collection result: that of a record, or the object itself."""
    rec = F.col("rec")
    return T.evaluate_once(parsed, result=F.when(_wrapped(), _get(rec, "result", "variant")).otherwise(rec))


def _wrapped() -> Column:
    return F.coalesce(_get(F.col("rec"), "record_type") == "collection_result", F.lit(False))


def coerce(parsed: DataFrame) -> DataFrame:
    """Collection records out of ledger records or bare results, with provenance from the record or the result's meta.

    Rows that are neither are left out; count them as :func:`skipped_records`.
    """
    rec, wrapped = F.col("rec"), _wrapped()
    staged = _with_result(objects(parsed))
    staged = staged.where(F.coalesce(is_result_lenient(F.col("result")), F.lit(False)))
    result = F.col("result")

    def provenance(name: str) -> Column:
        return F.when(wrapped, _get(rec, name)).otherwise(_get(result, f"meta.{name}"))

    return staged.select(
        line_order().alias("line_ord"),
        _get(rec, "run_id").alias("run_id"),
        _get(result, "channel").alias("channel"),
        _get(result, "operation").alias("operation"),
        F.coalesce(provenance("input"), _get(result, "meta.input")).alias("input"),
        *[F.coalesce(provenance(n), _get(result, f"meta.{n}")).alias(n) for n in _META],
        _get(result, "meta.query_tokens", "array<string>").alias("meta_tokens"),
        _get(result, "items", "array<variant>").alias("items"),
        F.col("result"),
    )


def skipped_records(parsed: DataFrame) -> DataFrame:
    """One row: non-blank, well-formed records that are no collection result."""
    records = _with_result(parsed.where(~F.col("state").isin("empty", "invalid_line")))
    good = F.col("state").isin("ok", "invalid_record") & F.coalesce(is_result_lenient(F.col("result")), F.lit(False))
    return records.agg(F.count_if(~good).alias("skipped_records"))


def executed_queries(parsed: DataFrame) -> DataFrame:
    """The queries whose results a ledger holds: identity fields, ``ok`` and ``applied_defaults``, as :func:`siftstone.operators.batch.resume_keys` takes them.

    One row per collection record with a channel, an operation and an input, whatever else it lacks; other lines are left out. Provenance comes from the
    record and otherwise from the result or its meta. ``exclude`` and ``has`` given as one text become a list of one.
    """
    staged = objects(parsed).where(_get(F.col("rec"), "record_type") == "collection_result")
    staged = T.evaluate_once(staged, meta=_get(F.col("rec"), "result.meta", "variant"))
    rec, meta = F.col("rec"), F.col("meta")
    filled = lambda c: F.when(F.length(c) > 0, c)

    def listed(name: str) -> Column:
        return F.coalesce(_get(meta, name, "array<string>"), F.when(_kind(meta, name) == "STRING", F.array(_get(meta, name))))

    plain = (
        "since until from_user to_user lang search_type min_likes min_retweets min_views originals_only quality_profile raw_mode raw_max_bytes "
        "item_text_mode item_text_max_chars"
    ).split()
    found = staged.select(
        F.coalesce(filled(_get(rec, "channel")), filled(_get(rec, "result.channel"))).alias("channel"),
        F.coalesce(filled(_get(rec, "operation")), filled(_get(rec, "result.operation"))).alias("operation"),
        F.coalesce(_get(rec, "input"), _get(meta, "input")).alias("input"),
        F.coalesce(_get(meta, "requested_limit"), _get(meta, "limit")).alias("limit"),
        F.coalesce(_get(rec, "intent"), _get(meta, "intent")).alias("intent"),
        *[_get(meta, n).alias(n) for n in plain],
        listed("has").alias("has"),
        listed("exclude").alias("exclude"),
        F.to_json(_get(meta, "topic_fit", "variant")).alias("topic_fit"),
        F.coalesce(_get(rec, "result.ok", "boolean"), _get(rec, "ok", "boolean"), F.lit(False)).alias("ok"),
        F.map_filter(
            F.transform_values(_get(meta, "applied_defaults", "map<string,variant>"), lambda _, v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))),
            lambda _, v: v.isNotNull(),
        ).alias("applied_defaults"),
    )
    return found.where((F.length("channel") > 0) & (F.length("operation") > 0) & (F.length("input") > 0))


IDENTIFIERS = ("domain", "author_handle", "post_id", "conversation_id")


def _identifiers(item: Column) -> Column:
    """The item's identifiers, completed by extras of the same name."""
    given = F.coalesce(_get(item, "identifiers", "map<string,string>"), F.create_map().cast("map<string,string>"))
    given = F.map_filter(given, lambda _, v: v.isNotNull())
    extra = F.array_compact(
        F.array(
            *[
                F.when(_get(item, f"extras.{n}").isNotNull() & ~F.map_contains_key(given, F.lit(n)), F.struct(F.lit(n).alias("key"), _get(item, f"extras.{n}").alias("value")))
                for n in IDENTIFIERS
            ]
        )
    )
    return F.map_concat(given, F.map_from_entries(extra))


def items_of(records: DataFrame) -> DataFrame:
    """One row per stored item, typed, with its sighting columns and ``ord``."""
    rows = records.select("*", F.posexplode("items").alias("item_position", "item")).drop("items", "result")
    rows = rows.where(_get(F.col("item"), "id", "variant").isNotNull() | F.startswith(F.schema_of_variant("item"), F.lit("OBJECT")))
    item = F.col("item")
    tokens = F.when(
        F.col("meta_tokens").isNotNull(),
        F.array_distinct(F.filter(F.transform("meta_tokens", T.casefold), lambda t: F.length(T.strip(t)) > 0)),
    ).when(F.col("operation").isin("search", "hashtag"), T.query_tokens(F.col("input")))

    def extra(name: str, dtype: str = "string") -> Column:
        return _get(item, f"extras.{name}", dtype)

    out = rows.select(
        F.struct("line_ord", "item_position").alias("ord"),
        "run_id",
        "channel",
        "operation",
        "input",
        *[F.coalesce(F.col(n), extra(n)).alias(n) for n in _META],
        F.coalesce(tokens, F.array().cast("array<string>")).alias("query_tokens"),
        *[
            _get(item, n).alias(n)
            for n in ("id", "kind", "title", "url", "canonical_url", "source_item_id", "text", "author", "published_at", "source")
        ],
        F.map_filter(
            F.coalesce(
                F.transform_values(
                    _get(item, "engagement", "map<string,variant>"), lambda _, v: F.try_variant_get(v, "$", "double")
                ),
                F.create_map().cast("map<string,double>"),
            ),
            lambda _, v: v.isNotNull(),
        ).alias("engagement"),
        F.coalesce(_get(item, "media_references", f"array<{MEDIA_TYPE}>"), F.array().cast(f"array<{MEDIA_TYPE}>")).alias(
            "media_references"
        ),
        _identifiers(item).alias("identifiers"),
        *[extra(n).alias(n) for n in ("timeline_item_kind", "author_name", "quoted_author_handle", "quoted_author_name")],
        extra("urls", "array<string>").alias("urls"),
        extra("query_tokens", "array<string>").alias("item_query_tokens"),
        F.coalesce(
            _get(item, "coverage_topics", "array<struct<topic_id:string,label:string>>"),
            extra("coverage_topics", "array<struct<topic_id:string,label:string>>"),
        ).alias("coverage_topics"),
    )
    return out


# ---- build and sinks ---------------------------------------------------------------------------------------------


def build_records(results: DataFrame, run_id: Column | str, created_at: Column | str | None = None) -> DataFrame:
    """Ledger records around results (a VARIANT column ``result``). Annotation columns input, intent, query_id and source_role,
    where the frame has them, win over the result's meta."""
    result = F.col("result")
    items = _get(result, "items", "array<variant>")
    text = lambda name: F.filter(
        F.transform(items, lambda i: F.try_variant_get(i, f"$.{name}", "string")), lambda s: F.length(s) > 0
    )
    note = lambda n: F.coalesce(F.col(n), _get(result, f"meta.{n}")) if n in results.columns else _get(result, f"meta.{n}")
    made = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'") if created_at is None else created_at
    return results.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit("collection_result").alias("record_type"),
        (F.lit(run_id) if isinstance(run_id, str) else run_id).alias("run_id"),
        (F.lit(made) if isinstance(made, str) else made).alias("created_at"),
        _get(result, "channel").alias("channel"),
        _get(result, "operation").alias("operation"),
        note("input").alias("input"),
        F.coalesce(_get(result, "ok", "boolean"), F.lit(False)).alias("ok"),
        F.coalesce(_get(result, "meta.count", "int"), F.size(items)).alias("count"),
        text("id").alias("item_ids"),
        text("url").alias("urls"),
        _get(result, "error.code").alias("error_code"),
        *[note(n).alias(n) for n in _META],
        "result",
    )


def escape_separators(text: Column) -> Column:
    """Write the three Unicode line separators as JSON escapes."""
    for point in ("0085", "2028", "2029"):
        text = F.replace(text, F.lit(chr(int(point, 16))), F.lit("\\u" + point))
    return text


def to_lines(records: DataFrame, columns: Sequence[str] | None = None) -> Column:
    return escape_separators(F.to_json(F.struct(*(columns or records.columns)), {"ignoreNullFields": "false"}))


def append_records(records: DataFrame, path: str, *, shard_by: Sequence[str] = ()) -> None:
    """Append records as JSONL below a folder; ``shard_by`` (channel, operation, run_id) makes one sub-folder per value."""
    lines = records.select(*[T.shard_part(F.col(c), c).alias(f"shard_{c}") for c in shard_by], to_lines(records).alias("value"))
    writer = lines.write.mode("append").option("lineSep", "\n")
    if shard_by:
        writer = writer.partitionBy(*[f"shard_{c}" for c in shard_by])
    writer.text(path)


def append_results(spark: SparkSession, results_path: str, out_path: str, run_id: str) -> DataFrame:
    """Wrap saved result documents (one JSON object per file) as ledger records and append them. Returns the rejected files."""
    docs = (
        spark.read.option("wholetext", "true")
        .text(results_path)
        .select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("result"))
    )
    good = F.coalesce(is_result(F.col("result")), F.lit(False))
    append_records(build_records(docs.where(good).select("result"), run_id), out_path)
    return docs.where(~good).select("file")


def merge(lines: DataFrame, path: str, *, single_file: bool = False) -> DataFrame:
    """Ordered concatenation of shards without blank lines. Returns (files_merged, records_written).

    The output folder is range-partitioned in ledger order, so file order is line order; ``single_file`` is a compatibility
    mode for small ledgers.
    """
    kept = lines.where(F.length(T.strip(F.col("value"))) > 0)
    ordered = kept.select(escape_separators(F.col("value")).alias("value"), line_order().alias("o")).orderBy("o").select("value")
    (ordered.coalesce(1) if single_file else ordered).write.mode("overwrite").option("lineSep", "\n").text(path)
    return kept.agg(F.count_distinct("file").alias("files_merged"), F.count(F.lit(1)).alias("records_written"))


def canonical_items(parsed: DataFrame) -> DataFrame:
    """One row per item with its record's provenance."""
    rec = F.col("rec")
    rows = objects(parsed).select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit("canonical_item").alias("record_type"),
        _get(rec, "run_id").alias("run_id"),
        F.coalesce(_get(rec, "channel"), _get(rec, "result.channel")).alias("channel"),
        F.coalesce(_get(rec, "operation"), _get(rec, "result.operation")).alias("operation"),
        _get(rec, "input").alias("input"),
        *[_get(rec, n).alias(n) for n in _META],
        F.explode(_get(rec, "result.items", "array<variant>")).alias("item"),
    )
    return rows.where(F.startswith(F.schema_of_variant("item"), F.lit("OBJECT")))


def write_jsonl(df: DataFrame, path: str, order: str | None = None) -> None:
    """Rows as JSON lines, in ``order`` when given (ranked and judge outputs)."""
    (df.orderBy(order) if order else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


# ---- reports -----------------------------------------------------------------------------------------------------


def _context(parsed: DataFrame, paths: Sequence[str]):
    """Where a path starts: ``source.file`` and ``source.line`` at the line's provenance, everything else at the record."""
    source = F.to_variant_object(F.struct(F.struct(*[c for c in ("file", "line") if c in parsed.columns]).alias("source")))
    return lambda path: source if path.strip().startswith("source.") else F.col("rec")


def _record_columns(parsed: DataFrame, filters: Sequence[str]) -> DataFrame:
    rec = F.col("rec")
    ok = parsed.where("state = 'ok'")
    pick = _context(parsed, filters)
    for expression in filters:
        ok = ok.where(filter_column(pick(expression), [expression]))
    result = _get(rec, "result", "variant")
    meta = lambda n, d="string": _get(rec, f"result.meta.{n}", d)
    note = lambda n: F.coalesce(_get(rec, n), meta(n))
    raw = _get(result, "raw", "variant")
    raw_absent = raw.isNull() | F.is_variant_null(raw)
    items = _get(result, "items", "array<variant>")
    text = F.transform(
        items, lambda i: F.when(F.schema_of_variant(F.try_variant_get(i, "$.text", "variant")) == "STRING", F.try_variant_get(i, "$.text", "string"))
    )
    staged = ok.select("file", "block_start", "seq", "rec", items.alias("items"), text.alias("texts"))
    size = F.when(raw_absent, F.lit(0)).otherwise(
        F.when(raw_type(raw) == "str", F.length(F.try_variant_get(raw, "$", "string"))).otherwise(F.length(F.to_json(raw)))
    )
    lengths = F.transform(F.array_compact("texts"), lambda t: F.length(t))
    return staged.select(
        "file",
        "block_start",
        "seq",
        F.coalesce(_get(rec, "channel"), _get(result, "channel"), F.lit("unknown")).alias("channel"),
        F.coalesce(_get(rec, "operation"), _get(result, "operation"), F.lit("unknown")).alias("operation"),
        F.coalesce(_get(result, "ok", "boolean"), F.lit(False)).alias("ok"),
        F.coalesce(_get(rec, "error_code"), _get(result, "error.code")).alias("error_code"),
        *[note(n).alias(n) for n in _META],
        F.coalesce(meta("raw_mode"), F.when(raw_absent, F.lit("none")).otherwise(F.lit("full"))).alias("raw_mode"),
        F.coalesce(
            meta("item_text_mode"), F.when(F.size(F.array_compact("texts")) > 0, F.lit("full")).otherwise(F.lit("none"))
        ).alias("item_text_mode"),
        meta("search_type").alias("search_type"),
        F.coalesce(meta("raw_payload_bytes").try_cast("bigint"), size.cast("bigint")).alias("raw_bytes"),
        F.size("items").alias("n_items"),
        F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("text_chars"),
        F.size(F.filter(lengths, lambda n: n > LARGE_TEXT_CHARS)).alias("large_texts"),
        F.coalesce(meta("diagnostics.unbounded_time_window", "boolean"), F.lit(False)).alias("unbounded"),
        meta("filter_drop_counts", "map<string,string>").alias("drop_counts"),
        F.transform("items", lambda i: F.try_variant_get(i, "$.extras.timeline_item_kind", "string")).alias("kinds"),
    )


def missing_fields() -> Column:
    return T.reason_list(*[(n, F.col(n).isNull()) for n in _META])


def health(parsed: DataFrame, *, filters: Sequence[str] = (), require_metadata: bool = False) -> DataFrame:
    """Ledger health as one long table (section, key, count).

    Totals and every count map come out of a single exploded aggregation per input: lines feed the validity counters, valid
    (and matching) records feed the rest.
    """
    records = durable(_record_columns(parsed, filters), "ledger")

    def entry(section: str, key: Column | str, n: Column | int = 1) -> Column:
        return F.struct(
            F.lit(section).alias("section"),
            (F.lit(key) if isinstance(key, str) else key.cast("string")).alias("key"),
            (F.lit(n) if isinstance(n, int) else n).cast("long").alias("n"),
        )

    def when_present(section: str, col: str) -> Column:
        return F.when(F.length(col) > 0, entry(section, F.col(col)))

    missing = missing_fields()
    base = F.array(
        entry("total", "records"),
        entry("total", F.when(F.col("ok"), F.lit("ok_records")).otherwise(F.lit("error_records"))),
        entry("total", "items_seen", F.col("n_items")),
        entry("total", "raw_payload_bytes_total", F.col("raw_bytes")),
        entry("total", "item_text_chars_total", F.col("text_chars")),
        entry("total", "large_text_fields", F.col("large_texts")),
        entry("total", "large_raw_payloads", (F.col("raw_bytes") > LARGE_RAW_CHARS).cast("int")),
        entry("total", "unbounded_time_window_records", F.col("unbounded").cast("int")),
        entry("missing_metadata", "records", (F.size(missing) > 0).cast("int")),
        when_present("channel", "channel"),
        when_present("operation", "operation"),
        F.when(~F.col("ok") & (F.length("error_code") > 0), entry("error_code", F.col("error_code"))),
        *[when_present(n, n) for n in (*_META, "raw_mode", "item_text_mode", "search_type")],
    )
    entries = F.concat(
        F.array_compact(base),
        F.transform(missing, lambda m: F.struct(F.lit("missing_metadata").alias("section"), m.alias("key"), F.lit(1).cast("long").alias("n"))),
        F.transform(
            F.filter("kinds", lambda k: F.length(k) > 0),
            lambda k: F.struct(F.lit("timeline_item_kind").alias("section"), k.alias("key"), F.lit(1).cast("long").alias("n")),
        ),
        F.coalesce(
            F.transform(
                F.filter(F.map_entries("drop_counts"), lambda e: e["value"].try_cast("bigint").isNotNull()),
                lambda e: F.struct(
                    F.lit("filter_drop_reason").alias("section"), e["key"].alias("key"), e["value"].try_cast("bigint").alias("n")
                ),
            ),
            F.array().cast("array<struct<section:string,key:string,n:bigint>>"),
        ),
    )
    from_records = records.select(F.explode(entries).alias("e")).select("e.*")
    line_key = (
        F.when(F.col("state") == "ok", F.lit("records_scanned"))
        .when(F.col("state") == "empty", F.lit("empty_lines"))
        .when(F.col("state") == "invalid_line", F.lit("invalid_lines"))
        .otherwise(F.lit("invalid_records"))
    )
    from_lines = parsed.select(F.lit("total").alias("section"), line_key.alias("key"), F.lit(1).cast("long").alias("n"))
    counts = from_records.unionByName(from_lines).groupBy("section", "key").agg(F.sum("n").alias("count"))
    files = parsed.agg(F.count_distinct("file").cast("long").alias("count")).select(F.lit("total").alias("section"), F.lit("files_checked").alias("key"), "count")
    broken = (F.col("section") == "total") & F.col("key").isin("invalid_lines", "invalid_records")
    if require_metadata:
        broken = broken | (F.col("section") == "missing_metadata") & (F.col("key") == "records")
    verdict = counts.agg((F.coalesce(F.sum(F.when(broken, F.col("count"))), F.lit(0)) == 0).cast("long").alias("count"))
    return counts.unionByName(files).unionByName(verdict.select(F.lit("total").alias("section"), F.lit("valid").alias("key"), "count"))


def summary(parsed: DataFrame, filters: Sequence[str] = ()) -> DataFrame:
    """Health without the diagnostics-only totals."""
    diagnostic = (F.col("section") == "total") & F.col("key").isin("large_text_fields", "large_raw_payloads", "empty_lines", "files_checked")
    return health(parsed, filters=filters).where(~diagnostic)


def query_totals(parsed: DataFrame, filters: Sequence[str] = ()) -> DataFrame:
    """One row for a query: records scanned, records that match, invalid lines."""
    pick = _context(parsed, filters)
    match = F.col("state").isin("ok", "invalid_record")
    for expression in filters:
        match = match & filter_column(pick(expression), [expression])
    return parsed.agg(
        F.count_if(F.col("state").isin("ok", "invalid_record")).alias("scanned_records"),
        F.count_if(F.coalesce(match, F.lit(False))).alias("matched_records"),
        F.count_if(F.col("state") == "invalid_line").alias("invalid_lines"),
    )


def health_samples(parsed: DataFrame, n: int = SAMPLE_LIMIT) -> DataFrame:
    """First n lines per kind of problem: (problem, file, block_start, seq, detail)."""
    rows = parsed.where(F.col("state").isin("invalid_line", "not_object", "invalid_record")).select(
        F.col("state").alias("problem"), "file", "block_start", "seq", F.left("value", F.lit(160)).alias("detail")
    )
    missing = (
        _record_columns(parsed, ())
        .where(F.size(missing_fields()) > 0)
        .select(
            F.lit("missing_metadata").alias("problem"), "file", "block_start", "seq", F.array_join(missing_fields(), ",").alias("detail")
        )
    )
    order = [F.lower("file"), F.col("file"), F.col("block_start"), F.col("seq")]
    return top_per_group(rows.unionByName(missing), ["problem"], order, n, "sample")


def query(
    parsed: DataFrame, *, filters: Sequence[str] = (), fields: Sequence[str] | None = None, limit: int | None = None
) -> DataFrame:
    """Records that match every filter, in ledger order, projected to JSON text columns named after their paths.

    Paths below ``source`` reach the record's ``file`` and ``line``; those need :func:`with_line_numbers` first.
    """
    found = objects(parsed)
    pick = _context(parsed, [*filters, *(fields or ())])
    for expression in filters:
        found = found.where(filter_column(pick(expression), [expression]))
    if limit is not None:
        found = found.orderBy(line_order()).limit(limit)
    if not fields:
        return found.select("file", "block_start", "seq", "rec")
    return found.select("file", "block_start", "seq", *[project(pick(f), f.strip()).alias(f.strip()) for f in fields if f.strip()])


