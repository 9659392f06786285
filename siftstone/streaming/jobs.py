"""Structured Streaming jobs over the append-only ledger and its item stream.

Each function takes a streaming DataFrame (a batch one works too, which is how the tests compare both) and returns a
DataFrame; :func:`run_available` drains it once through a checkpointed sink.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, LongType, StructField, StructType, TimestampType

from ..functions.values import throttle_sensitive
from ..operators import noise, score
from ..operators import topic_fit as tf
from ..plans.skew import scratch_folder
from ..sources import ledger

END = "period_end"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ledger_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """Lines of new ledger shards as they arrive."""
    reader = spark.readStream.option("lineSep", "\n").option("recursiveFileLookup", "true")
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.text(path).select(
        F.regexp_replace("value", "\r$", "").alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.lit(0).cast("long").alias("seq"),
    )


def canonical_stream(lines: DataFrame) -> DataFrame:
    """Ledger tail to canonical item rows (stateless, append)."""
    rows = ledger.canonical_items(ledger.parse(lines))
    return rows.withColumn("item", F.to_json("item"))


def scored_stream(items: DataFrame, rules: tf.TopicRules = tf.TopicRules()) -> DataFrame:
    """Noise reasons, topic fit and score of each arriving item (stateless, append)."""
    staged = items.withColumn(
        "drop_reasons",
        noise.noise_reasons(text=F.coalesce("text", "title"), urls=F.col("urls"), kind=F.col("timeline_item_kind"), drop_low_content=True),
    )
    staged = tf.evaluate(staged, tf.candidate_parts(), rules)
    return score.score(score.with_query_hits(staged))


def _timed(items: DataFrame, time: str, delay: str) -> DataFrame:
    """Event time as TIMESTAMP, with the watermark when the input is a stream."""
    rows = items.withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, delay) if items.isStreaming else rows


def first_sightings(items: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """First arrival per key within the watermark; state is bounded by the delay."""
    if items.isStreaming:
        return _timed(items, time, delay).dropDuplicatesWithinWatermark([key])
    return items.dropDuplicates([key])


def seen_counts(items: DataFrame, key: str) -> DataFrame:
    """Running sightings per key; write in update mode and upsert by key."""
    return items.groupBy(key).agg(F.count(F.lit(1)).alias("seen_in_count"))


def window_counts(items: DataFrame, time: str, keys: list[Column | str], size: str, slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Tumbling or sliding counts per key."""
    rows = _timed(items, time, delay)
    grouped = rows.groupBy(F.window(time, size, slide), *keys).agg(F.count(F.lit(1)).alias("count"))
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "count")


def session_counts(items: DataFrame, time: str, key: str, gap: str, delay: str = "1 day") -> DataFrame:
    """Activity sessions per key."""
    rows = _timed(items, time, delay)
    grouped = rows.groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("count"))
    return grouped.select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), key, "count")


def throttle_monitor(log: DataFrame, time: str, size: str, limit: int, delay: str = "1 day") -> DataFrame:
    """Throttle-sensitive errors per window with an alert flag. Expects error_category, error_code and error_message."""
    hit = (F.col("status") == "error") & throttle_sensitive(F.col("error_category"), F.col("error_code"), F.col("error_message"))
    rows = _timed(log, time, delay)
    grouped = rows.groupBy(F.window(time, size)).agg(F.count_if(hit).alias("throttle_errors"), F.count(F.lit(1)).alias("queries"))
    return grouped.select(
        F.col("window.start").alias("window_start"), "queries", "throttle_errors", (F.col("throttle_errors") >= limit).alias("alert")
    )


def _millis(spark: SparkSession, interval: str) -> int:
    """Milliseconds of an interval such as ``4 hours``."""
    return spark.range(1).select(F.expr(f"unix_millis(TIMESTAMP '1970-01-01 00:00:00' + INTERVAL {interval})")).first()[0]


def _heads_task(cap: int, ttl: int | None, author: str, time: str | None, order: str):
    """First ``cap`` rows of each author and activity period of a task's rows, the last of them with the period's end: all that the state needs."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        if not parts:
            return
        rows = pd.concat(parts).sort_values([author, *([time] if time else []), order], kind="stable")
        new = rows[author] != rows[author].shift()
        if ttl is not None:
            new |= rows[time].diff() > pd.Timedelta(milliseconds=ttl)
        period = new.cumsum()
        place = rows.groupby(period).cumcount()
        kept = rows[place < cap].copy()
        if time:
            last = place[place < cap] == (rows.groupby(period)[author].transform("size").clip(upper=cap) - 1)[place < cap]
            kept[END] = kept[time].where(~last, rows.groupby(period)[time].transform("max")[place < cap])
        yield kept

    return task


class _AuthorCap(StatefulProcessor):
    """State of an author: rows kept in the present activity period, and its latest event time in microseconds."""

    def __init__(self, cap: int, ttl: int | None, time: str | None, order: str):
        self.cap, self.ttl, self.time, self.order = cap, ttl, time, order

    def init(self, handle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "n long, seen long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, seen = self.used.get() if self.used.exists() else (0, None)
        before = seen
        batch = pd.concat(list(rows)).sort_values([*([self.time] if self.time else []), self.order], kind="stable")
        if self.ttl is None:
            kept = batch.head(max(self.cap - n, 0))
            n += len(kept)
        else:
            micros = lambda c: batch[c].astype("datetime64[us]").astype("int64")
            take = []
            for at, end in zip(micros(self.time), micros(END), strict=True):
                if seen is not None and at - seen > self.ttl * 1000:
                    n = 0
                take.append(bool(n < self.cap))
                n += take[-1]
                seen = end if seen is None else max(seen, end)
            kept = batch[take]
        self.used.update((int(n), None if seen is None else int(seen)))
        if self.ttl is not None and seen != before:
            if before is not None:
                self.handle.deleteTimer(self._expiry(before))
            self.handle.registerTimer(self._expiry(int(seen)))
        yield kept.drop(columns=END) if self.time else kept

    def _expiry(self, seen: int) -> int:
        """First millisecond at which a row is too late for the period."""
        return seen // 1000 + self.ttl + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.used.clear()
        yield from ()

    def close(self) -> None:
        pass


def rolling_author_cap(
    items: DataFrame, cap: int, *, author: str = "author", order: str = "ord", time: str | None = None, ttl: str | None = None, delay: str = "0 seconds"
) -> DataFrame:
    """Stream of the first ``cap`` rows of each author, by event time and ``order``, over all batches.

    The count of an author lives in the keyed state store and is touched only when the author arrives. With ``time`` and ``ttl`` it starts again for a row
    more than ``ttl`` of event time after the author's latest one (kept or not), and the state goes once the watermark, ``delay`` behind the newest event,
    has passed that point; rows older than the watermark are dropped. Without ``ttl`` counts are kept for ever. Before the shuffle each task cuts its rows
    to ``cap`` per author and period, so an author who fills a batch sends ``cap`` rows per task and period. Rows without author are never capped.
    """
    if ttl is not None and time is None:
        raise ValueError("a ttl needs an event time column")
    millis = None if ttl is None else _millis(items.sparkSession, ttl)
    items.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = items if millis is None else items.withColumn(time, F.col(time).cast("timestamp"))
    fields = rows.schema
    named = rows.where(F.col(author).isNotNull())
    clock = time if millis is not None else None
    heads = StructType([*fields.fields, StructField(END, TimestampType())]) if clock else fields
    cut = named.mapInPandas(_heads_task(cap, millis, author, clock, order), heads)
    if clock:
        cut = cut.withWatermark(time, delay)
    capped = cut.groupBy(author).transformWithStateInPandas(_AuthorCap(cap, millis, clock, order), fields, "Append", "EventTime" if clock else "None")
    return capped.unionByName(rows.where(F.col(author).isNull()))


def run_available(stream: DataFrame, *, mode: str = "append", upsert_key: list[str] | None = None) -> DataFrame:
    """Drain what is available into a checkpointed Parquet table on shared storage and return it.

    ``update`` results are written per batch and reduced to the last value per key, which is what an upsert sink holds.
    """
    spark = stream.sparkSession
    base = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/out").start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/b={number}")

    writer.foreachBatch(write).start().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/out")
    if not upsert_key:
        return rows.drop("__batch")
    values = [c for c in rows.columns if c not in (*upsert_key, "__batch")]
    latest = rows.groupBy(*upsert_key).agg(F.max_by(F.struct(*values), "__batch").alias("v"))
    return latest.select(*upsert_key, "v.*")


def watermark_of(spark: SparkSession, checkpoint: str, number: int) -> int:
    """The stream's own watermark, in milliseconds, with which a batch runs: Spark writes it to the offset log before the batch starts."""
    lines = spark.read.text(f"{checkpoint}/offsets/{number}", wholetext=True).first()[0].splitlines()
    return int(json.loads(lines[1])["batchWatermarkMs"])


def quarantine_late(items: DataFrame, time: str, delay: str) -> tuple[DataFrame, DataFrame]:
    """Drain a stream into two tables: rows on time, and rows older than the watermark their batch ran with.

    The watermark is that of the stream itself (newest event of the batches before, minus ``delay``). A repeated batch finds the same watermark in the
    offset log and overwrites its own output. Rows without event time are on time, as no watermark can pass them.
    """
    spark = items.sparkSession
    base = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = _timed(items, time, delay)

    def step(batch: DataFrame, number: int) -> None:
        bound = F.timestamp_millis(F.lit(watermark_of(spark, f"{base}/checkpoint", number)))
        late = F.coalesce(F.col(time) < bound, F.lit(False))
        batch.withColumn("__late", late).write.mode("overwrite").partitionBy("__late").parquet(f"{base}/out/b={number}")

    writer = rows.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(step).start().awaitTermination()
    schema = StructType([*rows.schema.fields, StructField("__late", BooleanType()), StructField("b", LongType())])
    done = spark.read.schema(schema).parquet(f"{base}/out")
    return tuple(done.where(flag).select(rows.columns) for flag in ("NOT __late", "__late"))


def split_late(items: DataFrame, time: str, delay: str) -> tuple[DataFrame, DataFrame]:
    """Rows on time and rows older than the batch's newest event minus the delay (for a quarantine table).

    Meant for ``foreachBatch``: the bound is one aggregated value per batch.
    """
    newest = items.agg(F.max(time)).first()[0]
    bound = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
    late = F.col(time) < bound
    return items.where(~late), items.where(late)


def feed(parts: list[DataFrame], files: int = 4) -> DataFrame:
    """A file stream that hands over the given tables one micro-batch after another (a replay; each is written in ``files`` files)."""
    spark = parts[0].sparkSession
    base = f"{scratch_folder(spark)}/feed-{uuid.uuid4().hex}"
    for n, part in enumerate(parts):
        part.repartition(files).write.parquet(f"{base}/part={n}")
    found = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true")
    return found.parquet(base)
