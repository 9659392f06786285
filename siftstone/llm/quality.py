"""Quality selection by importance resampling.

Two generative models over hashed n-grams, one of the target (documents labelled good) and one of the raw corpus (all documents), give each document the
log of its importance weight, the sum of log p_target / p_raw over its n-grams. Adding Gumbel noise to the log weights and taking the k largest
samples k documents without replacement in proportion to their weights. k is the number of documents whose odds of being target
text, weight x target prior, reach :data:`LEAST_POSTERIOR`.

N-grams: words and marks, adjacent pairs, and two pair classes that every repetition falls in (a token equal to the one before it, or to
the one two before it), hashed into :data:`BUCKETS`. Log ratios are fixed-point integers, so sums do not depend on how rows are batched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.words import KINDS, Words, as_bytes, blocks, mix, shingles, words
from siftstone.plans.skew import durable, number_within

BUCKETS = 1 << 14
#: labelled documents the target model is fitted on, those with the least id hash; the raw model takes every document
MAX_LABELLED = 50_000
LEAST_POSTERIOR = 0.1
SCALE = 1 << 20
_SAME, _SKIP = 1, 2  # classes of repetitions; their buckets are theirs alone


def _grams(w: Words, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, index of the first token) of every n-gram, per kind."""
    hashed = lambda h: (h % np.uint64(size - 3)).astype(np.int64) + 3
    out = [(hashed(w.code), np.arange(len(w.code)))]
    pairs, at = shingles(w, 2)
    same = w.code[at] == w.code[at + 1]
    out.append((np.where(same, _SAME, hashed(pairs)), at))
    _, at = shingles(w, 3)
    at = at[w.code[at] == w.code[at + 2]]
    out.append((np.full(len(at), _SKIP, np.int64), at))
    return out


def _count_task(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for part in blocks(batch):
                w = words(as_bytes(part.column(0)), kinds=KINDS)
                good = part.column(1).to_numpy(zero_copy_only=False).astype(bool)[w.text_of_word()]
                for bucket, at in _grams(w, size):
                    raw += np.bincount(bucket, minlength=size)
                    target += np.bincount(bucket[good[at]], minlength=size)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    return run


def _score_task(ratio: np.ndarray, text_col: str, id_col: str, keep: list[str], seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text_col):
                w = words(as_bytes(part.column(part.schema.get_field_index(text_col))), kinds=KINDS)
                total = np.zeros(part.num_rows, np.int64)
                for bucket, at in _grams(w, len(ratio)):
                    run_sum = np.concatenate([[0], np.cumsum(ratio[bucket])])
                    cut = np.searchsorted(at, w.first)
                    total += run_sum[cut[1:]] - run_sum[cut[:-1]]
                ids = pa.compute.fill_null(part.column(part.schema.get_field_index(id_col)).cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
                u = ((mix(ids.view(np.uint64), seed) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
                noise = np.round(-np.log(-np.log(u)) * SCALE).astype(np.int64)
                columns = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(total), pa.array(total + noise)], [*keep, "log_weight", "sample_key"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """Fixed-point log ratio per bucket, and the share of good rows among the labelled ones.

    ``labels`` has ``id_col`` and ``quality`` (1 good, 0 bad). Null ids or labels and ids with both labels are left out. Without good labels all ratios
    are 0. The driver receives at most one row per bucket.
    """
    known = labels.where(f"{id_col} IS NOT NULL AND quality IS NOT NULL").groupBy(F.col(id_col).alias("__id"))
    known = known.agg(F.min("quality").alias("q"), F.max("quality").alias("q1")).where("q = q1").select("__id", "q")
    known = durable(known.orderBy(F.xxhash64("__id"), "__id").limit(max_labelled), "labelled")  # at most max_labelled rows
    marked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(known), "__id", "left")
    rows = marked.select("text", F.coalesce(F.col("q") == 1, F.lit(False)).alias("good"))
    counts = rows.mapInArrow(_count_task(BUCKETS), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    share = known.agg(F.avg((F.col("q") == 1).cast("double"))).first()[0]
    if not target.sum():
        return np.zeros(BUCKETS, np.int64), 1.0
    ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    return np.round(ratio * SCALE).astype(np.int64), float(share)


def importance_sample(
    docs: DataFrame,
    labels: DataFrame,
    *,
    keep: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_posterior: float = LEAST_POSTERIOR,
    seed: int = 9,
) -> DataFrame:
    """All rows with the columns ``keep`` (default: all) plus ``log_weight``, ``sample_key`` (fixed point, 1 / SCALE) and ``kept``; columns of these
    names in ``docs`` are replaced.

    Null and empty texts have weight 0. Rows with a null id share one noise value. Equal keys at the k-th place are all kept, so that
    repeated rows share their fate. Without good labels everything is kept. Empty tables give no rows.
    """
    added = ("log_weight", "sample_key", "kept")
    docs = docs.drop(*added)
    keep = [c for c in (keep or docs.columns) if c not in added]
    ratio, share = fit(docs, labels, id_col=id_col, text_col=text_col)
    columns = list(dict.fromkeys([*keep, id_col, text_col]))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "log_weight long, sample_key long"])

    def scored(kept: list[str], ddl: str) -> DataFrame:
        return docs.select(*columns).mapInArrow(_score_task(ratio, text_col, id_col, kept, seed), ddl)

    narrow = text_col not in keep
    keys = durable(scored(keep if narrow else [id_col], schema if narrow else f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, log_weight long, sample_key long"), "weights")
    least = math.log(least_posterior / share) * SCALE if ratio.any() else -math.inf
    k = keys.where(F.col("log_weight") >= F.lit(least)).count()
    # the k-th largest key; below it nothing is sampled
    place = number_within(keys.select((-F.col("sample_key")).alias("key"), F.col(id_col).alias("id")), [], ["key", "id"]).where(F.col("position") == k).first()
    bound = F.lit(-place["key"] if place else 2**63 - 1)
    rows = keys if narrow else scored(keep, schema)
    return rows.withColumn("kept", F.col("sample_key") >= bound)
