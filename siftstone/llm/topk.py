"""Exact top-k inner products by no-random-access aggregation.

Candidates are dealt into shards of about :data:`SHARD_ROWS`. A shard holds one list per dimension, sorted by value; a query reads each list from the
end that its own sign makes best, in lockstep, block by block. What is read of a candidate gives it a lower bound (list minimum for unread
entries) and an upper bound (the reading frontier for unread entries). Candidates whose upper bound is under the k-th lower bound are outsiders;
reading stops for a query once all but a few contenders are outsiders, and the contenders' final scores are resolved exactly. The
bounds of all queries of a block come from two matrix products per depth, since what has been read depends on depth and sign only.
The best k of each shard then compete for the overall best k; every candidate lies in one shard, so that merge is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.plans.skew import durable, top_per_group

SHARD_ROWS, BLOCK_QUERIES = 4096, 1024
#: parts of the lists read before bounds are compared again
DEPTHS = (0.25, 0.5, 0.625, 0.75, 0.875, 1.0)


def _matrix(t: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray]:
    ids = t.column("vec_id").to_numpy()
    values = t.column("vec").combine_chunks()
    flat = values.flatten().to_numpy() if len(t) else np.zeros(0, np.int64)
    return ids, flat.reshape(len(ids), dims)


def search_shard(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> list[tuple]:
    """Best k (query_id, vec_id, score) of one shard for each query, own id left out, ties to the smaller id."""
    n, d = x.shape
    if not n or not len(qids):
        return []
    order = np.argsort(x, axis=0, kind="stable")
    ranked = np.take_along_axis(x, order, axis=0)
    place = np.empty((n, d), np.int32)
    np.put_along_axis(place, order, np.arange(n, dtype=np.int32)[:, None].repeat(d, 1), axis=0)
    xf = x.astype(np.float64)
    out: list[tuple] = []
    todo = np.arange(len(qids))
    size = float(np.abs(xf).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0)) * max(d, 1)
    slack = 0.0 if size < 2**52 else size * 1e-9
    few = max(4 * k, 64)
    for part in DEPTHS:
        depth = n if part == 1.0 else max(1, int(n * part))
        if d:
            top, bottom = place >= n - depth, place < depth  # read so far from either end
            qf = q[todo].astype(np.float64)
            signs = np.concatenate([np.maximum(qf, 0), np.minimum(qf, 0)], axis=1).T
            low = np.concatenate([np.where(top, xf, ranked[0]), np.where(bottom, xf, ranked[-1])], axis=1) @ signs - slack
            high = np.concatenate([np.where(top, xf, ranked[n - depth]), np.where(bottom, xf, ranked[depth - 1])], axis=1) @ signs + slack
        else:
            low = high = np.zeros((n, len(todo)))
        own = ids[:, None] == qids[todo][None, :]
        low = np.where(own, -np.inf, low)
        kth = np.partition(low, max(n - k, 0), axis=0)[max(n - k, 0)]
        contender = (high >= kth) & ~own
        ready = (contender.sum(axis=0) <= few) | (depth == n)
        for j in np.flatnonzero(ready):
            c = np.flatnonzero(contender[:, j])
            score = x[c] @ q[todo[j]]
            best = np.lexsort((ids[c], -score))[:k]
            out.extend((int(qids[todo[j]]), int(ids[c[b]]), int(score[b])) for b in best)
        todo = todo[~ready]
        if not len(todo):
            break
    return out


def _search_task(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            dims = left.column("dims")[0].as_py()
            ids, x = _matrix(left, dims)
            qids, q = _matrix(right, dims)
            rows = search_shard(ids, x, qids, q, k)
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    return run


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component as long; null when the vector is null or holds null or non-finite components."""
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != F.lit(float("inf"))))
    return F.when(vector.isNotNull() & good, F.transform(vector, lambda v: F.floor(F.lit(256.0) * v.cast("double")).cast("long")))


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of each query among all vectors but its own id, ties to the smaller vec_id.

    Both inputs have ``vec_id`` and ``vec`` (array<long>); other columns are ignored. Rows with null id or null vector take no part; rows repeated
    under one id count once (the least vector). Only vectors of equal length are compared, those of length 0 score 0. Fewer candidates than
    k give fewer rows; empty tables none. Scores are 64-bit integers and wrap beyond that.
    """

    def clean(df: DataFrame) -> DataFrame:
        df = df.where("vec_id IS NOT NULL AND vec IS NOT NULL").groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("vec").alias("vec"))
        return df.withColumn("dims", F.size("vec"))

    cand, ask = durable(clean(vectors), "vectors"), durable(clean(queries), "asks")
    shards = -(-max(cand.count(), 1) // SHARD_ROWS)
    blocks = -(-max(ask.count(), 1) // BLOCK_QUERIES)
    keys = ["dims", "shard", "block"]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = cand.withColumn("shard", of(shards)).withColumn("block", each(blocks))
    right = ask.withColumn("block", of(blocks)).withColumn("shard", each(shards))
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search_task(k), "query_id long, vec_id long, score long")
    best = top_per_group(found, ["query_id"], [F.desc("score"), F.asc("vec_id")], k, "rank")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
