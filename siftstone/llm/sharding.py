"""Sharding by longest processing time first: groups that stay together go, largest first, to the least-loaded shard.

A group is all documents of one text. The heap sees at most :data:`HEAP_ITEMS` x 2 x shards items, whatever the corpus: groups
of at least 1 / (HEAP_ITEMS x shards) of all bytes are items of their own (there can be no more than HEAP_ITEMS x shards of them),
and the many smaller ones are first hashed into HEAP_ITEMS x shards bundles whose summed sizes are the other items. A bundle holds
about 1 / (HEAP_ITEMS x shards) of the bytes, so shards differ by about 1 / HEAP_ITEMS of a shard, or by what a single larger group
enforces. Group and bundle sizes are sums with map-side combine; a hot group is one row before anything is joined.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.plans.skew import durable, number_within

HEAP_ITEMS = 256


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def longest_first(items: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Shard of each (size, key) item: by size descending, ties by key, each to the least-loaded shard (ties: lowest number)."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for size, key in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        placed[key] = shard
    return placed


def _items(docs: DataFrame, text_col: str, shards: int) -> tuple[DataFrame, dict[str, int]]:
    """Group sizes with the item each group belongs to, and the shard of each item."""
    groups = docs.groupBy(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("__group")).agg(
        F.sum(size_of(F.col(text_col))).alias("__bytes")
    )
    groups = durable(groups, "groups")
    total = groups.agg(F.sum("__bytes")).first()[0] or 0
    bundles = HEAP_ITEMS * shards
    own = F.col("__bytes") * bundles >= total
    bundle = F.concat(F.lit("bundle-"), F.pmod(F.xxhash64("__group"), F.lit(bundles)).cast("string"))
    groups = groups.withColumn("__item", F.when(own, F.col("__group")).otherwise(bundle))
    sized = groups.groupBy("__item").agg(F.sum("__bytes").alias("size"))  # at most 2 x bundles rows
    return groups, longest_first([(r["size"], r["__item"]) for r in sized.collect()], shards)


def assign_shards(docs: DataFrame, shards: int = 24, *, text_col: str = "text", out: str = "shard") -> DataFrame:
    """All rows and columns of ``docs`` with an int column ``out`` (replaced if there) in 0 .. shards - 1.

    Rows with equal texts share a shard (null and empty texts are one group). Repeated rows are all kept; null ids and other nulls do not matter;
    an empty table gives no rows.
    """
    groups, placed = _items(docs, text_col, shards)
    spark = docs.sparkSession
    mapping = spark.createDataFrame(sorted(placed.items()), "__item string, __shard int")
    # only items that are groups of their own need a look-up by text; both tables are bounded by HEAP_ITEMS x shards rows
    bundles = HEAP_ITEMS * shards
    total_items = F.broadcast(mapping)
    own = F.broadcast(mapping.where(~F.col("__item").startswith("bundle-")).select(F.col("__item").alias("__group"), F.col("__shard").alias("__own")))
    keyed = docs.drop(out).withColumn("__group", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    keyed = keyed.withColumn("__item", F.concat(F.lit("bundle-"), F.pmod(F.xxhash64("__group"), F.lit(bundles)).cast("string")))
    joined = keyed.join(own, "__group", "left").join(total_items, "__item", "left")
    return joined.withColumn(out, F.coalesce("__own", "__shard")).drop("__group", "__item", "__own", "__shard")


def number_slots(rows: DataFrame, id_col: str = "doc_id", shard_col: str = "shard", out: str = "slot") -> DataFrame:
    """Rows with ``out``: position from 0 without gaps inside each shard, by id and row content; a shard may be of any size."""
    rest = [c for c in rows.columns if c not in (id_col, shard_col)]
    return number_within(rows, [shard_col], [id_col, *rest], position=out).withColumn(out, F.col(out) - 1)
