"""Benchmark decontamination: MinHash containment search by per-item bottom sketches, with exact shingle containment.

A document contains an item when at least ``percent`` of the item's distinct shingles are among the document's. An item
of size q keeps a bottom sketch: the q - ceil(percent q / 100) + 1 shingles of least hash. A document that holds enough of the
item cannot miss all of them, however long it is, so a shared sketch value finds every true pair, while sketches of a similarity between whole
documents and short items would need to grow with the document. The depth follows each item's own size, so there are no size
partitions.

Documents are read once: each offers its shingles that may be sketch values (a bitmap of fixed size tells) and, when it has any, the words of its shingles
that may belong to an item at all. Sketch values join to candidate pairs, and candidates are verified on the shingles' words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.words import Words, as_bytes, blocks, shingles, words
from siftstone.plans.skew import durable

BITS = 23  # a bitmap of 1 MB, whatever the size of the benchmark
_MASK = np.uint64((1 << BITS) - 1)

#: ASCII marks are left out of words
MARKS = np.zeros(256, bool)
MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _normal(column: pa.Array) -> Words:
    """Words in lower case without ASCII marks; a word of marks only vanishes."""
    return words(as_bytes(column, lower=True), drop=MARKS)


def _text_of(w: Words, first: int, n: int) -> str:
    return " ".join(w.data[w.start[i] : w.end[i]].tobytes().decode() for i in range(first, first + n))


def _lengths(counts: np.ndarray, n: int) -> list[int]:
    """Shingle lengths in use: n, and the whole length of items that are shorter."""
    return [x for x in range(1, n + 1) if x == n or (counts == x).any()]


def _item_task(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                w = _normal(part.column(1))
                counts, rows = w.counts(), [[], [], [], []]
                for length in _lengths(counts, n):
                    h, at = shingles(w, length)
                    owner = w.text_of_word()[at]
                    fits = (counts[owner] == length) | (length == n)
                    for x, a, o in zip(h[fits], at[fits], owner[fits], strict=True):
                        for into, value in zip(rows, (part.column(0)[int(o)].as_py(), length, int(x.view(np.int64)), _text_of(w, int(a), length)), strict=True):
                            into.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.string())],
                    ["item_id", "length", "hash", "shingle"],
                )

    return run


def _offer_task(lengths: list[int], sketch_bits: np.ndarray, all_bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, known = (np.unpackbits(b).view(bool) for b in (sketch_bits, all_bits))
        for batch in batches:
            for part in blocks(batch):
                w = _normal(part.column(1))
                owner_of = w.text_of_word()
                hits, near = {}, {}
                found = []
                for length in lengths:
                    h, at = shingles(w, length)
                    low = (h & _MASK).astype(np.int64)
                    some = known[low]
                    h, at, low = h[some], at[some], low[some]
                    found.append((length, h, at, owner_of[at], sketch[low]))
                    for o, x in zip(owner_of[at][sketch[low]].tolist(), h[sketch[low]].view(np.int64).tolist(), strict=True):
                        hits.setdefault(o, set()).add(x)
                for length, _, at, owner, _ in found:
                    for o, a in zip(owner.tolist(), at.tolist(), strict=True):
                        if o in hits:
                            near.setdefault(o, set()).add(_text_of(w, a, length))
                order = sorted(hits)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(order, pa.int64())),
                        pa.array([sorted(hits[o]) for o in order], pa.list_(pa.int64())),
                        pa.array([sorted(near[o]) for o in order], pa.list_(pa.string())),
                    ],
                    ["doc_id", "hits", "near"],
                )

    return run


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Packed bits of the low hash bits; the driver receives at most 2**BITS numbers."""
    bits = np.zeros(1 << BITS, bool)
    low = hashes.select(F.col("hash").bitwiseAND(F.lit(int(_MASK))).alias("b")).distinct()
    bits[[r["b"] for r in low.toLocalIterator()]] = True
    return np.packbits(bits)


def contained_items(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """(doc_id, item_id, n_item, n_common): every pair with 100 * n_common >= percent * n_item on distinct shingles.

    Words are lower-cased and lose ASCII marks. Items of fewer words than a shingle count as one shingle of all their words; items without words, null
    and empty texts match nothing. Rows with null ids are left out; repeated rows count once. Other columns are ignored; empty tables give no rows.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    asked = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id IS NOT NULL")
    parts = asked.mapInArrow(_item_task(shingle), "item_id long, length int, hash long, shingle string").distinct()
    parts = durable(parts, "item-shingles")
    sizes = parts.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
    # bottom sketch of each item, as deep as its size asks for; an item is one short text, so its window is small
    ranked = parts.join(sizes, "item_id").selectExpr(
        "item_id", "n_item", "hash", "row_number() OVER (PARTITION BY item_id ORDER BY hash, shingle) AS depth"
    )
    deep = F.col("n_item") - F.ceil(F.col("n_item") * percent / 100) + 1
    sketch = durable(ranked.where(F.col("depth") <= deep).select("item_id", "hash").distinct(), "item-sketches")
    lengths = sorted(r["length"] for r in parts.select("length").distinct().collect())  # 1 .. shingle at most
    if not lengths:
        return parts.selectExpr("0L AS doc_id", "item_id", "0L AS n_item", "0L AS n_common").limit(0)
    offers = narrow.mapInArrow(_offer_task(lengths, _bitmap(sketch), _bitmap(parts)), "doc_id long, hits array<long>, near array<string>")
    offers = durable(offers, "offers")
    pairs = offers.select("doc_id", F.explode("hits").alias("hash")).join(sketch, "hash").select("doc_id", "item_id").distinct()
    wanted = pairs.join(parts.select("item_id", "shingle"), "item_id")
    had = offers.select("doc_id", F.explode("near").alias("shingle")).distinct()
    common = wanted.join(had, ["doc_id", "shingle"]).groupBy("doc_id", "item_id").agg(F.countDistinct("shingle").alias("n_common"))
    return common.join(sizes, "item_id").where(F.col("n_common") * 100 >= F.col("n_item") * percent).select("doc_id", "item_id", "n_item", "n_common")


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """Rows and columns of ``docs`` that contain no item; rows with a null id are kept. Options as in :func:`contained_items`."""
    bad = durable(contained_items(docs, items, id_col=id_col, **options).select(F.col("doc_id").alias("__bad")).distinct(), "contaminated")
    return docs.join(bad, F.col(id_col) == F.col("__bad"), "left_anti")
