"""Near-duplicate documents: fast similarity sketches, banding, exact verification on full shingle sets.

Sketch. ``T`` coordinates. In round r < T every shingle a is hashed anew and placed in one bin by its hash; a bin keeps the least
hash of the first round that reached it. Rounds go on only for texts with empty bins; should bins be left after T rounds, round
T + j places every shingle in bin j, so each coordinate fills for certain. Two sketches agree in a coordinate with probability J,
with the concentration of independent draws, at a cost of about |A| + T log T per text instead of |A| T.

Banding. 32 bands of 5 coordinates: two sets at J = 0.8 share no band with probability (1 - 0.8**5)**32 = 3e-6.

Linking. Equal sets collapse first. Every node is then verified against one pivot, the node of its buckets that shares most buckets itself: in a group of
copies of one text that text comes first and links most of them at once. What is left are buckets that still hold several components. There
every member outside the bucket's largest component is compared with all members of other components, so each pair of each bucket
ends up inside one component or verified, and no link is lost. That comparison runs in blocks: a block holds up to :data:`BLOCK_NODES` sets of
one pivot's followers and up to :data:`BLOCK_ASKS` nodes asking for them, and counts an asking set's common shingles with all sets of the block
in one array pass, so pairs are never rows. Both the first step's screen (a sketch estimate of 0.6 or more, which a true pair fails with a probability
near 1e-10) and the blocks end in counts on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.components import components, merged
from siftstone.llm.words import LOWER_AZ, as_bytes, blocks, mix, shingle_sets, words
from siftstone.plans.skew import durable

BANDS, ROWS = 32, 5
T = BANDS * ROWS
SCREEN = 0.6
BLOCK_NODES, BLOCK_BYTES, BLOCK_ASKS = 1024, 8 << 20, 1024

_U = np.uint64


def fast_sketches(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """Fast similarity sketches of many sets as one array of shape (sets, t); rows of empty sets stay at the filler value."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    filler = _U(0xFFFFFFFFFFFFFFFF)
    out = np.full(len(sets) * t, filler, np.uint64)
    if not sizes.sum():
        return out.reshape(len(sets), t)
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for r in range(2 * t):
        h = mix(items, 1000 + r)
        if r < t:
            place = owner * t + ((h >> _U(32)) * _U(t) >> _U(32)).astype(np.int64)
        else:
            place = owner * t + (r - t)
        if r:
            free = out[place] == filler  # bins filled in an earlier round keep their value
            place, h = place[free], h[free]
        np.minimum.at(out, place, h)
        unfilled = (out.reshape(len(sets), t) == filler).any(axis=1)
        left = unfilled[owner]
        items, owner = items[left], owner[left]
        if not len(items):
            break
    return out.reshape(len(sets), t)


def _sketch_task(n: int, lower, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text_col):
                texts = as_bytes(part.column(part.schema.get_field_index(text_col)))
                sets = shingle_sets(words(texts, lower), n)
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                sk = fast_sketches(sets)
                bands = np.zeros((len(sets), BANDS), np.uint64)
                for j in range(ROWS):
                    bands = bands * _U(0xD6E8FEB86659FD93) + sk[:, j::ROWS]
                bands = mix(bands + np.arange(BANDS, dtype=np.uint64) * _U(0x9E3779B97F4A7C15), 7).view(np.int64)
                fp = np.array([(mix(s, 1).sum(dtype=np.uint64), mix(s, 2).sum(dtype=np.uint64)) for s in sets], np.uint64)
                fp = fp.reshape(-1, 2).view(np.int64)
                low = sk.astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(part.schema.get_field_index(id_col)).cast(pa.int64()),
                        pa.array(sizes),
                        pa.array(fp[:, 0]),
                        pa.array(fp[:, 1]),
                        pa.array(list(bands), pa.list_(pa.int64())),
                        pa.array([row.tobytes() for row in low], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "fp1", "fp2", "bands", "sketch"],
                )

    return run


def _set_task(n: int, lower, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text_col):
                texts = as_bytes(part.column(part.schema.get_field_index(text_col)))
                sets = shingle_sets(words(texts, lower), n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "items"]
                )

    return run


def _screen_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches may come from sets at the threshold."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, T) for i in (2, 3))
            match = ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            yield batch.select([0, 1]).filter(pa.array(match >= SCREEN))


def _verify_task(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _joined(pairs: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}")), side)
    return pairs.select("a", "b", f"{column}_a", f"{column}_b")


def _block_task(percent: int):
    """Links between asking sets and the block's sets of other components, one for each asking node and component."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            node, comp = left.column("node").to_numpy(), left.column("component").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in left.column("items").to_pylist()]
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            known, index = np.unique(np.concatenate(sets), return_inverse=True)
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            for who, own, items in zip(right.column("node").to_pylist(), right.column("component").to_pylist(), right.column("items").to_pylist(), strict=True):
                items = np.frombuffer(items, np.uint64)
                has = np.zeros(len(known), np.int32)
                at = np.minimum(np.searchsorted(known, items), len(known) - 1)
                has[at[known[at] == items]] = 1
                both = np.add.reduceat(has[index], start)
                hit = np.flatnonzero((100 * both >= percent * (size + len(items) - both)) & (comp != own))
                first = hit[np.unique(comp[hit], return_index=True)[1]]
                a.extend([who] * len(first))
                b.extend(node[first].tolist())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _remaining_links(live: DataFrame, comp: DataFrame, followed: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links across components among members of one bucket (see the module's text); None when every bucket lies in one component."""
    placed = live.select("bucket", "node").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    opened = durable(placed.join(mixed, "bucket").select("bucket", "node", "component", (F.col("component") != F.col("top.component")).alias("asks")), "open")
    if opened.isEmpty():
        return None
    home = opened.select("node", "component").distinct().join(followed, "node", "left").withColumn("pivot", F.coalesce("pivot", "node"))
    home = durable(home.join(sets, "node"), "homes")
    room = home.groupBy("pivot").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum(F.length("items")) / BLOCK_BYTES)).alias("blocks")
    )
    home = home.join(room, "pivot").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).drop("blocks")
    home = durable(home, "homes")
    where = opened.join(home.select("node", "pivot", "block"), "node").select("bucket", "pivot", "block").distinct()
    asks = opened.where("asks").select("bucket", "node", "component").join(where, "bucket").select("node", "component", "pivot", "block").distinct()
    asks = durable(asks, "asks")
    shares = asks.groupBy("pivot", "block").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ASKS).alias("shares"))
    left = home.join(shares, ["pivot", "block"]).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    right = asks.join(shares, ["pivot", "block"]).withColumn("share", F.pmod(F.xxhash64("node"), F.col("shares"))).join(sets, "node")
    keys = ["pivot", "block", "share"]
    columns = [*keys, "node", "component", "items"]
    found = left.select(*columns).groupBy(*keys).cogroup(right.select(*columns).groupBy(*keys)).applyInArrow(_block_task(percent), "a long, b long")
    return durable(found, "links")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    lower_table: np.ndarray | None = LOWER_AZ,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id reachable over links), kept (doc_id = component_id).

    Two documents are linked when 100 * |A and B| >= percent * |A or B| on their sets of ``shingle``-word shingles; percent must be
    80 or more for the banding's recall. Null, empty and word-less texts have the empty set and are linked with nothing. Texts of
    fewer words than a shingle have their whole sequence as only shingle. Rows with a null id are left out; repeated rows collapse to
    one. Other columns are ignored. Empty tables give no rows.
    """
    if percent < 80:
        raise ValueError("the bands are laid out for a similarity of 80 percent or more")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    schema = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, sketch binary"
    sketches = durable(narrow.mapInArrow(_sketch_task(shingle, lower_table, "doc_id", "text"), schema), "sketches")
    twins = sketches.where("n_shingles > 0").groupBy("n_shingles", "fp1", "fp2").agg(F.min("doc_id").alias("rep"))
    # sets of up to three shingles reach the threshold with equal sets only
    is_rep = (F.col("doc_id") == F.col("rep")) & (F.col("n_shingles") > 3)
    members = durable(
        sketches.join(twins, ["n_shingles", "fp1", "fp2"], "left").select(
            "doc_id",
            "n_shingles",
            F.coalesce("rep", "doc_id").alias("rep"),
            F.when(is_rep, F.col("bands")).alias("bands"),
            F.when(is_rep, F.col("sketch")).alias("sketch"),
        ),
        "members",
    )
    nodes = members.where("bands IS NOT NULL").select(F.col("doc_id").alias("node"), "bands", "sketch").dropDuplicates(["node"])
    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    live = durable(spread.join(shared, "bucket"), "buckets")
    involved = durable(live.groupBy("node").agg(F.sum("size").alias("weight")), "involved")
    texts = narrow.join(involved, narrow["doc_id"] == involved["node"], "left_semi").dropDuplicates(["doc_id"])
    sets = durable(texts.mapInArrow(_set_task(shingle, lower_table, "text"), "node long, items binary"), "sets")
    slim = durable(nodes.join(involved, "node").select("node", "sketch"), "slim")

    def confirmed(pairs: DataFrame) -> DataFrame:
        screened = _joined(pairs, slim, "sketch").mapInArrow(_screen_task, "a long, b long")
        return _joined(screened, sets, "items").mapInArrow(_verify_task(percent), "a long, b long")

    # first round: every node against the heaviest pivot of its buckets
    live = durable(live.join(involved, "node"), "buckets")
    heaviest = F.struct("weight", (-F.col("node")).alias("node"))
    pivots = live.groupBy("bucket").agg(F.max(heaviest).alias("pivot"))
    pairs = live.join(pivots, "bucket").groupBy("node").agg(F.max("pivot").alias("pivot")).select(F.col("node").alias("a"), (-F.col("pivot.node")).alias("b")).where("a <> b")
    pairs = durable(pairs, "pairs")
    comp = durable(components(confirmed(pairs)), "components")
    followed = pairs.select(F.col("a").alias("node"), F.col("b").alias("pivot"))
    links = _remaining_links(live, comp, followed, sets, percent)
    if links is not None:
        comp = merged(comp, links)
    component = comp.withColumnRenamed("node", "rep")
    out = members.select("doc_id", "n_shingles", "rep").dropDuplicates(["doc_id"]).join(component, "rep", "left")
    return out.select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("component", "rep") == F.col("doc_id")).alias("kept")
    )
