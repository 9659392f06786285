"""Ranked lexical search with bag deduplication.

A document matters to a set of items only through its *bag*, the counts of the terms that some item holds, and through a length norm m. Documents of equal
bag and norm form a class: it is scored once, and only the classes that reach an item's best ranks are turned back into documents, by ascending id.

1. One pass writes each document's term count and bag (term numbers and counts as bytes; words are found by hash and compared byte by byte).
2. Totals and document frequencies come from the written bags, summed in tasks first.
3. Classes are grouped by digest, norm and the bag's bytes themselves, with map-side combine, so that copies are one row per task before anything is moved.
4. A first 256th of the bags, taken by digest, is scored for each item's k-th best score: a bound from below that no document of the result can miss.
5. Every class is scored from the items' posting lists; a task keeps k classes an item, by score and least id, which holds every class with a document among
   the k best. The k best classes of an item give the documents.

Items are worked on in blocks of about :data:`PAIRS` (item, term) pairs, each with one pass over the documents, so what travels to the tasks is bounded
however many items there are; the terms of one item have to fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.words import LOWER_AZ, Words, as_bytes, blocks, words
from siftstone.plans.skew import durable, top_per_group

#: (item, term) pairs of a block of items
PAIRS = 1 << 18
#: scores held at once in a task, and partial products
CELLS = 1 << 20
#: fixed values: bytes of a term (ASCII digits and letters, all of other scripts), and the same as a pattern
TERM_KINDS = np.zeros(256, np.uint8)
TERM_KINDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the given ranges, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(start, size)


@dataclass
class Vocabulary:
    """Terms of a block of items, sorted by hash, and for each the items that hold it."""

    code: np.ndarray
    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    post_start: np.ndarray
    post: np.ndarray
    n_items: int
    most_terms: int

    @staticmethod
    def of(pairs: list[tuple[int, str]], n_items: int) -> Vocabulary:
        """``pairs``: item number and term, each once."""
        terms = sorted({t for _, t in pairs})
        raw = [t.encode() for t in terms]
        found = words(raw, kinds=TERM_KINDS)
        order = np.argsort(found.code, kind="stable")
        number = {terms[o]: i for i, o in enumerate(order.tolist())}
        post = np.array(sorted((number[t], item) for item, t in pairs), np.int64).reshape(-1, 2)
        most = int(np.bincount(post[:, 1], minlength=1).max()) if len(post) else 0
        return Vocabulary(
            found.code[order], found.data, found.start[order], (found.end - found.start)[order],
            np.searchsorted(post[:, 0], np.arange(len(terms) + 1)), post[:, 1], n_items, most,
        )

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Words that are terms, and the numbers of those terms. Equal hashes of different terms are told apart by their bytes."""
        size = w.end - w.start
        at, upto = np.searchsorted(self.code, w.code), np.searchsorted(self.code, w.code, "right")
        which = np.repeat(np.arange(len(w.code)), upto - at)
        term = _ranges(at, upto - at)
        same = size[which] == self.size[term]
        which, term = which[same], term[same]
        equal, open_ = np.ones(len(which), bool), np.arange(len(which))
        step = 0
        while len(open_):
            hit = w.data[w.start[which[open_]] + step] == self.data[self.start[term[open_]] + step]
            equal[open_[~hit]] = False
            step += 1
            open_ = open_[hit]
            open_ = open_[self.size[term[open_]] > step]
        return which[equal], term[equal]


def bags_of(texts: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, list[bytes | None]]:
    """Terms of each text with repeats, and its bag: term numbers, then counts, as 32-bit numbers; None without a term of the vocabulary."""
    w = words(texts, table=LOWER_AZ, kinds=TERM_KINDS)
    which, term = vocabulary.find(w)
    width = max(len(vocabulary.code), 1)
    keys, counts = np.unique(w.text_of_word()[which] * width + term, return_counts=True)
    cut = np.searchsorted(keys, np.arange(len(texts) + 1) * width)
    ids, counts = (keys % width).astype(np.int32), counts.astype(np.int32)
    pieces = zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)
    return w.counts(), [ids[a:b].tobytes() + counts[a:b].tobytes() if b > a else None for a, b in pieces]


def unpack(bags: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bag of each entry, its term number and count."""
    sizes = np.fromiter(map(len, bags), np.int64, len(bags)) // 8
    flat = np.frombuffer(b"".join(bags), np.int32).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(2 * sizes)])[:-1]
    ids = flat[_ranges(begin, sizes)]
    return np.repeat(np.arange(len(bags)), sizes), ids, flat[_ranges(begin + sizes, sizes)]


class Scorer:
    """Scores of bags for all items of a block."""

    def __init__(self, vocabulary: Vocabulary, weight: np.ndarray):
        self.vocabulary, self.weight = vocabulary, weight
        # a part of a score is below weight * 10**6; doubles add whole numbers exactly below 2**53
        self.exact = float(weight.max(initial=0)) * 1e6 * max(vocabulary.most_terms, 1) < 2**53

    def chunks(self, bags: list[bytes], norm: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """First bag of each chunk, and the scores of its bags (rows) for all items (columns)."""
        v = self.vocabulary
        bag, term, count = unpack(bags)
        part = self.weight[term] * ((1_000_000_000 * count) // (1_000 * count + 20 * norm[bag]))
        wide = v.post_start[term + 1] - v.post_start[term]
        made = np.concatenate([[0], np.cumsum(wide)])[np.searchsorted(bag, np.arange(len(bags) + 1))]
        a = 0
        while a < len(bags):
            # as many bags as keep both scores and partial products within bounds, one at least
            b = max(a + 1, min(a + max(CELLS // max(v.n_items, 1), 1), int(np.searchsorted(made, made[a] + CELLS, "right")) - 1))
            x, y = np.searchsorted(bag, [a, b])
            cell = np.repeat((bag[x:y] - a) * v.n_items, wide[x:y]) + v.post[_ranges(v.post_start[term[x:y]], wide[x:y])]
            value = np.repeat(part[x:y], wide[x:y])
            size = (b - a) * v.n_items
            if self.exact:
                total = np.bincount(cell, value, size).astype(np.int64)
            else:
                total = (np.bincount(cell, value >> 20, size).astype(np.int64) << 20) + np.bincount(cell, value & 0xFFFFF, size).astype(np.int64)
            yield a, total.reshape(b - a, v.n_items)
            a = b


def _bag_task(vocabulary: Vocabulary):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                n, bags = bags_of(as_bytes(part.column(1)), vocabulary)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(bags, pa.binary())], ["doc_id", "n", "bag"])

    return task


def _frequency_task(n_terms: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                df += np.bincount(unpack(batch.column(0).slice(start, 512).to_pylist())[1], minlength=n_terms)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], ["term", "df"])

    return task


def _score_task(vocabulary: Vocabulary, weight: np.ndarray, k: int, least: np.ndarray):
    """Rows bag, m, digest, doc_id, members to each item's ``k`` best of the task, none below ``least``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, bound = Scorer(vocabulary, weight), np.maximum(least, 1)
        kept: list[pa.Table] = []

        def best() -> pa.Table:
            """What is kept, cut to k an item; raises the items' bounds."""
            table = pa.concat_tables(kept)
            item, score, doc = (table.column(c).to_numpy() for c in ("item", "score", "doc_id"))
            order = np.lexsort((doc, -score, item))
            first = np.searchsorted(item[order], item[order], "left")
            place = np.arange(len(order)) - first
            full = order[place == k - 1]
            bound[item[full]] = np.maximum(bound[item[full]], score[full])
            return table.take(pa.array(order[place < k]))

        for batch in batches:
            for part in blocks(batch, "bag"):
                column = dict(zip(part.schema.names, part.columns, strict=True))
                norm = column["m"].to_numpy()
                for a, scores in scorer.chunks(column["bag"].to_pylist(), norm):
                    row, item = np.nonzero(scores >= bound)
                    if not len(row):
                        continue
                    at = pa.array(row + a)
                    kept.append(
                        pa.table({"item": pa.array(item), "score": pa.array(scores[row, item])} | {c: column[c].take(at) for c in ("doc_id", "digest", "m", "members")})
                    )
                    if sum(t.num_rows for t in kept) > CELLS:
                        kept[:] = [best()]
        if kept:
            yield from best().combine_chunks().to_batches()

    return task


_SCORED = "item long, score long, doc_id long, digest string, m long, members long"


def _item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    found = items.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("long").alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM_PATTERN), F.lit(0)))).alias("term")
    )
    return found.distinct()


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, *, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of each item: item_id long, rank int (from 1), doc_id long, score long.

    A term is a maximal match of :data:`TERM_PATTERN`, only A-Z lower-cased. Scores are whole numbers; equal ones rank by ascending doc_id. Documents that
    score nothing are not returned, so an item may have fewer than k rows or none. Null and empty texts hold no term. Rows without an id take no part, on
    either side; items of one id are one item with the terms of all its rows; every document row counts for itself, repeated ones too. Other columns are
    ignored. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    pairs = durable(_item_terms(items, item_col, text_col), "item-terms")
    n_blocks = max(1, -(-pairs.count() // PAIRS))
    docs = docs.where(F.col(doc_col).isNotNull()).select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranked = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    totals = None
    for block in range(n_blocks):
        own = pairs if n_blocks == 1 else pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block)
        own = [(r["item_id"], r["term"]) for r in own.collect()]
        if not own:
            continue
        names = sorted({i for i, _ in own})
        number = {i: n for n, i in enumerate(names)}
        vocabulary = Vocabulary.of([(number[i], t) for i, t in own], len(names))
        bags = docs.mapInArrow(_bag_task(vocabulary), "doc_id long, n long, bag binary").withColumn("digest", F.sha2("bag", 256))
        bags = durable(bags, "bags")
        if totals is None:
            totals = bags.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
        if not totals[0]:
            break
        found = _search_block(bags.where("bag IS NOT NULL"), vocabulary, int(totals[0]), int(totals[1]), k)
        numbers = F.broadcast(spark.createDataFrame(list(enumerate(names)), "item long, item_id long"))  # at most PAIRS rows
        ranked = ranked.unionByName(found.join(numbers, "item").select("item_id", "rank", "doc_id", "score"))
    return ranked


def _search_block(bags: DataFrame, vocabulary: Vocabulary, n_docs: int, n_terms: int, k: int) -> DataFrame:
    spark = bags.sparkSession
    width = len(vocabulary.code)
    partial = bags.select("bag").mapInArrow(_frequency_task(width), "term long, df long")
    weight = np.zeros(width, np.int64)
    for row in partial.groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most PAIRS rows
        weight[row["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row["df"] + 1)))
    normed = bags.withColumn("m", F.expr(f"50L + (50L * n * {n_docs}L) div {n_terms}L"))

    def scored(rows: DataFrame, least: np.ndarray) -> DataFrame:
        rows = rows.select("bag", "m", "digest", "doc_id", "members")
        return rows.mapInArrow(_score_task(vocabulary, weight, k, least), _SCORED)

    # documents of a part of the bags, each for itself: their k-th best score is one the result's k-th best cannot be below
    first = scored(normed.where(F.col("digest").startswith("00")).withColumn("members", F.lit(1).cast("long")), np.zeros(vocabulary.n_items, np.int64))
    least = np.zeros(vocabulary.n_items, np.int64)
    for row in top_per_group(first, ["item"], [F.desc("score"), F.col("doc_id")], k).where(F.col("__rn") == k).collect():  # a row an item
        least[row["item"]] = row["score"]

    classes = normed.groupBy("digest", "m", "bag").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("members"))
    best = durable(top_per_group(scored(classes, least), ["item"], [F.desc("score"), F.col("doc_id")], k, "__place"), "best-classes")
    # members of the classes that count: their digests are at most items x k rows
    many = best.where("members > 1").select("digest", "m").distinct()
    members = normed.select("doc_id", "digest", "m").join(F.broadcast(many), ["digest", "m"])
    members = top_per_group(members, ["digest", "m"], [F.col("doc_id")], k, "__nth").select("digest", "m", F.col("doc_id").alias("member"))
    expanded = best.where("members > 1").join(members, ["digest", "m"]).select("item", "score", F.col("member").alias("doc_id"))
    rows = best.where("members = 1").select("item", "score", "doc_id").unionByName(expanded)
    return top_per_group(rows, ["item"], [F.desc("score"), F.col("doc_id")], k, "rank").withColumn("rank", F.col("rank").cast("int"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM_PATTERN}') AS ts FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT count(*) AS docs_all, sum(len(ts)) AS terms_all FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM_PATTERN}')) AS term FROM benchmark WHERE item_id IS NOT NULL),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs_all + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), t),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs_all) // terms_all))))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN w USING (term), t GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50"""
