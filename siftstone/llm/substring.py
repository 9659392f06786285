"""Removal of repeated passages by super-k-mer partitioning.

A window is k consecutive words of one document. Of the m-word runs inside a window the one with the least hash is its minimiser, and consecutive windows
that share it travel as one packed string (their words, one space apart) to the minimiser's bucket, so equal windows always meet. A bucket unpacks its
windows, sorts them and counts exactly: every occurrence whose window also starts in a document of a smaller id is marked. The
marks go back to the documents as word ranges.

Minimisers whose packed strings would overfill a bucket are found on a sample of the documents; their windows travel one by one to buckets chosen by the
whole window instead. This only changes where windows meet, never whether, so no result depends on the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.words import Words, as_bytes, blocks, mix, shingles, words
from siftstone.plans.skew import durable

WINDOW, MINI = 13, 3
#: bytes of packed strings a bucket is laid out for, the number of buckets from which they grow instead, and the least weight of a heavy minimiser
BUCKET_BYTES, MAX_BUCKETS, LEAST_HEAVY = 12 << 20, 50_000, 1 << 20
SAMPLE = 1 / 16
#: bytes of text whose packed strings share a row per bucket key (long rows compress better), and how hard they are compressed
PACK_BYTES, LEVEL = 4 << 20, 6
_U = np.uint64


def _minimisers(w: Words, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimiser hash of every window, and the window's first word."""
    n = len(w.code)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n - m + 1, np.uint64)
    for j in range(m):
        h = h * _U(0xD6E8FEB86659FD93) + w.code[j : j + len(h)]
    h = mix(h, 77)
    span, width = k - m + 1, 1
    while width * 2 <= span:
        h = np.minimum(h[: len(h) - width], h[width:])
        width *= 2
    if width < span:
        h = np.minimum(h[: len(h) - (span - width)], h[span - width :])
    ends = np.repeat(w.first[1:], w.counts())[: len(h)]
    at = np.flatnonzero(np.arange(len(h)) + k <= ends)
    return h[at], at


def _runs(mini: np.ndarray, at: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of consecutive windows with one minimiser; windows marked ``own`` are runs by themselves."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (mini[1:] != mini[:-1]) | (at[1:] != at[:-1] + 1) | own[1:]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(at)))


def _packed(w: Words) -> tuple[bytes, np.ndarray]:
    """All words one space apart, and where each begins (one entry more than words)."""
    size = w.end - w.start
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    inside = np.zeros(len(w.data) + 1, np.int8)
    inside[w.start] += 1
    inside[w.end] -= 1
    mask = (np.cumsum(inside) > 0)[:-1]
    mask[w.end] = True  # one separator after each word; the data end with one
    out = w.data[mask].copy()
    out[begin[1:] - 1] = 0x20
    return out.tobytes(), begin


def _weigh_task(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                w = words(as_bytes(part.column(part.schema.get_field_index("text"))))
                mini, at = _minimisers(w, k, m)
                first, length = _runs(mini, at, np.zeros(len(at), bool))
                size = w.end[at[first] + length + k - 2] - w.start[at[first]] if len(first) else np.zeros(0, np.int64)
                key, index = np.unique(mini[first], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.bincount(index, size, len(key)).astype(np.int64))], ["mini", "bytes"])

    return run


def _pack_task(k: int, m: int, heavy: np.ndarray, keys: int):
    """Packed strings by bucket key; those of one block of texts for one key are one compressed row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=LEVEL)
        for batch in batches:
            for part in blocks(batch, limit=PACK_BYTES):
                w = words(as_bytes(part.column(part.schema.get_field_index("text"))))
                mini, at = _minimisers(w, k, m)
                own = np.isin(mini, heavy) if len(heavy) else np.zeros(len(at), bool)
                first, length = _runs(mini, at, own)
                if not len(first):
                    continue
                bucket = mini[first].copy()
                if own.any():
                    whole, place = shingles(w, k)
                    lone = own[first]
                    bucket[lone] = whole[np.searchsorted(place, at[first[lone]])]
                text, begin = _packed(w)
                a = at[first]
                lo, hi = begin[a].tolist(), (begin[a + length + k - 1] - 1).tolist()
                doc = w.text_of_word()[a]
                ids = part.column(part.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
                ids, start = ids[doc].astype(np.int64), (a - w.first[doc]).astype(np.int32)
                key = (bucket % _U(keys)).astype(np.int32)
                order = np.argsort(key, kind="stable")
                cuts = np.flatnonzero(np.diff(key[order])) + 1
                rows = [[], [], []]
                for some in np.split(order, cuts):
                    strings = [text[lo[i] : hi[i]] for i in some.tolist()]
                    size = np.fromiter(map(len, strings), np.int32, len(strings))
                    raw = b"".join([np.int32(len(some)).tobytes(), ids[some].tobytes(), start[some].tobytes(), size.tobytes(), *strings])
                    for into, value in zip(rows, (int(key[some[0]]), len(raw), codec.compress(raw, asbytes=True)), strict=True):
                        into.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], ["bucket", "size", "packed"])

    return run


def _unpacked(size: int, packed: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    raw = pa.decompress(packed, size, codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int32, 1)[0])
    ids = np.frombuffer(raw, np.int64, n, 4)
    start, length = np.frombuffer(raw, np.int32, 2 * n, 4 + 8 * n).reshape(2, n)
    end = np.cumsum(length) + (4 + 16 * n)
    return ids, start, [raw[x:y] for x, y in zip((end - length).tolist(), end.tolist(), strict=True)]


def _mark_task(k: int):
    """All of one bucket partition: windows repeated from a smaller id, as (doc_id, start, stop) word ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h1, h2, doc, pos = [], [], [], []
        for batch in batches:
            for size, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, start, packed = _unpacked(size, row)
                for seed, into in ((0, h1), (5, h2)):
                    w = words(packed, seed=seed)
                    h, at = shingles(w, k)
                    into.append(h)
                owner = w.text_of_word()[at]
                doc.append(ids[owner])
                pos.append(start[owner] + (at - w.first[owner]))
        if not h1:
            return
        h1, h2, doc, pos = map(np.concatenate, (h1, h2, doc, pos))
        if not len(h1):
            return
        order = np.lexsort((h2, h1))
        h1, h2, doc, pos = h1[order], h2[order], doc[order], pos[order]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        first = np.flatnonzero(new)
        least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(doc))))
        hit = doc > least
        doc, pos = doc[hit], pos[hit]
        if not len(doc):
            return
        order = np.lexsort((pos, doc))
        doc, pos = doc[order], pos[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + k)  # covered words overlap or touch
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[first]), pa.array(pos[first].astype(np.int32)), pa.array((pos[last] + k).astype(np.int32))], ["doc_id", "start", "stop"]
        )

    return run


def _cut_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks(batch):
            w = words(as_bytes(part.column(1)))
            text, begin = _packed(w)
            ranges = part.column(2).to_pylist()
            kept, n_words, n_removed = [], w.counts(), []
            for i, spans in enumerate(ranges):
                a, b = w.first[i], w.first[i + 1]
                if not spans:
                    n_removed.append(0)
                    kept.append(text[begin[a] : max(begin[a], begin[b] - 1)])
                    continue
                gone = np.zeros(b - a, bool)
                for s in spans:
                    gone[s["start"] : s["stop"]] = True
                n_removed.append(int(gone.sum()))
                edge = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
                kept.append(b" ".join(text[begin[a + x] : begin[a + y] - 1] for x, y in zip(edge[0::2], edge[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_words.astype(np.int64)), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )


def repeated_ranges(docs: DataFrame, k: int = WINDOW, m: int = MINI) -> DataFrame:
    """(doc_id, start, stop): word ranges of ``docs`` (doc_id, text) covered by windows that also start in a document of a smaller id."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shipped = 3 * total  # a string of r windows carries r + k - 1 words, about r = (k - m) / 2 + 1 of which are new
    buckets = int(min(max(shipped // BUCKET_BYTES, 1), MAX_BUCKETS))
    buckets = max(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    share = max(shipped // (4 * buckets), LEAST_HEAVY)
    # there are no more than 4 x buckets minimisers of that weight
    weights = docs.sample(SAMPLE, 1).mapInArrow(_weigh_task(k, m), "mini long, bytes long").groupBy("mini").agg(F.sum("bytes").alias("bytes"))
    heavy = [r["mini"] for r in weights.where(F.col("bytes") > F.lit(share * SAMPLE)).select("mini").collect()]
    keys = 4 * buckets
    packs = docs.mapInArrow(_pack_task(k, m, np.array(sorted(heavy), np.int64).view(np.uint64), keys), "bucket int, size long, packed binary")
    return packs.repartition(buckets, "bucket").select("size", "packed").mapInArrow(_mark_task(k), "doc_id long, start int, stop int")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, m: int = MINI) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: each document without the words covered by a window of k words that also starts in a document of a smaller id.

    Words are cut at 0x20 and 0x09-0x0D and otherwise unchanged; kept words are joined by one space. Windows are judged on the input. Null texts have no
    words. Rows with a null id have no order among documents: they take no part and are left out. An id stands for one text; each
    repeated row gives its row. Other columns are ignored. Empty tables give no rows.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    marks = durable(repeated_ranges(narrow, k, m), "ranges")
    # a document has at most as many ranges as words
    ranges = marks.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    rows = narrow.join(ranges, "doc_id", "left").select("doc_id", "text", "ranges")
    return rows.mapInArrow(_cut_task, "doc_id long, n_words long, n_removed long, kept_text string")
