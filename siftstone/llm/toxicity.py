"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Kernel. Two strings are compared by all the subsequences of :data:`ORDER` letters they share, each weighted by DECAY to the power of the lengths it spans,
normalised to 1 for equal strings. Letters put between or left out cost a factor of DECAY instead of the match, so gapped spellings keep most of their
similarity. Marks inside a word and blanks between single letters are closed up before.

Training. Labelled documents are cut into word segments. A segment counts as toxic when it keeps to toxic documents beyond chance. Both sides count
different windows of words around it, at most one per document, so that copies of one sentence count once. Toxic segments against clean ones
train, piece by piece as they are scored, a linear squared-hinge machine on the kernel values to the landmarks, mapped by the inverse root of the landmarks' own kernel matrix. A document
scores as its most toxic segment does, on a scale fitted to the training documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.words import BLOCK_BYTES, as_bytes, blocks
from siftstone.plans.skew import durable

ORDER, DECAY = 3, 0.6
#: bounds of the fit: labelled documents (least id hash first), toxic segments, clean segments, landmarks
MAX_LABELLED, MAX_TOXIC, MAX_CLEAN, LANDMARKS = 20_000, 600, 3_000, 128
#: rounds in which the clean segments that look most toxic join the training set, and how many
HARD_ROUNDS, HARD = 2, 1_500
#: letters compared at once, with the marks of both ends; longer words are compared piece by piece
PIECE = 22
CACHE = 300_000
#: words before and after a segment that make its window
BEFORE, AFTER = 4, 2

_MARKS = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
#: fixed values: digits written for letters
_LETTERS = bytes.maketrans(b"01345", b"oieas")


def segments(text: bytes) -> list[bytes]:
    """Words of a lower-case text without marks; three or more single letters in a row are one word."""
    found = text.translate(_LETTERS, _MARKS).split()
    if sum(len(w) == 1 for w in found) < 3:
        return found
    out, run = [], []
    for w in [*found, b""]:
        if len(w) == 1:
            run.append(w)
            continue
        if len(run) > 2:
            out.append(b"".join(run))
        else:
            out.extend(run)
        run = []
        if w:
            out.append(w)
    return out


def _codes(items: list[str]) -> np.ndarray:
    """Code points, one string per row, padded by 0."""
    width = max(map(len, items), default=1)
    return np.array([s.ljust(width, "\0") for s in items], f"<U{width}").view(np.uint32).reshape(len(items), width)


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Kernel of every row of ``a`` with every row of ``b`` (code points padded by 0), not normalised."""
    la, lb = a.shape[1], b.shape[1]
    same = [[(a[:, None, i] == b[None, :, j]) & (a[:, None, i] != 0) for j in range(lb)] for i in range(la)]
    lam, sq = np.float32(DECAY), np.float32(DECAY * DECAY)
    shape = (len(a), len(b))
    # before[i][j]: weight of the shorter subsequences in the first i letters of a and j of b, decayed up to there
    before = [[np.ones(shape, np.float32)] * (lb + 1)] * (la + 1)
    total = np.zeros(shape, np.float32)
    for step in range(ORDER):
        if step == ORDER - 1:
            for i in range(la):
                for j in range(lb):
                    total += np.where(same[i][j], before[i][j], 0)
            return total * sq
        now = [[np.zeros(shape, np.float32)] * (lb + 1)]
        for i in range(la):
            row, inner = [np.zeros(shape, np.float32)], np.zeros(shape, np.float32)
            for j in range(lb):
                inner = lam * inner + np.where(same[i][j], sq * before[i][j], np.float32(0))
                row.append(lam * now[i][j + 1] + inner)
            now.append(row)
        before = now
    return total


def self_kernel(a: np.ndarray) -> np.ndarray:
    """Kernel of every row with itself."""
    la = a.shape[1]
    lam, sq = np.float32(DECAY), np.float32(DECAY * DECAY)
    same = (a[:, :, None] == a[:, None, :]) & (a[:, :, None] != 0)
    before = np.ones((len(a), la + 1, la + 1), np.float32)
    for _ in range(ORDER - 1):
        now = np.zeros_like(before)
        for i in range(la):
            inner = np.zeros(len(a), np.float32)
            for j in range(la):
                inner = lam * inner + np.where(same[:, i, j], sq * before[:, i, j], 0)
                now[:, i + 1, j + 1] = lam * now[:, i, j + 1] + inner
        before = now
    return (same * before[:, :-1, :-1]).sum(axis=(1, 2)) * sq


def marked(word: str) -> list[str]:
    """The pieces of a word that are compared, with its ends marked; a longer word has pieces that overlap by half."""
    word = f"^{word}$"
    if len(word) <= PIECE:
        return [word]
    return [word[i : i + PIECE] for i in range(0, len(word) - PIECE // 2, PIECE // 2)]


@dataclass
class Machine:
    """Landmarks with their norms, the weight of each one's kernel value, the bias, and the scale that turns a decision into a probability."""

    landmarks: list[str]
    norm: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def similar(self, pieces: list[str]) -> np.ndarray:
        """Normalised kernel of each piece with each landmark."""
        out = np.zeros((len(pieces), len(self.landmarks)), np.float32)
        by_length: dict[int, list[int]] = {}
        for n, z in enumerate(self.landmarks):
            by_length.setdefault(len(z), []).append(n)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        for at in range(0, len(order), 1024):
            rows = order[at : at + 1024]
            a = _codes([pieces[i] for i in rows])
            own = _norm(a)
            for columns in by_length.values():
                b = _codes([self.landmarks[n] for n in columns])
                out[np.ix_(rows, columns)] = kernel(a, b) / own[:, None] / self.norm[columns][None, :]
        return out

    def folded(self) -> tuple[dict[str, int], np.ndarray]:
        """Letters of the landmarks, and per triple of letters the weighted sum of the landmarks' own feature values.

        A kernel value is a product over subsequences, so the weighted sum over landmarks is one product with this table.
        """
        letters = {c: n + 1 for n, c in enumerate(sorted(set("".join(self.landmarks))))}
        table = np.zeros((len(letters) + 1,) * ORDER)
        for z, w in zip(self.landmarks, self.weight / self.norm, strict=True):
            code = np.array([letters[c] for c in z])
            i, j, k = _triples(len(z))
            np.add.at(table, (code[i], code[j], code[k]), w * DECAY ** (k - i + 1.0))
        table[0], table[:, 0], table[:, :, 0] = 0, 0, 0
        return letters, table

    def decider(self):
        """Function from words to decision values: the greatest over a word's pieces."""
        letters, table = self.folded()

        def decide(items: list[str]) -> np.ndarray:
            by_length: dict[int, tuple[list[str], list[int]]] = {}
            for n, word in enumerate(items):
                for piece in marked(word):
                    into = by_length.setdefault(len(piece), ([], []))
                    into[0].append(piece)
                    into[1].append(n)
            value = np.full(len(items), -np.inf)
            for size, (pieces, owner) in by_length.items():
                i, j, k = _triples(size)
                decay = DECAY ** (k - i + 1.0)
                step = max(1, (1 << 20) // max(1, len(i)))
                for at in range(0, len(pieces), step):
                    some = pieces[at : at + step]
                    a = _codes(some)
                    seen, index = np.unique(a, return_inverse=True)
                    code = np.array([letters.get(chr(c), 0) for c in seen])[index.reshape(a.shape)]
                    score = table[code[:, i], code[:, j], code[:, k]] @ decay if len(i) else np.zeros(len(some))
                    np.maximum.at(value, np.array(owner[at : at + step]), score / _norm(a) + self.bias)
            return value

        return decide

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -40, 40)))


def _norm(a: np.ndarray) -> np.ndarray:
    own = np.sqrt(self_kernel(a))
    own[own == 0] = np.inf
    return own


def _triples(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of all subsequences of three letters."""
    found = np.array(list(combinations(range(size), ORDER)), np.int64).reshape(-1, ORDER)
    return found[:, 0], found[:, 1], found[:, 2]


def train(toxic: list[str], clean: list[str], landmarks: int = LANDMARKS, penalty: float = 10.0) -> Machine:
    """Machine on Nystroem features of the given segments, the two classes weighing the same."""
    toxic, clean = (list(dict.fromkeys(p for x in group for p in marked(x))) for group in (toxic, clean))
    known = set(toxic)
    clean = [p for p in clean if p not in known]
    most = landmarks * 3 // 4
    marks = list(dict.fromkeys([*toxic[:most], *clean[: landmarks - min(len(toxic), most)]]))
    machine = Machine(marks, _norm(_codes(marks)), np.zeros(len(marks), np.float32), -1.0)
    gram = machine.similar(marks).astype(np.float64)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    good = values > 1e-4
    root = vectors[:, good] / np.sqrt(values[good])  # maps kernel values to Nystroem features
    x = machine.similar([*toxic, *clean]).astype(np.float64) @ root
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.concatenate([np.ones(len(toxic)), -np.ones(len(clean))])
    cost = np.where(y > 0, len(y) / (2 * max(len(toxic), 1)), len(y) / (2 * max(len(clean), 1))) * penalty / len(y) * 100
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(50):  # Newton steps on the squared hinge
        active = y * (x @ w) < 1
        xa, ca = x[active], cost[active]
        new = np.linalg.solve(ridge + (xa * ca[:, None]).T @ xa, (xa * ca[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    machine.weight, machine.bias = root @ w[:-1], float(w[-1])
    return machine


def calibrate(machine: Machine, value: np.ndarray, toxic: np.ndarray) -> None:
    """Probability scale: one half where the training documents' F1 is greatest, and as steep as the values are spread."""
    if not len(value) or toxic.all() or not toxic.any():
        return
    order = np.argsort(-value, kind="stable")
    v, hits = value[order], np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(v) + 1) + toxic.sum())
    f1[:-1][v[1:] == v[:-1]] = 0  # equal values fall on one side
    best = int(np.argmax(f1))
    below = v[best + 1] if best + 1 < len(v) else v[best] - 1.0
    middle = (v[best] + below) / 2
    spread = max(float(np.abs(value - middle).mean()), 1e-6)
    machine.slope = 2.0 / spread
    machine.shift = -machine.slope * middle


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment and side: documents (as window null), and each different window of words around it."""
    for batch in batches:
        for part in blocks(batch):
            docs: dict[tuple[bytes, bool], int] = {}
            seen: dict[tuple[bytes, bool], set[int]] = {}
            for text, toxic in zip(as_bytes(part.column(0), lower=True), part.column(1).to_pylist(), strict=True):
                found = segments(text)
                mine: dict[bytes, set[int]] = {}
                for i, w in enumerate(found):
                    if len(w) >= ORDER:
                        mine.setdefault(w, set()).add(xxhash.xxh64_intdigest(b" ".join(found[max(0, i - BEFORE) : i + AFTER + 1])) - (1 << 63))
                for w, windows in mine.items():
                    docs[w, toxic] = docs.get((w, toxic), 0) + 1
                    seen.setdefault((w, toxic), set()).update(windows)
            text_of = {w: w.decode(errors="replace") for w in {w for w, _ in docs}}
            rows = [(text_of[w], toxic, n, None) for (w, toxic), n in docs.items()]
            rows += [(text_of[w], toxic, 0, x) for (w, toxic), windows in seen.items() for x in windows]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            types = [pa.string(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["segment", "toxic", "n", "window"])


def _score_task(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        decide = machine.decider()
        for batch in batches:
            for part in blocks(batch, limit=BLOCK_BYTES):
                docs = [set(segments(t)) for t in as_bytes(part.column(1), lower=True)]
                if len(known) > CACHE:
                    known.clear()
                new = list(set().union(*docs) - known.keys())
                known.update(zip(new, decide([w.decode(errors="replace") for w in new]).tolist(), strict=True))
                value = np.array([max(map(known.__getitem__, d), default=machine.bias) for d in docs], np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(value), pa.array(machine.probability(value))], ["doc_id", "decision", "score"])

    return run


def _decide_task(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = machine.decider()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decide(batch.column(0).to_pylist()))], ["segment", "decision"])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Machine:
    """Machine learnt from ``labels`` (doc_id, toxic) and the texts of ``docs`` (doc_id, text). Ids that carry both labels are left out."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("t1"))
    known = durable(known.where("toxic = t1").select(F.col("doc_id").alias("__id"), "toxic").orderBy(F.xxhash64("__id"), "__id").limit(max_labelled), "labelled")
    rows = docs.join(F.broadcast(known), docs["doc_id"] == known["__id"])  # at most max_labelled rows
    rows = durable(rows.select("text", (F.col("toxic") == 1).alias("toxic")).dropDuplicates(), "sentences")
    share = min(max(rows.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0, 1e-6), 1 - 1e-6)
    counts = rows.mapInArrow(_count_task, "segment string, toxic boolean, n long, window long")
    counts = counts.groupBy("segment", "toxic", "window").agg(F.sum("n").alias("n"))  # every window once
    side = lambda v, x: F.sum(F.when(F.col("toxic") == v, x).otherwise(0))
    windows = F.when(F.col("window").isNotNull(), 1).otherwise(0)
    stats = counts.groupBy("segment").agg(
        side(True, F.col("n")).alias("n1"), side(True, windows).alias("w1"), side(False, F.col("n")).alias("n0"), side(False, windows).alias("w0")
    )
    stats = durable(stats.where(F.length("segment") >= ORDER), "segments")
    types = max(stats.count(), 1)
    t = F.least("w1", "n1").cast("double")
    c = F.least("w0", "n0").cast("double")
    part = lambda x, p: F.when(x > 0, x * F.log(x / ((t + c) * F.lit(p)))).otherwise(0.0)
    odds = part(t, share) + part(c, 1 - share)
    toxic = stats.where((t > (t + c) * 0.8) & (odds > math.log(types) + 1)).orderBy(F.desc(odds), "segment").limit(MAX_TOXIC)
    toxic = [r["segment"] for r in toxic.select("segment").collect()]
    # clean segments: half the most common ones, half any
    clean_rows = durable(stats.where((c > 0) & (c >= (t + c) * (1 - share) * 0.5)).select("segment", "n0"), "clean")
    clean = [r["segment"] for s in ([F.desc("n0"), F.col("segment")], [F.xxhash64("segment")]) for r in clean_rows.orderBy(*s).limit(MAX_CLEAN // 2).collect()]
    clean = [s for s in dict.fromkeys(clean[1::2] + clean[0::2]) if s not in set(toxic)]
    if not toxic or not clean:
        return Machine(["^$"], np.array([np.inf]), np.zeros(1), -1.0)
    machine = train(toxic, clean)
    for _ in range(HARD_ROUNDS):
        like = clean_rows.select("segment").mapInArrow(_decide_task(machine), "segment string, decision double").orderBy(F.desc("decision"), "segment")
        hard = [r["segment"] for r in like.limit(HARD).collect()]
        clean = list(dict.fromkeys([*clean, *(s for s in hard if s not in set(toxic))]))
        machine = train(toxic, clean)
    scored = rows.select(F.col("toxic").cast("long").alias("doc_id"), "text").mapInArrow(_score_task(machine), "doc_id long, decision double, score double")
    pairs = scored.select("doc_id", "decision").collect()  # at most max_labelled rows
    calibrate(machine, np.array([r["decision"] for r in pairs]), np.array([r["doc_id"] for r in pairs], np.float64))
    return machine


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted: every whole text by a machine learnt from the labels outside the held-out fifth.

    Held out are ids whose crc32 as text leaves 0 modulo 5. Texts alone decide a score: null, empty and word-less ones have that of no toxic segment. Rows
    with a null id are scored, with held_out null; repeated rows are scored alike. With no toxic segment to learn from all scores
    are below 0.5. Other columns are ignored; an empty table gives no rows.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    seen = labels.select(F.col(id_col).cast("long").alias("doc_id"), "toxic").where(~held)
    machine = fit(narrow, seen)
    scored = narrow.mapInArrow(_score_task(machine), "doc_id long, decision double, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
