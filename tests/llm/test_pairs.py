"""Near duplicates, decontamination, passage removal, top-k: against plain versions on small tables."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.llm.components import components, merged
from siftstone.llm.decontam import contained_items, decontaminate
from siftstone.llm.near import T, fast_sketches, near_duplicates
from siftstone.llm.substring import remove_repeats
from siftstone.llm.topk import exact_top_k, quantised

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
DOCS = "doc_id long, text string, source string, kept boolean, bucket string"


def corpus(n=160, seed=3):
    """Random texts, copies with edits, exact copies, shared passages, and odd rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(20))
    texts = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.35 and texts:
            words = (rng.choice(texts) or "").split()
            for _ in range(rng.randint(0, 4)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append("  ".join(words).upper() if rng.random() < 0.2 else "\n".join(words))
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 80))]
            if rng.random() < 0.3:
                words[len(words) // 2 : 1] = [passage]
            texts.append(" ".join(words))
    texts += ["", None, " \t\n", "one", "one", "one two", "one two three", "Éa éa", "x " * 30_000]
    return [(i, t, "s", True, "b") for i, t in enumerate(texts)]


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def plain_components(rows, n):
    sets = {i: shingles(t, n) for i, t, *_ in rows}
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                for k, g in group.items():
                    if g == max(a, b):
                        group[k] = min(a, b)
    return {(i, len(sets[i]), group[i], group[i] == i) for i in sets}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_equal_all_pairs(spark, n):
    rows = corpus()
    got = near_duplicates(spark.createDataFrame(rows + rows[:5] + [(None, "x", "s", True, "b")], DOCS), shingle=n)
    assert {tuple(r) for r in got.collect()} == plain_components(rows, n)


def test_near_duplicates_of_a_large_loose_group(spark):
    """Copies of one text with so many edits that many of them are under the threshold for each other."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(100)] = f"e{rng.random()}"
        rows.append((i, " ".join(words), "s", True, "b"))
    got = near_duplicates(spark.createDataFrame(rows, DOCS), shingle=2)
    assert {tuple(r) for r in got.collect()} == plain_components(rows, 2)


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        near_duplicates(spark.createDataFrame([], DOCS), percent=50)


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    b = np.concatenate([a[:3000], rng.integers(0, 2**63, 1000, dtype=np.uint64)])
    x, y, one, none = fast_sketches([a, b, a[:1], a[:0]])
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    assert (x != full).all() and (one != full).all() and (none == full).all()
    assert abs((x == y).mean() - 0.6) < 4 * (0.24 / T) ** 0.5


def test_components_and_merged(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 300)]
    comp = components(spark.createDataFrame(edges, "a long, b long"))
    want = {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 140)} | {200: 200, 300: 200}
    assert {r["node"]: r["component"] for r in comp.collect()} == want
    more = merged(comp, spark.createDataFrame([(60, 139), (400, 401)], "a long, b long"))
    want = {k: 1 if v == 100 else v for k, v in want.items()} | {400: 400, 401: 400}
    assert {r["node"]: r["component"] for r in more.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_contained_items(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"q{rng.randrange(500)}" for _ in range(rng.randint(6, 40)))) for i in range(30)]
    items += [(30, "Two words"), (31, ""), (32, None), (33, "..."), (34, "One, two; THREE four"), (None, "x y z a b c")]
    docs = corpus(60)
    for i in range(30):
        words = items[i][1].split()
        cut = words[: int(len(words) * rng.choice([0.5, 0.85, 1.0]))]
        docs.append((1000 + i, "Start " + ", ".join(cut).upper() + "! " + (docs[i][1] or ""), "s", True, "b"))
    docs += [(2000, "so two WORDS, then", "s", True, "b"), (2001, "a one two three four z", "s", True, "b"), (None, items[0][1], "s", True, "b")]

    def words_of(text):
        drop = re.sub(r"[!-/:-@\[-`{-~]", "", (text or "").lower())
        return WORD.findall(drop)

    want = set()
    for item, text in items:
        w = words_of(text)
        n = min(5, len(w))
        s = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for doc, t, *_ in docs:
            v = words_of(t)
            common = len(s & {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}) if s else 0
            if s and item is not None and doc is not None and 100 * common >= 80 * len(s):
                want.add((doc, item, len(s), common))
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in contained_items(d, b).collect()} == want and len(want) > 15
    bad = {x[0] for x in want}
    kept = decontaminate(d, b)
    assert kept.columns == d.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(x[0]) for x in docs if x[0] not in bad)
    assert contained_items(d, b.limit(0)).count() == 0 and contained_items(d.limit(0), b).count() == 0


def plain_cut(rows, k):
    words = {i: WORD.findall(t or "") for i, t, *_ in rows}
    least = {}
    for i in sorted(words):
        for a in range(len(words[i]) - k + 1):
            least.setdefault(tuple(words[i][a : a + k]), i)
    out = set()
    for i, w in words.items():
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            if least[tuple(w[a : a + k])] < i:
                gone[a : a + k] = [True] * k
        out.add((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("k,m", [(13, 3), (5, 1), (3, 3)])
def test_repeats_are_cut(spark, k, m):
    rows = corpus()
    got = remove_repeats(spark.createDataFrame([*rows, (None, rows[0][1], "s", True, "b")], DOCS), k=k, m=m)
    assert {tuple(r) for r in got.collect()} == plain_cut(rows, k)


def test_repeats_with_heavy_minimisers(spark, monkeypatch):
    """Windows of heavy minimisers travel one by one and are cut just the same."""
    from siftstone.llm import substring

    monkeypatch.setattr(substring, "SAMPLE", 1.0)
    monkeypatch.setattr(substring, "LEAST_HEAVY", 10_000)
    monkeypatch.setattr(substring, "BUCKET_BYTES", 100_000)
    seen = []
    original = substring._pack_task

    def watched(k, m, heavy, keys):
        seen.append(len(heavy))
        return original(k, m, heavy, keys)

    monkeypatch.setattr(substring, "_pack_task", watched)
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(40))
    rows = [(i, f"{text} x{i} {text} y{i % 3}", "s", True, "b") for i in range(1000)]
    got = remove_repeats(spark.createDataFrame(rows, DOCS))
    assert {tuple(r) for r in got.collect()} == plain_cut(rows, 13)
    assert seen[0] > 0


def test_repeats_of_nothing(spark):
    assert remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def plain_top(vectors, queries, k):
    out = set()
    for q, x in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), v) for v, y in vectors.items() if v != q and len(x) == len(y))
        out |= {(q, r + 1, v, -s) for r, (s, v) in enumerate(scored[:k])}
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    from siftstone.llm import topk

    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    rng = np.random.default_rng(4)
    vectors = {i: rng.integers(-50, 50, 6).tolist() for i in range(400)}
    vectors |= {i: [9, 9, 9, 9, 9, 9] for i in range(400, 520)}  # one vector many times
    vectors |= {600: [1, 2], 601: [3, 4], 602: [], 603: [], 604: [5]}
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors.items()] + [(5, vectors[5], 1), (None, [1] * 6, 1), (700, None, 1)], "vec_id long, vec array<long>, rank int")
    asks = {i: v for i, v in vectors.items() if i % 7 == 0 or i >= 600}
    got = exact_top_k(df, df.where(F.col("vec_id").isin(list(asks))), 5)
    assert {tuple(r) for r in got.collect()} == plain_top(vectors, asks, 5)
    assert exact_top_k(df.limit(0), df, 5).count() == 0 and exact_top_k(df, df.limit(0), 5).count() == 0


def test_quantised_leaves_out_broken_vectors(spark):
    rows = [(1, [0.5, -0.001]), (2, None), (3, [1.0, None]), (4, [float("nan")]), (5, [float("inf")]), (6, [])]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "i int, v array<float>").select("i", quantised(F.col("v"))).collect()}
    assert got == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: []}
