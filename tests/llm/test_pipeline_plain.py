"""The whole pipeline against plain Python, stage by stage and row by row. Only token and id hashes come from the library."""

import collections
import hashlib
import heapq
import math
import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from siftstone.llm import mixing
from siftstone.llm.quality import BUCKETS, LEAST_POSTERIOR, SCALE
from siftstone.llm.sharding import HEAP_ITEMS
from siftstone.llm.words import KINDS, mix, shingles, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text, n, lower, marks=""):
    found = WORD.findall(re.sub(marks, "", lower(text or "")) if marks else lower(text or ""))
    return {tuple(found[i : i + n]) for i in range(len(found) - n + 1)} or ({tuple(found)} if found else set())


def plain_quality(rows, labels):
    def grams(text):
        found = words([(text or "").encode()], kinds=KINDS)
        code, pairs = found.code.tolist(), shingles(found, 2)[0].tolist()
        out = [c % (BUCKETS - 3) + 3 for c in code]
        out += [1 if a == b else p % (BUCKETS - 3) + 3 for a, b, p in zip(code, code[1:], pairs, strict=False)]
        return out + [2 for a, b in zip(code, code[2:], strict=False) if a == b]

    quality = collections.defaultdict(set)
    for i, q, _ in labels:
        if i is not None and q is not None:
            quality[i].add(q)
    quality = {i: min(q) for i, q in quality.items() if len(q) == 1}
    raw, target = collections.Counter(), collections.Counter()
    each = [collections.Counter(grams(r[1])) for r in rows]
    for r, g in zip(rows, each, strict=True):
        raw.update(g)
        if quality.get(r[0]) == 1:
            target.update(g)
    n_raw, n_target = sum(raw.values()), sum(target.values())
    ratio = [round((math.log((target[b] + 1) / (n_target + BUCKETS)) - math.log((raw[b] + 1) / (n_raw + BUCKETS))) * SCALE) for b in range(BUCKETS)]
    weights = [sum(n * ratio[b] for b, n in g.items()) for g in each]
    keys = []
    for r, weight in zip(rows, weights, strict=True):
        bits = int(mix(np.array([-1 if r[0] is None else r[0]]).astype(np.int64).view(np.uint64), 9)[0])
        keys.append(weight + round(-math.log(-math.log(((bits >> 11) + 0.5) / 2**53)) * SCALE))
    share = sum(q == 1 for q in quality.values()) / len(quality)
    k = sum(w >= math.log(LEAST_POSTERIOR / share) * SCALE for w in weights)
    return [r for r, key in zip(rows, keys, strict=True) if key >= sorted(keys, reverse=True)[k - 1]]


def plain_near(rows):
    first = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: [(v is not None, v) for v in r]):
        first.setdefault(r[0], r)
    lower = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    sets = {i: sets_of(r[1], 5, lower) for i, r in first.items()}
    root = {i: i for i in first}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in first:
        for b in first:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [r for i, r in first.items() if find(i) == i] + [r for r in rows if r[0] is None]


def plain_clean(rows, items):
    marks = r"[!-/:-@\[-`{-~]"
    wanted = [sets_of(t, 5, str.lower, marks) for _, t in items]

    def holds(text, item):
        n = len(next(iter(item)))
        found = WORD.findall(re.sub(marks, "", (text or "").lower()))
        return 100 * len(item & {tuple(found[i : i + n]) for i in range(len(found) - n + 1)}) >= 80 * len(item)

    return [r for r in rows if r[0] is None or not any(item and holds(r[1], item) for item in wanted)]


def plain_mix(rows):
    def cell(r):
        t = r[1] or ""
        topic = "table" if " | " in t else "contact" if "@" in t else "noisy" if "!!" in t or "%%%" in t else "prose"
        return r[3], r[2], topic

    tokens = collections.Counter()
    for r in rows:
        tokens[cell(r)] += len(WORD.findall(r[1] or ""))
    total, fitted = sum(tokens.values()), {c: float(n) for c, n in tokens.items()}
    goals = []
    for d, name in enumerate(mixing.DIMENSIONS):
        sums = collections.Counter()
        for c, n in tokens.items():
            sums[c[d]] += n
        powers = {v: n ** mixing.TEMPER[name] for v, n in sums.items()}
        goals.append({v: w / sum(powers.values()) * total for v, w in powers.items()})
    for _ in range(mixing.ROUNDS):
        for d, goal in enumerate(goals):
            now = collections.Counter()
            for c, f in fitted.items():
                now[c[d]] += f
            fitted = {c: f * goal[c[d]] / now[c[d]] if now[c[d]] else 0.0 for c, f in fitted.items()}
    out = []
    for r in rows:
        c = cell(r)
        weight = mixing.FRACTION * fitted[c] / tokens[c] if tokens[c] else 0.0
        draw = int(hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:8], 16) / 2**32
        out += [r] * (math.floor(weight) + (draw < weight - math.floor(weight)))
    return out


def plain_shards(rows, shards):
    sizes = collections.Counter()
    name = lambda r: hashlib.sha256((r[1] or "").encode()).hexdigest()
    for r in rows:
        sizes[name(r)] += len((r[1] or "").encode()) + 8
    bundles, total, item = HEAP_ITEMS * shards, sum(sizes.values()), {}
    for g, size in sizes.items():
        code = xxhash.xxh64_intdigest(g, seed=42)
        item[g] = g if size * bundles >= total else f"bundle-{(code - (code >> 63 << 64)) % bundles}"
    items = collections.Counter()
    for g, size in sizes.items():
        items[item[g]] += size
    heap, placed = [(0, s) for s in range(shards)], {}
    for i, size in sorted(items.items(), key=lambda x: (-x[1], x[0])):
        load, placed[i] = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, placed[i]))
    return [(*r, placed[item[name(r)]]) for r in rows]


def corpus():
    """Good and bad documents with exact, near and far copies, benchmark passages, repeated ids, nulls, empty and long texts."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["ta", "ri", "no", "vel", "sha", "ku", "em", "or"]) for _ in range(rng.randint(1, 4)))
    items = [(n, " ".join(word() for _ in range(rng.choice([3, 12, 30])))) for n in range(6)]
    rows, labels = [], []
    for i in range(420):
        text = [word() for _ in range(rng.randint(5, 70))]
        good = rng.random() < 0.8
        if rng.random() < 0.1:
            text[3:3] = items[rng.randrange(6)][1].split()
        if i > 20 and rng.random() < 0.2:  # a copy, with a word more or changed in some
            text = (rows[rng.randrange(i)][1] or "x").split()
            if rng.random() < 0.6:
                text[rng.randrange(len(text))] = "changed"
        if rng.random() < 0.1:
            text.append(rng.choice(["a@b.c", "this | that", "%%%"]))
        text = " ".join(text) if good else " ".join(w.upper() + "!!" for w in text)
        rows.append((i, text, rng.choice(["en", "en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None]), len(text)))
        if i % 2:
            labels.append((i, int(good), 0))
    rows += [(900, None, None, None, None), (901, "", "en", "a", 0), (902, "word " * 30_000, "en", "b", 1), (None, "no id here at all", "en", "a", 1), rows[4], rows[4]]
    return rows, [*labels, (1, 0, 0), (None, 1, 0), (2, None, 1)], items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    rows, labels, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline_equals_plain_python(spark, folder):
    rows, labels, items = corpus()
    plain = [
        lambda r: plain_quality(r, labels),
        plain_near,
        lambda r: plain_clean(r, items),
        plain_mix,
        lambda r: plain_shards(r, corpus_pipeline.SHARDS),
    ]
    step = spark.read.parquet(f"{folder}/documents.parquet")
    for n, ((name, stage), expected) in enumerate(zip(corpus_pipeline.STAGES, plain, strict=True)):
        stage(spark, step, folder).write.parquet(f"{folder}/out{n}")
        step = spark.read.parquet(f"{folder}/out{n}")
        before, rows = rows, expected(rows)
        assert collections.Counter(map(tuple, step.collect())) == collections.Counter(rows), name
        assert n == 4 or collections.Counter(rows) != collections.Counter(before), name
    assert collections.Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == collections.Counter(rows)
