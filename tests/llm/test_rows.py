"""Mixing, toxicity, pages, chat, quality, sharding and the pipeline on small tables."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftstone.llm import chat, mixing, sharding
from siftstone.llm.html_template import extract_main_text, main_text, template, walk
from siftstone.llm.quality import SCALE, importance_sample
from siftstone.llm.toxicity import _codes, kernel, score_toxicity, segments, self_kernel, train

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, kept boolean, mix_kept string"


def documents(n=300, seed=1):
    rng = random.Random(seed)
    syllables = ["ta", "ri", "no", "vel", "sha", "ku", "em", "or", "lin", "pas"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 60))]
        toxic, good = rng.random() < 0.3, rng.random() < 0.8
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["gnurfbox", "gnurfbax", "zwikko"]))
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "c"]), len(text), "x", True, "y"))
        if i % 3:
            labels.append((i, int(good), int(toxic)))
    rows += [(n, None, None, None, None, None, None, None), (n + 1, "", "en", "a", 0, "x", True, "y"), (n + 2, "word " * 40_000, "en", "zz", 1, "x", True, "y")]
    rows.append(rows[3])
    labels += [(1, 1, 1), (1, 0, 0), (None, 1, 1), (2, None, None)]
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = documents()
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def test_raking_meets_all_marginals(spark):
    rng = random.Random(3)
    cells = [(s, l, t, rng.randint(1, 900)) for s in ("a", "b", None) for l in ("en", None) for t in ("p", "q")] + [("a", "en", "r", 0)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    targets = mixing.tempered_targets(df, {"source": 0.5, "lang": 0.5, "topic": 1.0})
    fitted = mixing.rake(df, targets, rounds=6).collect()
    shares = {(r["dim"], r["value"]): r["share"] for r in targets.collect()}
    total = sum(c[3] for c in cells)
    for dim in mixing.DIMENSIONS:
        sums = collections.Counter()
        for r in fitted:
            sums[r[dim]] += r["fitted"]
        for value, x in sums.items():
            assert x == pytest.approx(shares[dim, value] * total, rel=1e-3, abs=1e-6)


def test_mixture_keeps_rows_and_calibrates(tables):
    docs, _, rows, _ = tables
    out = mixing.mixture(docs)
    got = out.collect()
    assert len(got) == len(rows) and set(docs.columns) <= set(out.columns)
    for r in got:
        assert r["mix_kept"] == (r["mix_draw"] < r["mix_probability"]) and 0 <= r["mix_probability"] <= 1
        want = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:8], 16) / 2**32
        assert r["mix_draw"] == want
    assert mixing.mixture(docs.limit(0)).count() == 0


def test_kernel_is_the_sum_over_subsequences():
    def features(s):
        f = collections.Counter()
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, len(s)):
                    f[s[i] + s[j] + s[k]] += 0.6 ** (k - i + 1)
        return f

    strings = ["loser", "loxser", "l", "", "aaaa", "resol", "abcabcabc"]
    got = kernel(_codes(strings), _codes(strings))
    for i, a in enumerate(strings):
        for j, b in enumerate(strings):
            fa, fb = features(a), features(b)
            assert got[i, j] == pytest.approx(sum(v * fb[u] for u, v in fa.items()), rel=1e-4, abs=1e-6)
    assert self_kernel(_codes(strings)) == pytest.approx(np.diag(got), rel=1e-4, abs=1e-6)


def test_machine_tolerates_gaps_and_folds_exactly():
    rng = random.Random(2)
    clean = sorted({"".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 9))) for _ in range(400)})
    machine = train(["stupid", "worthless", "pathetic", "moron"], clean)
    decide = machine.decider()
    words = ["stupid", "stuxpid", "worthhless", "patheticc", *clean[:50]]
    direct = machine.similar([f"^{w}$" for w in words]) @ machine.weight + machine.bias
    assert decide(words) == pytest.approx(direct, abs=1e-4)
    assert (decide(["stupid", "stuxpid", "worthhless", "patheticc"]) > np.percentile(decide(clean), 99)).all()
    assert segments(b"you are a l.o.s.e.r and a m o r o n 1d10t") == [b"you", b"are", b"a", b"loser", b"and", b"amoron", b"idiot"]


def test_toxicity_on_held_out_rows(tables):
    docs, labels, rows, known = tables
    got = {r["doc_id"]: r for r in score_toxicity(docs, labels).collect()}
    assert len(got) == len(rows) - 1
    truth = {i: t for i, _, t in known if i is not None and t is not None and i != 1}
    held = [i for i in truth if got[i]["held_out"]]
    assert len(held) > 20 and np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[300]["predicted"] == got[301]["predicted"] == 0
    assert score_toxicity(docs.limit(0), labels).count() == 0
    assert {r["predicted"] for r in score_toxicity(docs, labels.limit(0)).collect()} == {0}


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>Menu {0}</a></ul></nav>"
    "<div class='ad'>Buy {0}</div><div id='post-{0}'><h1>Head &amp; {0}</h1><p>One <b>bo</b>ld\n  text<br>more<p>Second &lt;tag&gt;</p><div class='comments'>Reader {0}</div></div>"
    "<div class='sidebar'>Side</div><form>Name <input></form><footer>&copy; {0}</footer>"
)


def test_pages_keep_the_main_slot_only(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i), "t") for i in range(6)]
    rows += [(10, "http://lone.example/", PAGE.format(10), "t"), (11, None, None, "t"), (12, "not a url", "", "t"), (13, "http://h.example/odd", "plain &quot;text&quot; <i>only", "t"), (None, None, "<p>x</p>", "t")]
    rows.append((14, "http://long.example/", "<article>" + "<p>word word</p>" * 20_000 + "</article>", "t"))
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    for i in (*range(6), 10):
        assert got[i] == f"Head & {i} One bold text more Second <tag>"
    assert got[11] == got[12] == "" and got[13] == 'plain "text" only' and got[None] == "x" and len(got[14]) == 20_000 * 10 - 1
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_classes_nest():
    roles, pieces = walk(PAGE.format(1))
    assert roles["/html/body/nav"][2] and roles["/html/body/div.ad"][2] and not roles["/html/body/div#post-"][2]
    valid, slot = template({r: ((c,), c, 1, size, out) for r, (c, size, out) in roles.items()})
    assert slot == "/html/body/div#post-" and "/html/body" in valid
    assert main_text(pieces, slot).startswith("Head & 1")


def test_chat_round_trip(spark):
    rng = random.Random(6)
    scraps = ["</s>", "<s>", "[INST]", "&lt;", "&amp;", "\n", "é", "a", " ", "", "\\", "&nl;"]
    text = lambda: "".join(rng.choice(scraps) for _ in range(rng.randint(0, 9)))
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 8)):
            rows.append((c if c else None, t, rng.choice(["user", "assistant", "system", "a\nb", None]), rng.choice([text(), None]), "x"))
    rows += [(50, t, "assistant" if t % 2 else "user", "word " * 50, "x") for t in range(300)]
    rows += [(51, 0, "user", "same", "x"), (51, 0, "user", "same", "x"), (51, None, "assistant", "first", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, last string")
    got = {r["conv_id"]: r for r in chat.digests(chat.prefix_examples(turns)).collect()}
    low = lambda v: (v is not None, v if v is not None else 0)
    by = collections.defaultdict(list)
    for c, t, r, x, _ in rows:
        by[c].append((low(t), (r is not None, r or ""), (x is not None, x or "")))
    assert set(got) == set(by)
    for c, found in by.items():
        said = [(r[1], x[1]) for _, r, x in sorted(found)]
        loss = "".join(x for r, x in said if r == "assistant")
        assert got[c]["n_turns"] == len(said)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in said).encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    examples = chat.prefix_examples(turns.where("conv_id = 50"))
    assert examples.count() == 150 and examples.agg(F.max("turns")).first()[0] == 300
    assert chat.prefix_examples(turns.limit(0)).count() == 0


def test_importance_sampling_keeps_good_and_matches_plain(tables):
    docs, labels, rows, known = tables
    got = importance_sample(docs, labels).collect()
    assert len(got) == len(rows)
    truth = {i: q for i, q, _ in known if i not in (1, None) and q is not None}
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert np.mean([kept[i] for i, q in truth.items() if q]) > 0.97
    assert np.mean([kept[i] for i, q in truth.items() if not q]) < 0.1
    keys = sorted((r["sample_key"] for r in got), reverse=True)
    assert sum(kept.values()) > 0 and min(r["sample_key"] for r in got if r["kept"]) > max(r["sample_key"] for r in got if not r["kept"])
    assert keys[0] < 10_000 * SCALE
    narrow = {r["doc_id"]: r["kept"] for r in importance_sample(docs, labels, keep=["doc_id"]).collect()}
    assert narrow == kept
    assert importance_sample(docs.limit(0), labels).count() == 0
    assert all(r["kept"] for r in importance_sample(docs, labels.limit(0)).collect())


def test_importance_weight_is_the_log_ratio(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "z !! z !! z")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r["log_weight"] / SCALE for r in importance_sample(docs, labels).collect()}
    n, raw, target = 1 << 14, 2 * 3 + 5 + 4 + 3, 2 * 3
    # every n-gram of the good text occurs twice in the target and twice in all
    assert got[1] == got[2] == pytest.approx(3 * (np.log(3 / (target + n)) - np.log(3 / (raw + n))), abs=1e-4)
    assert got[3] < got[1]


def test_shards_follow_longest_first(tables):
    docs, _, rows, _ = tables
    out = sharding.assign_shards(docs, 5)
    got = out.collect()
    assert len(got) == len(rows) and out.columns == [*(c for c in docs.columns if c != "shard"), "shard"]
    place = collections.defaultdict(set)
    load = collections.Counter()
    for r in got:
        place[r["text"] or ""].add(r["shard"])
        load[r["shard"]] += len((r["text"] or "").encode()) + 8
    assert all(len(s) == 1 for s in place.values())
    rest = sorted(load.values())[:-1]  # the one very long text fills a shard
    assert max(rest) - min(rest) <= 0.1 * np.mean(rest)
    slots = sharding.number_slots(out.select("doc_id", "shard", "n_chars")).collect()
    for s in range(5):
        mine = sorted((r["slot"], r["doc_id"]) for r in slots if r["shard"] == s)
        assert [x[0] for x in mine] == list(range(len(mine))) and [x[1] for x in mine] == sorted(x[1] for x in mine)
    assert sharding.assign_shards(docs.limit(0), 5).count() == 0


def test_heap_is_longest_first():
    assert sharding.longest_first([(5, "a"), (4, "b"), (3, "c"), (3, "d"), (1, "e")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def test_pipeline_stages(spark, tables, tmp_path):
    docs, labels, rows, _ = tables
    item = " ".join(rows[5][1].split()[:30]) or "none"
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    step, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, step, str(tmp_path))
        assert out.columns == [*plain.columns, *(["shard"] if n == 4 else [])]
        assert stage(spark, step.limit(0), str(tmp_path)).count() == 0
        out.write.parquet(str(tmp_path / f"out{n}"))
        step = spark.read.parquet(str(tmp_path / f"out{n}"))
        seen.append({r["doc_id"] for r in step.select("doc_id").collect()})
    assert all(a >= b for a, b in zip(seen, seen[1:], strict=False)) and seen[3] == seen[4]
    assert 5 not in seen[2]
    ids = [r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out1")).collect()]
    assert len(ids) == len(set(ids))
    whole = {(r["doc_id"], r["shard"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {(r["doc_id"], r["shard"]) for r in step.collect()}


def test_pages_are_not_lost_by_names(spark):
    long = "<h1>Head</h1><p>" + "text " * 20 + "</p>"
    bodies = [
        f"<head><title>T</title></head><body class='home has-sidebar'><nav>Menu</nav>{long}</body>",
        f"<head><title>T</title></head><body><main class='no-comments'>{long}</main></body>",
        f"<head><title>T</title></head><body><article class='related-post'>{long}</article></body>",
        f"<head><title>T</title><meta name=x><body>{long}",
        f"<body><div class='page with-sidebar'>{long}<div class='sidebar'>Side</div></div></body>",
        f"<body><form id='aspnetForm'>{long}</form></body>",
        f"<body><nav>Menu<main>{long}</main></body>",
    ]
    rows = [(10 * n + i, f"http://h{n}.example/{i}" if i < 3 else f"http://lone{n}.example/", f"<html>{b}</html>") for n, b in enumerate(bodies) for i in range(4)]
    # on one page of the host the wrapper holds less than half of the text
    rows.append((90, "http://h4.example/short", "<html><body><div>" + "title " * 9 + "</div><div class='page with-sidebar'><h1>Short</h1></div></body></html>"))
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = "Head " + " ".join(["text"] * 20)
    assert {i: t for i, t in got.items() if i != 90 and t != want} == {}
    assert "Short" in got[90]


def test_pages_keep_all_open_slots(spark):
    def page(host, i):
        a, b = " ".join(f"one{i}" for _ in range(30)), " ".join(f"two{i}" for _ in range(20))
        if host == 0:  # heading and lead beside the body of the article; the line above is equal on all pages
            return f"<body><div class='top'>Our site</div><article><h1>H{i}</h1><p class='lead'>Lead {i}</p><div class='body'>{a}</div></article></body>", f"H{i} Lead {i} {a}"
        if host == 1:  # two containers of one article
            return f"<body><div class='top'>Our site</div><div class='page'><div class='a'>{a}</div><div class='b'>{b}</div></div></body>", f"{a} {b}"
        if host == 2:  # copies: equal text is all there is
            return "<body><div class='a'>same long text</div><div class='b'>same</div></body>", "same long text same"
        return f"<body>Start {i} <div>{a}</div></body>", f"Start {i} {a}"

    rows = [(10 * h + i, f"http://h{h}.example/{i}", f"<html>{page(h, i)[0]}</html>") for h in range(4) for i in range(4)]
    rows += [(100, "http://lone.example/", f"<html>{page(3, 7)[0]}</html>"), (101, "http://bare.example/", "Hello <div>" + "x" * 50 + "</div>")]
    want = {10 * h + i: page(h, i)[1] for h in range(4) for i in range(4)} | {100: page(3, 7)[1], 101: "Hello " + "x" * 50}
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_mixture_meets_the_targets_with_a_rare_language(spark):
    langs = ["en"] * 2910 + ["de"] * 30 + ["fr"] * 30 + ["es"] * 30
    rows = [(i, "word " * 20, lang, "ab"[i % 2]) for i, lang in enumerate(langs)]
    got = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    roots = {lang: langs.count(lang) ** mixing.TEMPER["lang"] for lang in set(langs)}
    for lang, root in roots.items():
        mine = [r for r in got if r["lang"] == lang]
        want = mixing.FRACTION * len(rows) * root / sum(roots.values())
        assert sum(r["mix_weight"] for r in mine) == pytest.approx(want, rel=1e-3)
        assert sum(r["mix_copies"] for r in mine) == pytest.approx(want, rel=0.1)
    assert all((r["mix_copies"] > 0) == r["mix_kept"] for r in got) and max(r["mix_copies"] for r in got) > 1


def test_frequent_insults_are_learnt(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ta", "ri", "no", "vel", "sha", "ku", "em", "lin"]) for _ in range(rng.randint(2, 4)))
    rows, labels = [], []
    for i in range(2400):
        words = [word() for _ in range(8)]
        if i < 100:  # always behind the same word
            words[5:5] = ["you", "gnurfbox"]
        elif i < 700 or i >= 2280:  # in many documents, a sixth of them clean
            words.insert(3, "zwikkopp")
        elif i < 760:  # longer than a piece, its meaning behind the first one
            words.insert(3, "tarinotarinotarinotarinoo" + "bzzwqq")
        else:
            words[5:5] = ["you"] if i % 3 else []
        rows.append((i, " ".join(words)))
        labels.append((i, int(i < 760)))
    n = len(rows)
    rows += [(n + i, w) for i, w in enumerate(["gnurfbox", "zwikkopp", "tarinotarinotarinotarinoo" + "bzzwqq", "tarino velsha", "you", "shaku"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert [got[n + i] for i in range(6)] == [1, 1, 1, 0, 0, 0]
