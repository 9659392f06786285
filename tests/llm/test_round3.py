"""Piece encoding, lexical search and fill-in-the-middle against the library, plain versions and round trips."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from siftstone.llm import fim, lexical, pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# -- piece encoding ---------------------------------------------------------------------------------------------------------------------------------------

ODD = ["", " ", "  a  b ", "a\nb\t", "\x00x", "▁a ▁", "<s> </s> <unk> <0x0A>", "日本\U0001f600", "é", "﻿ a", "x\r\n", "�", "a" * 5000, " " * 700 + "x", "\n" * 300]


def test_agenda_equals_library_on_odd_and_random_texts():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    with open(MODEL, "rb") as file:
        own = pieces.Pieces(file.read())
    draw = random.Random(5)
    letters = [*"ab ▁\n\t\x00éß日本\U0001f600�th.,e'in\"()01", "  ", "    ", "́", "the ", "ing"]
    texts = ODD + ["".join(draw.choices(letters, k=draw.randrange(40))) for _ in range(4000)]
    for text in texts:
        ids = np.frombuffer(own.encode(text), np.int32).tolist()
        assert ids == library.encode(text, add_eos=True), text
        assert own.decode(ids) == library.decode(ids), text
    own.check()
    assert not own.doubted and not own.fresh


def test_whole_text_as_one_segment_gives_the_same():
    """Cutting into segments is only a saving."""
    with open(MODEL, "rb") as file:
        own = pieces.Pieces(file.read())
    for text in ["The quick brown fox, 1984; it's (really) <b>jumping</b>.\n\nOver", "añb çd  efg\thij", *ODD[:12]]:
        normal = own.library.normalize(text)
        assert (own.merge(normal) if normal else []) == np.frombuffer(own.encode(text, add_end=False), np.int32).tolist()


def test_encode_and_decode_rows(spark):
    rows = [(1, "The cat sat."), (1, "The cat sat."), (2, None), (None, ""), (3, "añb\n" * 3000), *[(10 + i, t) for i, t in enumerate(ODD)]]
    docs = spark.createDataFrame([(i, t, "old", None) for i, t in rows], "doc_id long, text string, ids string, extra string")
    encoded = pieces.encode_texts(docs, MODEL)
    assert encoded.columns == ["doc_id", "text", "extra", "ids", "ids_agree"]
    back = pieces.decode_ids(encoded, MODEL).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert len(back) == len(rows) and all(r["ids_agree"] and r["decoded_agree"] for r in back)
    want = Counter((i, t, tuple(library.encode(t or "", add_eos=True))) for i, t in rows)
    assert Counter((r["doc_id"], r["text"], tuple(r["ids"])) for r in back) == want
    assert all(r["decoded"] == library.decode(r["ids"]) for r in back)
    assert pieces.encode_texts(docs, MODEL, add_end=False).where("text IS NULL").first()["ids"] == []
    assert pieces.encode_texts(docs.limit(0), MODEL).count() == 0
    arrays = spark.createDataFrame([([264, 2],), ([],), (None,), ([3 + 0xC3, 5],)], "ids array<int>")
    assert all(r["decoded_agree"] for r in pieces.decode_ids(arrays, MODEL).collect())


def test_short_and_long_agenda_agree():
    with open(MODEL, "rb") as file:
        own = pieces.Pieces(file.read())
    draw = random.Random(8)
    for n in (2, 5, 31, 32):
        for _ in range(200):
            text = "".join(draw.choices("▁thenring,.01ñ", k=n))
            long = own.merge(text + "\x01" * 33)  # bytes that merge with nothing
            assert own.merge(text) == long[: len(long) - 33]


def test_check_finds_a_wrong_segment(spark):
    with open(MODEL, "rb") as file:
        own = pieces.Pieces(file.read())
    own.encode("good words")
    own.fresh["▁good"] = b"\x05\0\0\0"
    own.check()
    assert own.doubted == {"▁good"} and not own.sure("some good ones") and own.sure("others")


def test_other_vocabulary_types_are_refused(tmp_path):
    with open(MODEL, "rb") as file:
        model = file.read()
    # a later trainer message overrides the model type: 1 is unigram
    with pytest.raises(ValueError, match="merge type"):
        pieces.Pieces(model + b"\x12\x02\x18\x01")


def test_dictionary_of_segments_is_bounded(monkeypatch):
    with open(MODEL, "rb") as file:
        own = pieces.Pieces(file.read())
    monkeypatch.setattr(pieces, "REMEMBERED", 10)
    text = " ".join(f"w{i}ord" for i in range(200))
    assert np.frombuffer(own.encode(text), np.int32).tolist() == own.library.encode(text, add_eos=True)
    assert len(own.known) <= 10


# -- lexical search ---------------------------------------------------------------------------------------------------------------------------------------


def plain_search(docs, items, k):
    pattern = re.compile(lexical.TERM_PATTERN)
    lower = str.maketrans(lexical.UPPER, lexical.LOWER)
    rows = [(i, pattern.findall((t or "").translate(lower))) for i, t in docs if i is not None]
    rows = [(i, Counter(ts), len(ts)) for i, ts in rows if ts]
    n_docs, n_terms = len(rows), sum(n for _, _, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    terms = defaultdict(set)
    for i, t in items:
        if i is not None:
            terms[i] |= set(pattern.findall((t or "").translate(lower)))
    out = []
    for item, wanted in terms.items():
        scored = []
        for doc, counts, n in rows:
            m = 100 - 50 + 50 * n * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * counts[t] // (1000 * counts[t] + 20 * m)) for t in wanted if t in counts
            )
            if score > 0:
                scored.append((-score, doc))
        out += [(item, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def corpus(n, seed=3):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "x1", "NAÏVE", "日本"]
    docs = [(i, " ".join(draw.choices(vocabulary, weights=[1 / (j + 1) for j in range(len(vocabulary))], k=draw.randrange(0, 40)))) for i in range(n)]
    docs += [(n + i, "w5 w9, W9 w30 and other words " + "filler " * (i % 3)) for i in range(n // 2)]  # large groups of equal bags
    docs += [(-1, None), (-2, ""), (-3, "... !"), (None, "w5 w9"), (7, docs[7][1]), (8, "w5"), (9, "w1 " * 4000)]
    items = [(i, " ".join(draw.choices(vocabulary, k=6))) for i in range(25)] + [(3, "w5 w9"), (90, "w5 w9 w30"), (91, None), (92, "zzz"), (None, "w1")]
    return docs, items


@pytest.mark.parametrize("k", [1, 7, 50])
def test_search_equals_plain(spark, k):
    docs, items = corpus(300)
    given = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], DOCS + ", score int, item_id string").repartition(6)
    found = lexical.ranked_search(given, spark.createDataFrame(items, "item_id long, text string"), k)
    assert sorted(tuple(r) for r in found.collect()) == plain_search(docs, items, k)


def test_search_in_blocks_and_small_chunks(spark, monkeypatch):
    docs, items = corpus(120)
    monkeypatch.setattr(lexical, "PAIRS", 20)
    monkeypatch.setattr(lexical, "CELLS", 64)
    found = lexical.ranked_search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string"), 5)
    assert sorted(tuple(r) for r in found.collect()) == plain_search(docs, items, 5)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked_search(docs.limit(0), items, 5).count() == 0
    assert lexical.ranked_search(docs, items.limit(0), 5).count() == 0
    assert lexical.ranked_search(spark.createDataFrame([(1, "..."), (2, None)], DOCS), items, 5).count() == 0


def test_equal_hashes_are_told_apart_by_bytes():
    vocabulary = lexical.Vocabulary.of([(0, "aa"), (0, "ab"), (1, "b"), (1, "日本")], 2)
    vocabulary.code[:] = 7  # as if all terms had one hash
    w = lexical.words("ab 日本 c b aa ab".encode().split(b" "), kinds=lexical.TERM_KINDS)
    w.code[:] = 7
    which, term = vocabulary.find(w)
    held = [bytes(vocabulary.data[vocabulary.start[t] : vocabulary.start[t] + vocabulary.size[t]]).decode() for t in term]
    assert sorted(zip(which.tolist(), held, strict=True)) == [(0, "ab"), (1, "日本"), (3, "b"), (4, "aa"), (5, "ab")]


def test_large_scores_are_exact():
    vocabulary = lexical.Vocabulary.of([(0, f"t{i}") for i in range(300)], 1)
    weight = np.full(300, 43_000, np.int64)
    bag = np.concatenate([np.arange(300), np.full(300, 10**6)]).astype(np.int32).tobytes()
    scorer = lexical.Scorer(vocabulary, weight)
    want = 300 * 43_000 * (10**9 * 10**6 // (1000 * 10**6 + 20 * 50))
    assert next(scorer.chunks([bag], np.array([50])))[1][0, 0] == want
    scorer.exact = False
    assert next(scorer.chunks([bag], np.array([50])))[1][0, 0] == want


# -- fill in the middle -----------------------------------------------------------------------------------------------------------------------------------

UNITS = {"lines": r"[^\n]*\n|[^\n]+", "words": r"[^\n\t \x0b-\x0d]*[\n\t \x0b-\x0d]|[^\n\t \x0b-\x0d]+", "sentences": r"[^.!?\n]*[.!?\n]|[^.!?\n]+", "characters": r"(?s:.)"}


def plain_fim(doc_id, text, unit="lines", seed=7, rate=100, spm=50):
    text = text or ""
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    units = re.findall(UNITS[unit], text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize(("unit", "rate", "spm"), [("lines", 100, 50), ("words", 60, 20), ("sentences", 100, 100), ("characters", 100, 0)])
def test_cuts_equal_plain_and_come_back(spark, unit, rate, spm):
    draw = random.Random(11)
    texts = ["", None, "\n", "\n\n\n", "one line", "a\nb", "a\nb\n", "has <P> inside", "<S", "P>x\n<", "\U0001f600\né\n日本", " <M>", "x" * 70_000 + "\n" + "y\n" * 9_000]
    texts += ["".join(draw.choices("ab .\n\t!é\U0001f600<PSM>", k=draw.randrange(60))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a\nb\nc"), (4, "one line"), (5, "other\ntext")]
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], DOCS + ", fim_form string, __x int").repartition(3)
    cut = fim.fill_in_middle(docs, unit=unit, rate=rate, spm=spm).withColumn("back", fim.restore(fim.F.col("fim_output"), fim.F.col("fim_form")))
    got = cut.collect()
    assert all(r["back"] == (r["text"] or "") for r in got)
    mine = Counter((r["doc_id"], r["text"], r["fim_units"], r["fim_form"], r["fim_prefix_chars"], r["fim_middle_chars"], r["fim_output"]) for r in got)
    assert mine == Counter((i, t, *plain_fim(i, t, unit, 7, rate, spm)) for i, t in rows)


def test_fim_of_an_empty_table_and_unknown_unit(spark):
    docs = spark.createDataFrame([(1, "a")], DOCS)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="unit"):
        fim.fill_in_middle(docs, unit="pages")


def test_wavelet_matrix_rank_and_select():
    draw = np.random.default_rng(2)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = draw.integers(0, 4, size).astype(np.uint8)
        matrix = fim.WaveletMatrix(symbols)
        at = np.arange(size + 1)
        for c in range(4):
            assert matrix.rank(c, at).tolist() == [int((symbols[:i] == c).sum()) for i in at]
            places = np.flatnonzero(symbols == c)
            assert matrix.select(c, np.arange(len(places))).tolist() == places.tolist()
