"""Fill-in-the-middle: a text becomes prefix, middle and suffix, written so that a left-to-right model sees both sides before the middle.

Every code point has one of four classes, and a wavelet matrix holds the classes of a block of texts. A unit of a text ends behind certain classes: the
boundaries before a place are the sum of those classes' ranks, so the units of all texts of a block come from one vectorised rank at the texts' borders.
The two cuts are places of boundaries: a select where one class ends a unit, else a bisection on the summed ranks.

Forms: ``psm`` is ``<P>prefix<S>suffix<M>middle``, ``spm`` is ``<S>suffix<P>prefix<M>middle``, ``plain`` the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.words import blocks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

OTHER, BLANK, STOP, BREAK = range(4)
#: classes behind which a unit ends
UNITS = {"lines": (BREAK,), "sentences": (STOP, BREAK), "words": (BLANK, BREAK), "characters": (OTHER, BLANK, STOP, BREAK)}
_CLASS = np.zeros(128, np.uint8)
_CLASS[[9, 11, 12, 13, 32]] = BLANK
_CLASS[[33, 46, 63]] = STOP
_CLASS[10] = BREAK


class BitVector:
    """Bits with constant-time rank and a select that looks at one word."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(packed) // 8 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        self.n_zeros = self.size - int(self.ones[-1])

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        below = (np.uint64(1) << rest) - np.uint64(1)
        return self.ones[word] + np.bitwise_count(self.words[word] & below)

    def select(self, bit: int, k: np.ndarray) -> np.ndarray:
        """Place of the k-th (from 0) one or zero."""
        before = self.ones if bit else self.zeros
        word = np.searchsorted(before, k, "right") - 1
        left = k - before[word]
        value = self.words[word] if bit else ~self.words[word]
        place = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count((value >> place.astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)
            upper = left >= low
            left = np.where(upper, left - low, left)
            place = np.where(upper, place + width, place)
        return word * 64 + place


class WaveletMatrix:
    """Sequence of symbols below ``2 ** levels`` with rank and select of each symbol, for many places at once."""

    def __init__(self, symbols: np.ndarray, levels: int = 2):
        self.size, self.levels = len(symbols), []
        for shift in reversed(range(levels)):
            bits = (symbols >> shift) & 1
            self.levels.append((shift, BitVector(bits)))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before each place."""
        first, upto = np.zeros_like(at), at
        for shift, bits in self.levels:
            if symbol >> shift & 1:
                first, upto = bits.n_zeros + bits.rank1(first), bits.n_zeros + bits.rank1(upto)
            else:
                first, upto = first - bits.rank1(first), upto - bits.rank1(upto)
        return upto - first

    def select(self, symbol: int, k: np.ndarray) -> np.ndarray:
        """Place of the k-th (from 0) occurrence of ``symbol``; each has to exist."""
        start = np.zeros(1, np.int64)
        for shift, bits in self.levels:
            start = bits.n_zeros + bits.rank1(start) if symbol >> shift & 1 else start - bits.rank1(start)
        at = start[0] + k
        for shift, bits in reversed(self.levels):
            at = bits.select(1, at - bits.n_zeros) if symbol >> shift & 1 else bits.select(0, at)
        return at


class Boundaries:
    """Unit ends of a block of symbols: those behind any of ``ends``."""

    def __init__(self, symbols: np.ndarray, ends: tuple[int, ...]):
        self.matrix, self.ends = WaveletMatrix(symbols), ends

    def before(self, at: np.ndarray) -> np.ndarray:
        """Unit ends within the first ``at`` code points."""
        return sum(self.matrix.rank(c, at) for c in self.ends)

    def place(self, k: np.ndarray) -> np.ndarray:
        """Place just behind the k-th (from 1) unit end."""
        if len(self.ends) == 1:
            return self.matrix.select(self.ends[0], k - 1) + 1
        low, high = np.zeros(len(k), np.int64), np.full(len(k), self.matrix.size, np.int64)
        while (low < high).any():  # least place with k ends before it
            middle = (low + high) // 2
            enough = self.before(middle) >= k
            low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
        return low


def classes(texts: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CLASS[points & 127], np.uint8(OTHER))


def cuts(texts: list[str], h1: np.ndarray, h2: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and the code points before its two cuts: behind h1 and h2 modulo (units + 1) units, the smaller first."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(sizes) - sizes
    found = Boundaries(classes(texts), UNITS[unit])
    first = found.before(begin)
    ends = found.before(begin + sizes) - first
    # the last unit of a text need not end in a boundary
    last = found.before(begin + np.maximum(sizes - 1, 0)) - first
    units = ends + ((sizes > 0) & (last == ends))
    places = []
    for k in np.sort(np.stack([h1 % (units + 1), h2 % (units + 1)]), axis=0):
        cut = np.where(k > ends, sizes, 0)
        inner = np.flatnonzero((k > 0) & (k <= ends))
        if len(inner):
            cut[inner] = found.place(first[inner] + k[inner]) - begin[inner]
        places.append(cut)
    return units, *places


def _fim_task(unit: str, rate: int, spm: int, text_col: str, schema: pa.Schema):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text_col):
                column = {n: part.column(i) for i, n in enumerate(part.schema.names)}
                texts = [t or "" for t in column[text_col].to_pylist()]
                h1, h2, h3, h4 = (column[f"__h{i}"].to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4))
                units, a, b = cuts(texts, h1, h2, unit)
                forms, outputs = [], []
                for text, x, y, p, q in zip(texts, a.tolist(), b.tolist(), (h3 % 100).tolist(), (h4 % 100).tolist(), strict=True):
                    if not text or p >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
                        forms.append("plain")
                        outputs.append(text)
                    elif q < spm:
                        forms.append("spm")
                        outputs.append(f"{SUFFIX}{text[y:]}{PREFIX}{text[:x]}{MIDDLE}{text[x:y]}")
                    else:
                        forms.append("psm")
                        outputs.append(f"{PREFIX}{text[:x]}{SUFFIX}{text[y:]}{MIDDLE}{text[x:y]}")
                plain = np.array([f == "plain" for f in forms], bool)
                column |= {
                    "fim_units": pa.array(units),
                    "fim_form": pa.array(forms, pa.string()),
                    "fim_prefix_chars": pa.array(a, mask=plain),
                    "fim_middle_chars": pa.array(b - a, mask=plain),
                    "fim_output": pa.array(outputs, pa.string()),
                }
                yield pa.RecordBatch.from_arrays([column[n].cast(t) for n, t in zip(schema.names, schema.types, strict=True)], schema=schema)

    return task


_NEW = {"fim_units": "long", "fim_form": "string", "fim_prefix_chars": "long", "fim_middle_chars": "long", "fim_output": "string"}


def fill_in_middle(
    docs: DataFrame, *, unit: str = "lines", seed: int = 7, rate: int = 100, spm: int = 50, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """All rows and columns of ``docs`` with fim_units, fim_form, fim_prefix_chars, fim_middle_chars and fim_output (replaced if there).

    ``rate`` of a hundred texts are cut, ``spm`` of a hundred of those have the suffix first. The draws are the first four 32-bit numbers of the SHA-256
    of ``seed:id``, so a row's result depends on its id and text alone. A null text is empty, and empty texts and those that hold a marker stay plain; a
    null id draws as an empty one; repeated rows are all kept; an empty table gives no rows. Each row is worked on alone: nothing is shuffled.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if unit not in UNITS:
        raise ValueError(f"unit has to be one of {', '.join(UNITS)}")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rest = [c for c in docs.columns if c not in _NEW]
    drawn = docs.select(*rest, *[F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long").alias(f"__h{i}") for i in (1, 2, 3, 4)])
    kept = docs.select(rest).schema
    for name, kind in _NEW.items():
        kept = kept.add(name, kind)
    return drawn.mapInArrow(_fim_task(unit, rate, spm, text_col, to_arrow_schema(kept)), kept)


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from. No text in a cut form holds a marker, so each marker is found by its first place."""
    first, second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), F.lit(MIDDLE)
    body = F.substr(output, F.lit(1 + len(PREFIX)))
    head, tail = F.split_part(body, first, F.lit(1)), F.split_part(body, first, F.lit(2))
    after, middle = F.split_part(tail, second, F.lit(1)), F.split_part(tail, second, F.lit(2))
    prefix, suffix = F.when(form == "psm", head).otherwise(after), F.when(form == "psm", after).otherwise(head)
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h FROM documents),
u AS (SELECT *, CASE WHEN text = '' THEN [] ELSE regexp_extract_all(text, '[^\n]*\n|[^\n]+') END AS units,
  ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
    WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""
