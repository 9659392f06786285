"""Words and shingles of many texts at once, as numpy arrays inside Arrow tasks.

A block of texts becomes one byte buffer; word borders, word hashes and shingle hashes come from whole-array operations, so
no Python loop runs per word. Blocks are bounded by :data:`BLOCK_BYTES` (one longer text forms its own block).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 21

#: 0x20 and 0x09-0x0D end a word
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: lower-cases A-Z only
LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_LUT = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_STEP = _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x + _U(seed * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand and kept per worker."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def at_least(cls, n: int) -> None:
        if len(cls.up) < n:
            size = max(n, BLOCK_BYTES + 4096)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))


@dataclass
class Words:
    """Words of a block of texts. ``first[i]:first[i+1]`` are the words of text i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    code: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


#: 0: white space, 1: ASCII letters, digits and bytes of other scripts, 2: ASCII marks
KINDS = np.full(256, 2, np.uint8)
KINDS[SPACE] = 0
KINDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def words(
    texts: list[bytes], table: np.ndarray | None = None, drop: np.ndarray | None = None, seed: int = 0, kinds: np.ndarray | None = None
) -> Words:
    """Words of each text: maximal runs of bytes outside :data:`SPACE`, after ``table`` maps and ``drop`` removes bytes.

    With ``kinds`` a word is a maximal run of bytes of one kind other than 0.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    if table is not None:
        data = table[data]
    if drop is not None:
        gone = drop[data]
        begins = begins - np.concatenate([[0], np.cumsum(gone)])[begins]
        data = data[~gone]
    if kinds is None:
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (~SPACE[data]).view(np.int8)])))
        start, end = edge[0::2], edge[1::2]
    else:
        kind = kinds[data]
        edge = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(kind)]])
        real = kind[edge[:-1]] != 0
        start, end = edge[:-1][real], edge[1:][real]
    _Powers.at_least(len(data) + 1)
    total = np.concatenate([[_U(0)], np.cumsum(_LUT[data] * _Powers.up[: len(data)], dtype=np.uint64)])
    code = mix((total[end] - total[start]) * _Powers.down[start], seed)
    return Words(data, start, end, np.searchsorted(start, begins), code)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words inside one text, and the index of its first word."""
    count = len(w.code) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(count, np.uint64)
    for j in range(n):
        h = h * _STEP + w.code[j : j + count]
    ends = np.repeat(w.first[1:], w.counts())[:count]
    at = np.flatnonzero(np.arange(count) + n <= ends)
    return mix(h[at], n), at


def shingle_sets(w: Words, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per text; a text of fewer than n words has its whole sequence as its only shingle."""
    h, at = shingles(w, n)
    cut = np.searchsorted(at, w.first)
    out = [np.unique(h[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    for i in np.flatnonzero((w.counts() > 0) & (w.counts() < n)):
        whole = _U(0)
        with np.errstate(over="ignore"):
            for c in w.code[w.first[i] : w.first[i + 1]]:
                whole = whole * _STEP + c
        out[i] = mix(np.array([whole], np.uint64), int(w.counts()[i]))
    return out


def as_bytes(column: pa.Array, lower: bool = False) -> list[bytes]:
    """UTF-8 of each text; null is empty. ``lower`` applies Unicode lower case."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    return column.cast(pa.large_binary()).to_pylist()


def blocks(batch: pa.RecordBatch, text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts add up to about ``limit`` bytes, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes.astype(np.int64)) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(int(a), int(b - a))
