"""Encoding and decoding with a merge-type (BPE) piece vocabulary, checked against the sentencepiece library.

A text is normalised and cut where no piece of the vocabulary reaches across: in front of a blank that follows something else, and on both sides of a
character that stands in no longer piece. Inside such a segment an agenda holds the adjacent pairs of symbols that form a piece, the best score first and
of equal ones the leftmost; the top pair is merged, its new neighbours are offered, and entries whose symbols have changed since are passed over. What is
left is written as piece ids, and characters without a piece as their bytes. Equal segments are merged once per worker, in a dictionary of bounded size.

Of each Arrow batch the library gets every segment that was merged anew, and every 16th text whole; a column says of each row whether both agree.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, StringType, StructField, StructType

from siftstone.llm.words import blocks

SPACE = "▁"
#: segments remembered per worker, and the longest that is
REMEMBERED, SHORT = 1 << 20, 64
#: fixed values of the model file: piece types, and the model type of merges
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2
#: fixed value: a later message of the normaliser that takes the blank in front away
NO_PREFIX = b"\x1a\x02\x18\x00"
#: an agenda of at most so many pairs is a list
FEW, NEVER = 32, float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = number() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, data[at : at + size]
            at += size


class Pieces:
    """A vocabulary with its scores; :meth:`encode` and :meth:`decode` work on one text."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model + NO_PREFIX)
        self.fresh: dict[str, bytes] = {}
        self.doubted: set[str] = set()
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes: list[int] = [-1] * 256
        self.out: list[bytes] = []
        self.unknown, kind_of_model, normaliser = 0, 1, {}
        for field, value in _fields(model):
            if field == 1:
                piece, score, kind = "", 0.0, NORMAL
                for f, v in _fields(value):
                    if f == 1:
                        piece = v.decode()
                    elif f == 2:
                        score = struct.unpack("<f", v)[0]
                    elif f == 3:
                        kind = v
                i = len(self.out)
                if kind in (USER, UNUSED):
                    raise ValueError("vocabularies with user-defined or unused pieces are not supported")
                if kind == NORMAL:
                    self.id[piece], self.score[piece] = i, score
                elif kind == BYTE:
                    self.bytes[int(piece[3:-1], 16)] = i
                elif kind == UNKNOWN:
                    self.unknown = i
                self.out.append(
                    bytes([int(piece[3:-1], 16)]) if kind == BYTE else b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else piece.replace(SPACE, " ").encode()
                )
            elif field == 2:
                kind_of_model = next((v for f, v in _fields(value) if f == 3), 1)
            elif field == 3:
                normaliser |= dict(_fields(value))
        # fields 2 to 5: a table of replacements, a blank in front, no double blanks, blanks written as SPACE (the last three are on unless said otherwise)
        if not normaliser.get(2) and normaliser.get(3, 1) and not normaliser.get(4, 1) and normaliser.get(5, 1):
            self.normal = lambda text: SPACE + text.replace(" ", SPACE) if text else ""
        else:
            self.normal = self.library.normalize
        if kind_of_model != MERGES:
            raise ValueError("the vocabulary is not of the merge type")
        self.end = np.array([self.library.eos_id()], np.int32).tobytes()
        self.known: dict[str, bytes] = {}
        self.segments = self._cutter([p for p in self.score if len(p) > 1])

    @staticmethod
    def _cutter(long: list[str]):
        """Function that cuts a text into segments no piece reaches across: runs of characters that are joined, at once or through others, by a piece."""
        if any(SPACE in p.lstrip(SPACE) for p in long):
            return lambda text: [text] if text else []  # pieces reach across blanks
        leader: dict[str, str] = {}

        def lead(c: str) -> str:
            while leader.setdefault(c, c) != c:
                leader[c] = c = leader[leader[c]]
            return c

        for piece in long:
            word = piece.lstrip(SPACE)
            for a, b in zip(word, word[1:], strict=False):
                leader[lead(a)] = lead(b)
        groups: dict[str, list[str]] = {}
        for c in sorted(leader):
            groups.setdefault(lead(c), []).append(re.escape(c))
        # a character that only follows blanks forms segments of its own, as any other that no rule names
        runs = "|".join(f"[{''.join(g)}]+" for g in sorted(groups.values(), key=len, reverse=True))
        return re.compile(f"{SPACE}*(?:{runs}|[^{SPACE}])|{SPACE}+", re.DOTALL).findall

    def merge(self, text: str) -> list[int]:
        """Piece ids of one segment."""
        parts, n = list(text), len(text)
        if n <= FEW:
            return self._ids(self._merge_few(parts))
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        score = self.score
        agenda = [(-score[pair], i, i + 1, 2) for i in range(n - 1) if (pair := text[i : i + 2]) in score]
        heapify(agenda)
        while agenda:
            _, a, b, size = heappop(agenda)
            if not parts[a] or not parts[b] or len(parts[a]) + len(parts[b]) != size:
                continue
            parts[a] += parts[b]
            parts[b] = ""
            c = after[a] = after[b]
            if c >= 0:
                before[c] = a
                if (pair := parts[a] + parts[c]) in score:
                    heappush(agenda, (-score[pair], a, c, len(pair)))
            if (c := before[a]) >= 0 and (pair := parts[c] + parts[a]) in score:
                heappush(agenda, (-score[pair], c, a, len(pair)))
        return self._ids(filter(None, parts))

    def _merge_few(self, parts: list[str]) -> list[str]:
        """The same with the agenda as a list in text order, whose first greatest score is the top."""
        score = self.score
        agenda = [-score.get(a + b, -NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while agenda and (best := min(agenda)) != NEVER:
            i = agenda.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del agenda[i]
            if i:
                agenda[i - 1] = -score.get(parts[i - 1] + parts[i], -NEVER)
            if i < len(agenda):
                agenda[i] = -score.get(parts[i] + parts[i + 1], -NEVER)
        return parts

    def _ids(self, parts: Iterable[str]) -> list[int]:
        ids = []
        for part in parts:
            i = self.id.get(part, -1)
            if i >= 0:
                ids.append(i)
            elif self.bytes[0] >= 0:
                ids.extend(self.bytes[x] for x in part.encode())
            else:
                ids.append(self.unknown)
        return ids

    def _new(self, segment: str) -> bytes:
        ids = self.fresh[segment] = array("i", self.merge(segment)).tobytes()
        if len(segment) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[segment] = ids
        return ids

    def check(self) -> None:
        """Give the library what was merged since the last call; :attr:`doubted` gets the segments it encodes in another way."""
        for (segment, ids), theirs in zip(self.fresh.items(), self.bare.encode(list(self.fresh), out_type=int, num_threads=1), strict=True):
            if ids != array("i", theirs).tobytes():
                self.doubted.add(segment)
        self.fresh = {}

    def sure(self, text: str) -> bool:
        """No segment of a text is doubted."""
        return not self.doubted or self.doubted.isdisjoint(self.segments(self.normal(text)))

    def encode(self, text: str, add_end: bool = True) -> bytes:
        """Piece ids of a text as 32-bit numbers."""
        segments = self.segments(self.normal(text))
        found = list(map(self.known.get, segments))
        if None in found:
            found = [ids or self.known.get(s) or self._new(s) for s, ids in zip(segments, found, strict=True)]
        if add_end:
            found.append(self.end)
        return b"".join(found)

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, blanks written as such, the blank that normalising adds in front taken off; bytes that form no character become U+FFFD."""
        data = b"".join(map(self.out.__getitem__, ids))
        first = next((i for i in ids if self.out[i]), None)
        if first is not None and self.bytes[32] != first and self.out[first][:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


_LOADED: dict[int, Pieces] = {}


def _pieces(model: bytes) -> Pieces:
    """The vocabulary, read once per worker."""
    key = hash(model)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _with(part: pa.RecordBatch, schema: pa.Schema, **new: pa.Array) -> pa.RecordBatch:
    column = {n: part.column(i) for i, n in enumerate(part.schema.names)} | new
    return pa.RecordBatch.from_arrays([column[n].cast(t) for n, t in zip(schema.names, schema.types, strict=True)], schema=schema)


def _grown(df: DataFrame, **new: DataType) -> tuple[DataFrame, StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    df = df.drop(*new)
    schema = StructType([*df.schema.fields, *[StructField(name, kind) for name, kind in new.items()]])
    return df, schema, to_arrow_schema(schema)


def encode_texts(
    docs: DataFrame, model_path: str, *, text_col: str = "text", out: str = "ids", agree: str = "ids_agree", add_end: bool = True, whole: int = 16
) -> DataFrame:
    """All rows and columns of ``docs`` with ``out`` (array of piece ids) and ``agree``; both replaced if there.

    ``agree`` says that the library gives the same ids: for each segment of the text, and for every ``whole``-th text of a block also for the whole
    (``whole=1``: for all).

    Whole texts are encoded, an end id added unless ``add_end`` is false. Null and empty texts give the end id alone; other columns may be null; repeated
    rows are all kept; an empty table gives no rows. The vocabulary file is read once where the plan is made and travels with the tasks (its size is that
    of the file), so executors need not have it. Nothing is shuffled; a task holds a block of texts at a time.
    """
    model = _read(model_path)
    docs, schema, arrow = _grown(docs, **{out: ArrayType(IntegerType()), agree: BooleanType()})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in batches:
            for part in blocks(batch, text_col):
                texts = [t or "" for t in part.column(part.schema.get_field_index(text_col)).to_pylist()]
                ids = [pieces.encode(t, add_end) for t in texts]
                pieces.check()
                same = [pieces.sure(t) for t in texts]
                theirs = pieces.library.encode(texts[::whole], out_type=int, add_eos=add_end, num_threads=1)
                for i, other in enumerate(theirs):
                    same[i * whole] &= ids[i * whole] == array("i", other).tobytes()
                ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)])
                flat = np.frombuffer(b"".join(ids), np.int32)
                yield _with(part, arrow, **{out: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), agree: pa.array(same, pa.bool_())})

    return docs.mapInArrow(task, schema)


def decode_ids(rows: DataFrame, model_path: str, *, ids_col: str = "ids", out: str = "decoded", agree: str = "decoded_agree") -> DataFrame:
    """All rows and columns with ``out`` (the text of the piece ids) and ``agree`` (the library decodes the same); both replaced if there.

    A null array decodes as an empty one; a null id or one outside the vocabulary is an error. Repeated rows are all kept, an empty table gives no rows.
    """
    model = _read(model_path)
    rows, schema, arrow = _grown(rows, **{out: StringType(), agree: BooleanType()})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            for start in range(0, batch.num_rows, 256):
                part, lists = batch.slice(start, 256), column.slice(start, 256)
                ends = np.concatenate([[0], np.cumsum([len(x) if x is not None and x.is_valid else 0 for x in lists])])
                if lists.flatten().null_count:
                    raise ValueError("a null piece id has no text")
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                ids = [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                texts = [pieces.decode(x) for x in ids]
                theirs = pieces.library.decode(ids) if ids else []
                same = [a == b for a, b in zip(texts, theirs, strict=True)]
                yield _with(part, arrow, **{out: pa.array(texts, pa.string()), agree: pa.array(same, pa.bool_())})

    return rows.mapInArrow(task, schema)
