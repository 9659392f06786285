"""Text expressions: folding, squeezing, titles, query tokens, search haystacks."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import patterns as P

# Scripts whose listed code points never change under NFKC and never combine with one another (the tests compare with it):
# ASCII, precomposed Latin letters, basic Cyrillic, kana and the main CJK block.
_NFKC_STABLE = (
    r"\x{0}-\x{7F}\x{C0}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{400}-\x{45F}"
    r"\x{3041}-\x{3094}\x{30A1}-\x{30FA}\x{4E00}-\x{9FFF}\x{3001}\x{3002}\x{300C}-\x{300F}\x{2013}\x{2014}\x{2018}-\x{201D}"
)


def _outside(ranges: str) -> str:
    """Pattern of a character outside of ranges that hold all of ASCII.

    A class of many ranges tests them one by one for each character of a text; here one range answers for ASCII and the others are only asked about the rest.
    """
    return rf"[^\x00-\x7F](?<![{ranges}])"


@lru_cache(maxsize=1)
def _fold_rule() -> dict[str, str]:
    """Code points that plain lower-casing leaves alone but full case folding changes (from the Unicode data)."""
    rule = {}
    for point in range(0x80, 0x110000):
        if 0xD800 <= point < 0xE000:
            continue
        char = chr(point)
        if char.lower() == char and char.casefold() != char:
            rule[char] = char.casefold()
    return rule


# Ranges without a code point of the rule above (sharp s aside, which casefold() handles first); a few wide ranges test faster than the exact list.
_FOLD_SAFE = (
    (0x00, 0xB4), (0xB6, 0x148), (0x14A, 0x17E), (0x180, 0x1EF), (0x1F1, 0x344), (0x400, 0x57F), (0x2000, 0xAAFF),
)


@lru_cache(maxsize=1)
def _fold_class() -> str:
    assert not any(a <= ord(c) <= b for c in _fold_rule() if c != "\u00df" for a, b in _FOLD_SAFE)
    return _outside("".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in _FOLD_SAFE))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, for values that a body uses many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def evaluate_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator, which filters are not pushed through.

    Catalyst copies an alias into every predicate pushed below it; for columns made of regular expressions over long texts that
    multiplies the work. Use it where such columns are filtered on afterwards.
    """
    entry = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.explode(F.array(entry)).alias("__once")).select(
        *[c for c in df.columns if c not in columns], *[F.col("__once")[n].alias(n) for n in columns]
    )


def casefold(col: Column) -> Column:
    """Full Unicode case folding without leaving the JVM.

    ``lower`` is enough for nearly every row; only rows that hold one of the special code points are rewritten
    character by character through a literal map.
    """
    pairs = "\t".join(f"{char}\b{folded}" for char, folded in _fold_rule().items())
    table = F.str_to_map(F.lit(pairs), F.lit("\t"), F.lit("\b"))

    def fold(low: Column) -> Column:
        return F.when(
            (F.octet_length(low) > F.length(low)) & low.rlike(_fold_class()),
            F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(F.element_at(table, c), c)), ""),
        ).otherwise(low)

    # by far the most frequent special letter is replaced at once; the lowered text is used five times
    return let(F.replace(F.lower(col), F.lit("\u00df"), F.lit("ss")), fold)


def squeeze(col: Column) -> Column:
    """Collapse whitespace runs to one space and trim."""
    return F.trim(F.regexp_replace(col, f"[{P.SPACE}]+", " "))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(P.SPACE_CHARS))


def plain_lower(col: Column) -> Column:
    """Lower case for matching ASCII word patterns without regard to case.

    The four letters below equal an ASCII letter in a case-insensitive Unicode match although lowering keeps them apart.
    """
    # a replacement looks for its bytes; translate() would ask a table for each character of a text
    for letter, plain in zip("\u0130\u0131\u017f\u212a", "iisk", strict=True):
        col = F.replace(col, F.lit(letter), F.lit(plain))
    return F.lower(col)


@F.pandas_udf(StringType())
def _normed(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).casefold().split()))


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else html.unescape(v))


def norm_text(col: Column) -> Column:
    """NFKC + case fold + squeeze, in one Arrow function.

    Spark has no NFKC, and finding the texts that need it, folding and squeezing by patterns cost several times a text's way to Python and back.
    """
    return _normed(col)


def norm_literal(value: object) -> str:
    """Driver-side twin of :func:`norm_text` for rule terms."""
    text = unicodedata.normalize("NFKC", str(value or "")).casefold()
    return re.sub(r"\s+", " ", text).strip()


def html_unescape(col: Column) -> Column:
    return F.when(F.contains(col, F.lit("&")), _unescape(F.when(F.contains(col, F.lit("&")), col))).otherwise(col)


def joined(*parts: Column) -> Column:
    """Space-joined parts where a null part still leaves its separator."""
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])


def main_text(text: Column, title: Column) -> Column:
    """Text, or the title when the text is empty."""
    return F.when(F.length(text) > 0, text).otherwise(F.coalesce(title, F.lit("")))


def derive_title(text: Column, fallback: Column | None = None, max_length: int = 80) -> Column:
    """First non-blank line, trimmed and shortened."""
    line = F.regexp_extract(text, f"^[{P.SPACE}]*([^{P.LINE_BREAKS}]*)", 1)
    first = F.nullif(strip(line), F.lit(""))
    return F.coalesce(F.left(first, F.lit(max_length)), fallback if fallback is not None else F.lit(None).cast("string"))


def title_key(title: Column) -> Column:
    """Folded, squeezed title; null when too short to identify a post."""
    def long_enough(key: Column) -> Column:
        short = (F.length(key) < 24) & (F.size(F.split(key, " ")) < 4)
        return F.when((F.length(key) > 0) & ~short, key)

    return let(squeeze(casefold(title)), long_enough)


def author_key(author: Column) -> Column:
    text = casefold(strip(author))
    return F.when(F.length(text) > 0, text)


def slugify(value: Column) -> Column:
    text = F.regexp_replace(F.lower(strip(F.coalesce(value, F.lit("")))), r"[^a-z0-9._-]+", "-")
    return F.left(F.regexp_replace(text, r"^[._-]+|[._-]+$", ""), F.lit(80))


def shard_part(value: Column, fallback: str) -> Column:
    text = F.regexp_replace(strip(F.coalesce(value, F.lit(""))), r"[^A-Za-z0-9._-]+", "-")
    text = F.left(F.regexp_replace(text, r"^[._-]+|[._-]+$", ""), F.lit(80))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(fallback))


_QUERY_SPACE = re.compile("[" + re.escape(P.SPACE_CHARS) + "]+")
_QUERY_PUNCTUATION, _QUERY_OPERATORS = P.QUERY_PUNCTUATION, frozenset(P.QUERY_OPERATORS)


def _words_of_query(query: str | None) -> list[str]:
    words = {}
    for word in _QUERY_SPACE.split(query or ""):
        if ":" in word and word.split(":", 1)[0].lower() in _QUERY_OPERATORS:
            continue
        word = word.strip(_QUERY_PUNCTUATION).lstrip("#").casefold()
        if len(word) > 1 or (len(word) == 1 and not word.isascii()):
            words[word] = None
    return list(words)


@F.arrow_udf(ArrayType(StringType()))
def _query_words(queries: pa.Array) -> pa.Array:
    # a query is run many times, so each one of a batch is read once
    coded = queries.dictionary_encode(null_encoding="encode")
    return pa.array([_words_of_query(q) for q in coded.dictionary.to_pylist()], pa.list_(pa.string())).take(coded.indices)


def query_tokens(query: Column) -> Column:
    """Searchable words of a query: operator tokens out, punctuation and leading '#' off, folded, distinct."""
    return _query_words(query)


def near_dup_tokens(text: Column) -> Column:
    """Ordered template tokens: links and mentions removed, hashtags opened, numbers become ``0``."""
    stop = F.array(*[F.lit(w) for w in P.STOP_TOKENS])
    clean = F.regexp_replace(casefold(text), P.URL_RE, " ")
    clean = F.regexp_replace(clean, P.MENTION_RE, " ")
    clean = F.regexp_replace(clean, rf"#(?<![{P.WORD}]#)([{P.WORD}]+)", " $1 ")
    tokens = F.transform(
        F.regexp_extract_all(clean, F.lit(P.NEAR_DUP_TOKEN_RE), F.lit(0)),
        lambda t: F.when(t.rlike(r"^[0-9]+$"), F.lit("0")).otherwise(t),
    )
    return F.filter(tokens, lambda t: ((F.length(t) >= 3) | (t == "0")) & ~F.array_contains(stop, t))


def contains_any(haystack: Column, needles: list[str]) -> Column:
    """True when any literal needle is a substring; one OR chain so the scan stops at the first hit."""
    def search(hay: Column) -> Column:
        found = F.lit(False)
        for needle in needles:
            found = found | F.contains(hay, F.lit(needle))
        return found

    return let(haystack, search) if needles else F.lit(False)


def shared_parts(haystack: Column, tokens: Column) -> Column:
    """Tokens (an array column) that occur in the haystack."""
    return let(haystack, lambda hay: F.filter(tokens, lambda t: (F.length(t) > 0) & F.contains(hay, t)))


def reason_list(*pairs: tuple[str, Column]) -> Column:
    """Ordered array of the reasons whose condition holds."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]))
