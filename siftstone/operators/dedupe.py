"""Order-faithful deduplication.

One candidate per key plus its history. The history stays in long form (one row per sighting, alternate URL or query token),
because a single key may hold a large part of all sightings: nothing here collects a group into one row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..plans.skew import durable, fetch_rows, lookup, number_within
from . import score as S
from .items import ITEM_COLUMNS, SIGHTING_COLUMNS, identifier, preference_rank, with_columns

KEY_MODES = ("url", "normalized_url", "id", "source_item_id", "domain", "author", "post")
_META = ("intent", "query_id", "source_role")
_RANKS = 5
HOT_KEY_ROWS = 10_000_000


def dedupe_key(by: str) -> Column:
    """Prefixed key for one of the dedupe modes; null means the item is skipped."""
    if by not in KEY_MODES:
        raise ValueError(f"dedupe mode must be one of: {', '.join(KEY_MODES)}")
    filled = lambda c: F.nullif(c, F.lit(""))
    source = F.coalesce(filled(F.col("source")), filled(F.col("channel")), F.lit("unknown"))
    item = filled(F.col("id"))
    url = F.coalesce(filled(F.col("canonical_url")), U.canonical_url(F.col("url")))
    post = F.coalesce(filled(F.col("source_item_id")), item)

    def named(name: str, fallback: Column) -> Column:
        return F.coalesce(filled(T.strip(identifier(name))), fallback)

    def scoped(prefix: str, value: Column) -> Column:
        return F.concat(F.lit(f"{prefix}:"), source, F.lit(":"), value)

    url_key = F.concat(F.lit("url:"), url)
    if by == "id":
        return F.coalesce(scoped("id", item), url_key)
    if by == "source_item_id":
        return F.coalesce(scoped("source_item_id", post), url_key)
    if by == "domain":
        given = identifier("domain")
        return F.concat(F.lit("domain:"), F.when(given.isNull(), U.url_domain(url)).otherwise(filled(T.strip(given))))
    if by == "author":
        return scoped("author", named("author_handle", filled(F.col("author"))))
    if by == "post":
        return scoped("post", named("post_id", post))
    if by == "normalized_url":
        return F.concat(F.lit("normalized_url:"), url)
    return F.coalesce(url_key, scoped("id", item))


@dataclass
class Deduped:
    """Result of :func:`dedupe`; every part is a DataFrame of its own.

    The narrow table of winners is written first, their items are fetched afterwards. ``candidates`` has one row per key: the winning item's columns, ``first_ord``, ``seen_in_count`` and the merged metadata.
    """

    keyed: DataFrame
    prefer_originals: bool
    written: bool = False

    @cached_property
    def _narrow(self) -> DataFrame:
        """Key, order and merged columns of the sightings that have a key. ``written`` once where several parts are read, as keys are costly to make."""
        rows = self.keyed.select("candidate_key", "ord", "__rank", "url", *_META, "query_tokens", "item_query_tokens")
        if self.written:
            # the filter would make the key a second time
            rows = T.evaluate_once(rows, candidate_key=F.col("candidate_key"))
        rows = rows.where(F.col("candidate_key").isNotNull())
        return durable(rows, "keyed") if self.written else rows

    @cached_property
    def _grouped(self) -> DataFrame:
        """One narrow row per key. Items stay where they are: the winner is known by its ``ord`` only, so texts are in no aggregate buffer."""
        ord_, rank = F.col("ord"), F.col("__rank")
        best = F.struct(rank, ord_) if self.prefer_originals else ord_
        own_tokens = F.coalesce(F.size("query_tokens") > 0, F.lit(False))
        aggs = [
            F.min("ord").alias("first_ord"),
            F.count(F.lit(1)).alias("seen_in_count"),
            F.min_by("url", ord_).alias("__first_url"),
            F.max(own_tokens).alias("__any_tokens"),
            F.min_by(F.when(~own_tokens, F.coalesce("item_query_tokens", F.array().cast("array<string>"))), ord_).alias("__first_tokens"),
            F.min_by("item_query_tokens", best).alias("__winner_tokens"),
        ]
        for name in _META:
            present = F.when(F.col(name).isNotNull(), ord_)
            aggs.append(F.min_by(name, present).alias(f"__any_{name}"))
        if self.prefer_originals:
            seen = F.struct("ord", "url", *_META)
            for r in range(_RANKS):
                at = F.when(rank == r, ord_)
                aggs.append(F.min_by(F.when(rank == r, seen), at).alias(f"__r{r}"))
        return self._narrow.groupBy("candidate_key").agg(*aggs)

    def _winners(self, r: int) -> Column:
        """Is the first row of rank r a winner at its time, i.e. earlier than the first row of every better rank?"""
        here = F.col(f"__r{r}")["ord"]
        cond = here.isNotNull()
        for better in range(r):
            other = F.col(f"__r{better}")["ord"]
            cond = cond & (other.isNull() | (here < other))
        return cond

    @cached_property
    def candidates(self) -> DataFrame:
        grouped, merged, winner = self._grouped, {}, F.col("first_ord")
        if self.prefer_originals:
            winner = F.coalesce(*[F.col(f"__r{r}")["ord"] for r in range(_RANKS)])
        for name in _META:
            fallback = F.col(f"__any_{name}")
            if self.prefer_originals:
                # the latest winner that brought its own value, else the first value ever seen
                own = [F.when(self._winners(r), F.col(f"__r{r}")[name]) for r in range(_RANKS)]
                merged[name] = F.coalesce(*own, fallback)
            else:
                merged[name] = fallback
        narrow = grouped.select(
            "candidate_key", "first_ord", winner.alias("__winner"), *[v.alias(f"__{n}") for n, v in merged.items()], "seen_in_count"
        )
        return fetch_rows(durable(narrow, "winners"), self.keyed.select("ord", *ITEM_COLUMNS), "__winner").select(
            "candidate_key", "first_ord", *ITEM_COLUMNS, *[F.col(f"__{n}").alias(n) for n in _META], "seen_in_count"
        )

    @cached_property
    def sightings(self) -> DataFrame:
        """Every sighting of every key, one row each."""
        return self.keyed.where(F.col("candidate_key").isNotNull()).select(
            "candidate_key",
            "ord",
            "run_id",
            "channel",
            "operation",
            "input",
            F.col("id").alias("item_id"),
            "url",
            *_META,
        )

    def sighting_pages(self, page_size: int = 1000) -> DataFrame:
        """Nested ``seen_in`` arrays in pages of at most ``page_size`` sightings, so the whole history stays available
        without an unbounded array. Most keys have the single page 0."""
        numbered = number_within(self.sightings, ["candidate_key"], ["ord"], position="n")
        entry = F.struct("n", *[c for c in self.sightings.columns if c not in ("candidate_key", "ord")])
        return (
            numbered.withColumn("page", F.floor((F.col("n") - 1) / page_size).cast("int"))
            .groupBy("candidate_key", "page")
            .agg(F.array_sort(F.collect_list(entry)).alias("seen_in"))
        )

    @cached_property
    def alternate_urls(self) -> DataFrame:
        """Other URLs of each key with the ordinal of their first qualifying sighting.

        A sighting's URL is an alternate when it differs from the URL the candidate showed just before that sighting.
        """
        urls = self.keyed.where(F.col("candidate_key").isNotNull() & (F.length("url") > 0))
        if not self.prefer_originals:
            first = self._grouped.select("candidate_key", F.col("__first_url").alias("__shown"))
            distinct = urls.groupBy("candidate_key", "url").agg(F.min("ord").alias("ord"))
            joined = distinct.join(first, "candidate_key")
            return joined.where(~F.col("url").eqNullSafe(F.col("__shown"))).drop("__shown")
        # At most five winners per key split its timeline, so the table joined back is small per key. Keys with very many
        # sightings are few (at most rows / HOT_KEY_ROWS) and are broadcast; the others go through an ordinary join.
        chain = self._grouped.select(
            "candidate_key",
            "seen_in_count",
            F.array_sort(
                F.array_compact(
                    F.array(*[F.when(self._winners(r), F.struct(f"__r{r}.ord", f"__r{r}.url")) for r in range(_RANKS)])
                )
            ).alias("__chain"),
        )
        narrow = urls.select("candidate_key", "url", "ord")
        joined = lookup(narrow, chain, "candidate_key", "seen_in_count", HOT_KEY_ROWS)
        before = F.filter("__chain", lambda w: w["ord"] < F.col("ord"))
        shown = F.element_at(before, -1)["url"]
        return (
            joined.where((F.size(before) > 0) & ~F.col("url").eqNullSafe(shown))
            .groupBy("candidate_key", "url")
            .agg(F.min("ord").alias("ord"))
        )

    @cached_property
    def query_tokens(self) -> DataFrame:
        """Distinct folded query tokens per key."""
        own = self._narrow.select("candidate_key", F.explode("query_tokens").alias("t"))
        fallback = F.when(F.size("__first_tokens") > 0, F.col("__first_tokens")).when(
            ~F.col("__any_tokens"), F.col("__winner_tokens")
        )
        first = self._grouped.select("candidate_key", F.explode(fallback).alias("t"))
        token = T.casefold(T.strip(F.col("t")))
        return (
            own.unionByName(first)
            .select("candidate_key", token.alias("token"))
            .where(F.length("token") > 0)
            .distinct()
        )

    def label_counts(self) -> DataFrame:
        """Distinct keys per channel, source role and intent, over all sightings."""
        label = F.explode(
            F.array(
                F.struct(F.lit("channel").alias("dimension"), F.coalesce("source", "channel").alias("label")),
                F.struct(F.lit("source_role").alias("dimension"), F.col("source_role").alias("label")),
                F.struct(F.lit("intent").alias("dimension"), F.col("intent").alias("label")),
            )
        )
        return (
            self.keyed.where(F.col("candidate_key").isNotNull())
            .select("candidate_key", label.alias("l"))
            .select("candidate_key", "l.dimension", T.strip(F.col("l.label")).alias("label"))
            .where(F.length("label") > 0)
            .distinct()
            .groupBy("dimension", "label")
            .agg(F.count(F.lit(1)).alias("count"))
        )

    def summary(self) -> DataFrame:
        """One row: items seen, skipped, candidates, multi-seen, longest history."""
        per_key = self.keyed.groupBy("candidate_key").agg(F.count(F.lit(1)).alias("n"))
        real = F.col("candidate_key").isNotNull()
        return per_key.agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("items_seen"),
            F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).cast("long").alias("skipped_items"),
            F.count_if(real).alias("candidate_count"),
            F.count_if(real & (F.col("n") > 1)).alias("multi_seen_candidates"),
            F.coalesce(F.max(F.when(real, F.col("n"))), F.lit(0)).cast("long").alias("max_seen_in"),
        )


def dedupe(items: DataFrame, by: str = "url", prefer_originals: bool = False, *, written: bool = False) -> Deduped:
    """Group item sightings by key. ``items`` needs a sortable, unique ``ord`` column that defines first-seen order. ``written``: see :class:`Deduped`."""
    items = with_columns(items, {**ITEM_COLUMNS, **SIGHTING_COLUMNS})
    keyed = items.withColumns(
        {"candidate_key": dedupe_key(by), "__rank": preference_rank(F.col("timeline_item_kind"))}
    )
    return Deduped(keyed, prefer_originals, written)


def with_token_hits(candidates: DataFrame, tokens: DataFrame) -> DataFrame:
    """Add query-token counts and hits to candidates from their long-form tokens.

    The haystacks are built once per candidate and meet the tokens in a join on the candidate key; without any token no text moves.
    """
    tokens = durable(tokens, "query-tokens")
    if tokens.isEmpty():
        none = {"query_token_count": F.lit(0), "query_token_hits": F.lit(0), "query_found": F.lit(False)}
        return candidates.withColumns(none)
    hay = candidates.select("candidate_key", S.search_text().alias("__hay"), S.planner_text().alias("__hay2"))
    hits = (
        tokens.join(hay, "candidate_key")
        .groupBy("candidate_key")
        .agg(
            F.count(F.lit(1)).cast("int").alias("query_token_count"),
            F.count_if(F.contains("__hay", F.col("token"))).cast("int").alias("query_token_hits"),
            F.max(F.contains("__hay2", F.col("token"))).alias("query_found"),
        )
    )
    zero = {"query_token_count": 0, "query_token_hits": 0, "query_found": False}
    # three small columns a candidate, which several steps read
    hits = durable(hits, "token-hits")
    return candidates.join(hits, "candidate_key", "left").fillna(zero)
