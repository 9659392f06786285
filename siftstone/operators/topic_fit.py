"""Caller-declared topic rules: normalisation, row evaluation, summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.skew import durable
from .items import with_columns
from .terms import match_sets

# fixed values: rule lists and reason codes
LIST_FIELDS = (
    "required_any_terms",
    "required_all_terms",
    "preferred_terms",
    "excluded_terms",
    "exact_phrases",
    "negative_phrases",
)
STRONG_REASONS = ("topic_fit_required_any", "topic_fit_required_all", "topic_fit_exact_phrase")


def _distinct_terms(values: Sequence[object] | None, name: str) -> tuple[str, ...]:
    if values is None:
        return ()
    if isinstance(values, (str, bytes)) or not isinstance(values, Sequence):
        raise ValueError(f"{name} must be a list")
    kept: dict[str, str] = {}
    for value in values:
        text = str(value or "").strip()
        key = T.norm_literal(text)
        if key:
            kept.setdefault(key, text)
    return tuple(kept.values())


@dataclass(frozen=True)
class TopicRules:
    """One rule block, cleaned once on the driver. Terms are a caller's configuration, not data."""

    required_any_terms: tuple[str, ...] = ()
    required_all_terms: tuple[str, ...] = ()
    preferred_terms: tuple[str, ...] = ()
    excluded_terms: tuple[str, ...] = ()
    exact_phrases: tuple[str, ...] = ()
    negative_phrases: tuple[str, ...] = ()
    synonym_groups: tuple[tuple[str, ...], ...] = field(default=())

    @classmethod
    def of(cls, rules: Mapping[str, object] | TopicRules | None) -> TopicRules:
        if isinstance(rules, TopicRules):
            return rules
        if rules is None:
            return cls()
        if not isinstance(rules, Mapping):
            raise ValueError("topic_fit must be an object")
        lists = {name: _distinct_terms(rules.get(name), f"topic_fit.{name}") for name in LIST_FIELDS}
        groups: dict[frozenset[str], tuple[str, ...]] = {}
        for number, group in enumerate(rules.get("synonym_groups") or (), start=1):
            terms = _distinct_terms(group, f"topic_fit.synonym_groups[{number}]")
            if terms:
                groups.setdefault(frozenset(T.norm_literal(t) for t in terms), terms)
        return cls(**lists, synonym_groups=tuple(groups.values()))

    @property
    def enabled(self) -> bool:
        return any(getattr(self, name) for name in LIST_FIELDS) or bool(self.synonym_groups)

    def spellings(self, term: str) -> list[str]:
        """Normalised term plus the members of every synonym group it belongs to."""
        key = T.norm_literal(term)
        out = {key: None}
        for group in self.synonym_groups:
            members = [T.norm_literal(g) for g in group]
            if key in members:
                out.update(dict.fromkeys(members))
        return list(out)


def _matches(hay: Column, terms: Sequence[str], spell) -> Column:
    """Array of the declared terms found in the haystack, in declared order."""
    if not terms:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(T.contains_any(hay, spell(t)), F.lit(t)) for t in terms]))


def candidate_parts() -> list[Column]:
    names = ("title", "text", "author", "url", "canonical_url", "author_name")
    handle = F.try_element_at(F.col("identifiers"), F.lit("author_handle"))
    tail = (F.col("quoted_author_name"), F.col("quoted_author_handle"), F.array_join(F.col("urls"), " "))
    return [*[F.col(n) for n in names], handle, *tail]


def evaluate(df: DataFrame, parts: list[Column], rules: TopicRules, *, hay: Column | None = None) -> DataFrame:
    """Add a ``topic_fit`` struct: enabled, matched, drop and match reasons, matched terms, missing terms, bonus.

    ``hay`` is a normalised haystack that the rows already have; else it is built from ``parts``.
    """
    if not rules.enabled:
        none = F.array().cast("array<string>")
        return df.withColumn(
            "topic_fit",
            F.struct(
                F.lit(False).alias("enabled"),
                F.lit(True).alias("matched"),
                none.alias("drop_reasons"),
                none.alias("match_reasons"),
                F.create_map().cast("map<string,array<string>>").alias("matched_terms"),
                F.create_map().cast("map<string,array<string>>").alias("missing_required"),
                F.lit(0.0).alias("score_bonus"),
            ),
        )
    given, hay = hay is not None, F.col("__hay") if hay is None else hay
    plain = lambda t: [T.norm_literal(t)]
    found = {
        name: _matches(hay, getattr(rules, name), plain if name in _PLAIN else rules.spellings) for name in LIST_FIELDS
    }
    groups = [[T.norm_literal(t) for t in g] for g in rules.synonym_groups]
    found["synonym_groups"] = (
        F.array_compact(F.array(*[F.when(T.contains_any(hay, g), F.lit(f"group:{i}")) for i, g in enumerate(groups)]))
        if groups
        else F.array().cast("array<string>")
    )
    staged = df if given else df.withColumn("__hay", T.norm_text(T.joined(*parts)))
    staged = staged.withColumns({f"__m_{name}": col for name, col in found.items()})
    staged = staged if given else staged.drop("__hay")
    all_terms = F.array(*[F.lit(t) for t in rules.required_all_terms]).cast("array<string>")
    any_terms = F.array(*[F.lit(t) for t in rules.required_any_terms]).cast("array<string>")
    fit = _verdict({name: F.col(f"__m_{name}") for name in found}, any_terms, all_terms)
    return staged.withColumn("topic_fit", fit).drop(*[f"__m_{name}" for name in found])


def _verdict(found: Mapping[str, Column], any_terms: Column, all_terms: Column) -> Column:
    """``topic_fit`` from the arrays of matched terms by field and the declared required terms."""
    n = {name: F.size(column) for name, column in found.items()}
    missing_all = F.array_except(all_terms, found["required_all_terms"])
    miss_any = (F.size(any_terms) > 0) & (n["required_any_terms"] == 0)
    drops = T.reason_list(
        ("topic_fit_excluded_term", n["excluded_terms"] > 0),
        ("topic_fit_negative_phrase", n["negative_phrases"] > 0),
        ("topic_fit_missing_required_any", miss_any),
        ("topic_fit_missing_required_all", F.size(missing_all) > 0),
    )
    hits = T.reason_list(
        ("topic_fit_required_any", n["required_any_terms"] > 0),
        ("topic_fit_required_all", n["required_all_terms"] > 0),
        ("topic_fit_preferred", n["preferred_terms"] > 0),
        ("topic_fit_exact_phrase", n["exact_phrases"] > 0),
        ("topic_fit_synonym_group", n["synonym_groups"] > 0),
    )
    bonus = (
        F.when(n["required_any_terms"] > 0, 2.0).otherwise(0.0)
        + F.least(n["required_all_terms"], F.lit(4)) * 1.0
        + F.least(n["preferred_terms"], F.lit(3)) * 1.0
        + F.least(n["exact_phrases"], F.lit(2)) * 2.0
        + F.least(n["synonym_groups"], F.lit(3)) * 0.75
    )
    matched = F.map_filter(F.create_map(*[p for name, column in found.items() for p in (F.lit(name), column)]), lambda _, v: F.size(v) > 0)
    missing = F.map_filter(
        F.create_map(
            F.lit("required_any_terms"),
            F.when(miss_any, any_terms).otherwise(F.array().cast("array<string>")),
            F.lit("required_all_terms"),
            missing_all,
        ),
        lambda _, v: F.size(v) > 0,
    )
    return F.struct(
        F.lit(True).alias("enabled"),
        (F.size(drops) == 0).alias("matched"),
        drops.alias("drop_reasons"),
        hits.alias("match_reasons"),
        matched.alias("matched_terms"),
        missing.alias("missing_required"),
        F.round(bonus, 3).alias("score_bonus"),
    )


_PLAIN = ("excluded_terms", "exact_phrases", "negative_phrases")


def evaluate_many(df: DataFrame, parts: list[Column], rule_sets: Mapping[str, TopicRules]) -> DataFrame:
    """Each row once per rule set, with ``rule_set_id`` and its ``topic_fit``.

    Rule sets are configuration: each adds columns to one pass over the rows, so the table is read once and nothing is
    shuffled; the haystack is built once for all of them. Tables of rules go through :func:`evaluate_table`.
    """
    out, names = T.evaluate_once(df, __hay=T.norm_text(T.joined(*parts))), []
    for number, (_, rules) in enumerate(rule_sets.items()):
        out = evaluate(out, parts, rules, hay=F.col("__hay")).withColumnRenamed("topic_fit", f"__fit{number}")
        names.append(f"__fit{number}")
    pairs = F.array(
        *[
            F.struct(F.lit(key).alias("rule_set_id"), F.col(name).alias("topic_fit"))
            for key, name in zip(rule_sets, names)
        ]
    )
    return out.withColumn("__each", F.explode(pairs)).select(*df.columns, "__each.rule_set_id", "__each.topic_fit")


RULE_COLUMNS = {"rule_set_id": "string", "field": "string", "position": "int", "term": "string", "synonym_group": "int"}


def _spellings(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rule_set_id, field, position, declared, spelling) of a rules table, and the declared required terms of each rule set."""
    key = T.norm_text(T.strip(F.col("term")))
    rows = rules.select("rule_set_id", "field", "position", "synonym_group", T.strip(F.col("term")).alias("term"), key.alias("key")).where("key <> ''")
    # the first spelling of a term stands for its repeats
    declared = rows.where(F.col("field").isin(*LIST_FIELDS)).groupBy("rule_set_id", "field", "key").agg(
        F.min_by("term", "position").alias("declared"), F.min("position").alias("position")
    )
    members = rows.where("field = 'synonym_groups'").groupBy("rule_set_id", "synonym_group").agg(F.sort_array(F.collect_set("key")).alias("members"))
    members = members.groupBy("rule_set_id", "members").agg(F.min("synonym_group").alias("synonym_group"))
    numbered = members.withColumn("number", F.row_number().over(Window.partitionBy("rule_set_id").orderBy("synonym_group")) - 1)
    group = numbered.select("rule_set_id", "number", F.explode("members").alias("spelling"))
    own = declared.select("rule_set_id", "field", "position", "declared", F.col("key").alias("spelling"))
    widened = own.where(~F.col("field").isin(*_PLAIN)).withColumnRenamed("spelling", "key")
    widened = widened.join(numbered, (widened["rule_set_id"] == numbered["rule_set_id"]) & F.array_contains("members", F.col("key"))).select(
        widened["rule_set_id"], "field", "position", "declared", F.explode("members").alias("spelling")
    )
    named = group.select("rule_set_id", F.lit("synonym_groups").alias("field"), F.col("number").alias("position"), F.format_string("group:%d", "number").alias("declared"), "spelling")
    required = lambda name: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("field") == name, F.struct("position", "declared")))), lambda x: x["declared"]
    )
    needs = declared.groupBy("rule_set_id").agg(required("required_any_terms").alias("__any"), required("required_all_terms").alias("__all"))
    sets = rows.select("rule_set_id").distinct().join(needs, "rule_set_id", "left")
    none = F.array().cast("array<string>")
    return own.unionByName(widened).unionByName(named).distinct(), sets.select("rule_set_id", F.coalesce("__any", none).alias("__any"), F.coalesce("__all", none).alias("__all"))


def evaluate_table(df: DataFrame, parts: list[Column], rules: DataFrame, *, row_id: str = "ord") -> DataFrame:
    """Rule sets of a table of any size against all rows: (``row_id``, rule_set_id, topic_fit) for each pair with at least one hit.

    ``rules`` has :data:`RULE_COLUMNS`: one declared term a row, ``field`` one of :data:`LIST_FIELDS` or ``synonym_groups`` (then with its group's number).
    Pairs without any hit are not written out, as their result depends on the rule set alone (:func:`verdict_without_hits`). All haystacks are built once
    and meet all terms in one pass; the plan does not grow with the rules.
    """
    spelled, needs = _spellings(with_columns(rules, RULE_COLUMNS))
    spelled = durable(spelled, "spellings")
    # a hit travels as its place in the rule set's list of declared terms; the names are put back once the hits of a row are together
    declared = spelled.groupBy("rule_set_id").agg(F.sort_array(F.collect_set(F.struct("field", "position", "declared"))).alias("__declared"))
    sets = durable(needs.join(declared, "rule_set_id"), "rule-sets")
    places = sets.select("rule_set_id", F.posexplode("__declared").alias("code", "d")).select("rule_set_id", "code", "d.*")
    entries = spelled.join(places, ["rule_set_id", "field", "position", "declared"])
    repeated = durable(df.groupBy(row_id).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(row_id), "repeated")
    found = match_sets(df, T.norm_text(T.joined(*parts)), entries, row_id=row_id, group="rule_set_id", term="spelling")
    if not repeated.isEmpty():
        # hits of rows under one id count together
        again = found.join(repeated, row_id, "left_semi").groupBy(row_id, "rule_set_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"))
        found = found.join(repeated, row_id, "left_anti").unionByName(again)
    staged = found.join(sets, "rule_set_id").withColumn("__hits", F.transform("codes", lambda c: F.get("__declared", c)))
    of = lambda name: F.transform(F.filter("__hits", lambda h: h["field"] == name), lambda h: h["declared"])
    names = (*LIST_FIELDS, "synonym_groups")
    staged = T.evaluate_once(staged, **{f"__m_{name}": of(name) for name in names})
    return staged.select(row_id, "rule_set_id", _verdict({n: F.col(f"__m_{n}") for n in names}, F.col("__any"), F.col("__all")).alias("topic_fit"))


def verdict_without_hits(rules: DataFrame) -> DataFrame:
    """(rule_set_id, topic_fit) of a row in which no term of the rule set occurs."""
    _, needs = _spellings(with_columns(rules, RULE_COLUMNS))
    none = F.array().cast("array<string>")
    return needs.select("rule_set_id", _verdict({n: none for n in (*LIST_FIELDS, "synonym_groups")}, F.col("__any"), F.col("__all")).alias("topic_fit"))


def quality_reasons(fit: Column) -> Column:
    """Positive reasons of a matched row."""
    return F.when(fit["matched"], F.filter(fit["match_reasons"], lambda r: F.startswith(r, F.lit("topic_fit_")))).otherwise(
        F.array().cast("array<string>")
    )


def score_bonus(fit: Column) -> Column:
    return F.when(fit["matched"], fit["score_bonus"]).otherwise(0.0)


def summary(evaluated: DataFrame) -> DataFrame:
    """Long-form (section, key, count) summary of evaluated rows in one pass."""
    fit = F.col("topic_fit")
    verdict = F.when(fit["matched"], F.lit("matched")).otherwise(F.lit("dropped"))

    def tag(section: str, reasons: Column) -> Column:
        return F.transform(reasons, lambda r: F.struct(F.lit(section).alias("section"), r.alias("key"), F.lit(1).alias("n")))

    entry = lambda section, key, n: F.struct(F.lit(section).alias("section"), key.alias("key"), n.alias("n"))
    rows = F.concat(
        F.array(entry("total", F.lit("evaluated"), F.lit(1)), entry("total", verdict, F.lit(1))),
        tag("drop", fit["drop_reasons"]),
        tag("match", fit["match_reasons"]),
        F.transform(
            F.map_entries(fit["missing_required"]),
            lambda e: F.struct(F.lit("missing").alias("section"), e["key"].alias("key"), F.size(e["value"]).alias("n")),
        ),
    )
    return (
        evaluated.select(F.explode(rows).alias("r"))
        .groupBy(F.col("r.section").alias("section"), F.col("r.key").alias("key"))
        .agg(F.sum("r.n").cast("long").alias("count"))
    )
