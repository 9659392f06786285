"""Scoring and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftstone.functions import patterns
from siftstone.operators import coverage, curate, judge, neardup, score
from siftstone.operators import topic_fit as tf
from siftstone.plans.candidates import plan_candidates
from siftstone.plans.mission import Mission, curate_mission, fill_gaps

from .base import MARKED_SQL, POSTS_SQL, SIGHT_SQL, fold, query
from .filters import FIT_SQL, MASK, PROMO, RULES, squeezed

ENGAGEMENT_SQL = "CASE WHEN coalesce(likes, 0) > 0 THEN log10(likes + 1) ELSE 0 END + CASE WHEN coalesce(retweets, 0) > 0 THEN log10(retweets + 1) * 2.0 ELSE 0 END + CASE WHEN coalesce(views, 0) > 0 THEN log10(views + 1) * 0.2 ELSE 0 END"


def _w(words: str) -> str:
    return f"regexp_matches(t, '\\b(?:{words})\\b')"


_PROC = "tried|tested|ran|measured|benchmarked|timed|logged|observed|recorded|reproduced|debugged|built|shipped|deployed|migrated|installed|upgraded|rolled back|switched|changed|adjusted|compared|sampled|dialed|dialled|brewed|pulled|tasted|cooked|baked|mixed|weighed|configured|validated|verified"
_HAND = "tried|tested|built|shipped|deployed|migrated|ran|saw|found|noticed|measured|benchmarked|reproduced|debugged|used|switched|paid|cancelled|installed|upgraded|rolled back|hit|fixed|broke|dialed|dialled|brewed|pulled|tasted|compared|changed|adjusted|logged|observed|recorded|cooked|baked|mixed|weighed"
_DETAIL = r"(\b\d{1,4}(?:[.,]\d+)?%?\b|\b20\d{2}[-/]\d{1,2}[-/]\d{1,2}\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b|\$[0-9]|\bv?\d+\.\d+\b|\b(?:p50|p90|p95|p99)\b|\b(?:ms|sec|secs|seconds|minutes|hours|days|g|kg|mg|ml|l|oz|lb|rpm|bar|psi|degc|degf|celsius|fahrenheit)\b)"
# source: a relation named posts with item columns plus tokens, hits, seen and the topic-fit columns
SCORE_SQL = f"""t0 AS (SELECT *, {MASK.format('lower(text)')} AS t, {fold('text')} AS f, {squeezed('text')} AS q, {ENGAGEMENT_SQL} AS eng FROM src),
t1 AS (SELECT *, len(list_distinct(regexp_extract_all(t, '{_DETAIL}'))) AS concrete, {_w(_PROC)} AS process,
  regexp_matches(t, '\\b(?:i|we|my|our)\\b[^\\n]{{0,64}}\\b(?:{_HAND})\\b') OR regexp_matches(t, '\\b(?:our|my) (?:team|company|org|production|prod|deployment|workflow)\\b') AS person,
  {_w('screenshot|screen recording|video|demo|log|logs|trace|stack trace|error|repro|reproduced|benchmark|metric|metrics|chart|table|graph|diff|commit|pull request|pr #?[0-9]+|issue #?[0-9]+|latency|throughput|photo|before/after|before and after|result|results|measured|measurement|measurements')} AS obs,
  {_w('compared|versus|vs|before/after|before and after|a/b|baseline|regression|improved|worse|better|changed from|changed to')} AS cmp,
  {_w('workflow|setup|configuration|settings|recipe|process|steps|method|workaround|rollout|deployment|tasting note|notes|details|ingredient|sample|batch|run|trial|experiment')} AS spec,
  {PROMO} OR {_w('ad|sponsored|sponsorship|giveaway|coupon|discount|promo code|use code|referral|affiliate|sale|limited time|free shipping|merch|storefront|shop now|buy now|order now|pre[- ]?order|link in bio|dm (?:me|us) to order|grand opening|visit us at|book now|reserve now')} AS promo,
  {_w('shop|buy|order|purchase|book|reserve|get yours|available now|on sale|sold out|restock')} AS commerce,
  {_w('link in bio|dm (?:me|us)')} OR regexp_matches(t, '\\b(?:click|tap|visit|follow|subscribe|join|sign up|shop|buy|order|book|reserve|get|download)\\b[^\\n]{{0,36}}\\b(?:now|today|here|below|bio|link|for more|to order|to buy)\\b') AS cta,
  {_w("we''?re excited to announce|introducing|now available|launching|just launched|new drop|come visit|check out our")} AS news FROM t0),
t2 AS (SELECT *, person OR process AS hand FROM t1),
t3 AS (SELECT *, (concrete > 0)::INT + hand::INT + process::INT + obs::INT + cmp::INT + spec::INT AS sup,
  (tokens > 0 AND hits > 0) OR bonus > 0 AS topical, tokens > 0 AND hits > 0 AS matches,
  length(q) <= 12 OR (coalesce(kind, '') = 'quote' AND len(string_split(q, ' ')) <= 8 AND ends_with(q, ':')) AS thin,
  coalesce(kind, '') = 'quote' AND length(trim(regexp_replace(text, 'https?://\\S+', '', 'g'))) < 80 AS thinq FROM t2),
scored AS (SELECT *, round(CASE WHEN seen > 1 THEN least(seen, 5) * 6.0 ELSE 0 END
  + CASE kind WHEN 'original' THEN 8 WHEN 'quote' THEN 3 WHEN 'reply' THEN -4 WHEN 'retweet' THEN -8 ELSE 0 END
  + CASE WHEN matches THEN 2 + least(hits * 1.5, 4.0) ELSE 0 END + CASE WHEN matches AND hits * 4 >= tokens * 3 THEN 2 ELSE 0 END
  + CASE WHEN tokens > 0 AND hits = 0 THEN -3 ELSE 0 END + least(eng, 4.0)
  + CASE WHEN length(text) >= 80 THEN 3 WHEN length(text) >= 35 THEN 1.5 ELSE 0 END + CASE WHEN url IS NOT NULL THEN 0.5 ELSE 0 END
  + CASE WHEN concrete > 0 THEN least(2 + concrete * 0.75, 4.0) ELSE 0 END + process::INT * 2 + hand::INT * 4 + obs::INT * 1.5 + cmp::INT * 1.5 + spec::INT
  + thinq::INT * -3 + thin::INT * -3 + promo::INT * -4 + commerce::INT * -2 + cta::INT * -3 + (news AND sup <= 1)::INT * -1.5
  + ((promo OR commerce OR cta OR news) AND sup <= 1)::INT * -4 + (cta AND sup <= 1)::INT * -2
  + least(bonus, 3.0) + (bonus > 0 AND strong)::INT + (topical AND sup = 0)::INT * -3 + (topical AND sup >= 3)::INT * 2.5, 3) AS quality_score,
 list_filter([CASE WHEN seen > 1 THEN 'multi_seen' END, CASE WHEN kind IN ('original','quote','reply','retweet') THEN kind END,
  CASE WHEN matches THEN 'query_match' END, CASE WHEN matches AND hits * 4 >= tokens * 3 THEN 'strong_query_match' END,
  CASE WHEN tokens > 0 AND hits = 0 THEN 'query_miss_penalty' END, CASE WHEN eng > 4 THEN 'engagement_capped' END, CASE WHEN eng > 0 THEN 'engagement' END,
  CASE WHEN length(text) >= 80 THEN 'substantial_text' WHEN length(text) >= 35 THEN 'some_text' END, CASE WHEN url IS NOT NULL THEN 'has_url' END,
  CASE WHEN concrete > 0 THEN 'concrete_detail' END, CASE WHEN process THEN 'process_evidence' END, CASE WHEN hand THEN 'first_hand_signal' END,
  CASE WHEN obs THEN 'observable_signal' END, CASE WHEN cmp THEN 'comparison_signal' END, CASE WHEN spec THEN 'specificity_signal' END,
  CASE WHEN thinq THEN 'thin_quote' END, CASE WHEN thin THEN 'thin_content' END, CASE WHEN promo THEN 'promo_language' END,
  CASE WHEN commerce THEN 'commerce_language' END, CASE WHEN cta THEN 'cta_language' END, CASE WHEN news AND sup <= 1 THEN 'generic_announcement' END,
  CASE WHEN (promo OR commerce OR cta OR news) AND sup <= 1 THEN 'low_evidence_promo' END, CASE WHEN cta AND sup <= 1 THEN 'cta_over_evidence' END,
  CASE WHEN bonus > 0 AND list_contains(fits, 'topic_fit_required_any') THEN 'topic_fit_required_any' END, CASE WHEN bonus > 0 AND list_contains(fits, 'topic_fit_required_all') THEN 'topic_fit_required_all' END,
  CASE WHEN bonus > 0 AND list_contains(fits, 'topic_fit_preferred') THEN 'topic_fit_preferred' END, CASE WHEN bonus > 0 AND list_contains(fits, 'topic_fit_exact_phrase') THEN 'topic_fit_exact_phrase' END,
  CASE WHEN bonus > 0 AND list_contains(fits, 'topic_fit_synonym_group') THEN 'topic_fit_synonym_group' END,
  CASE WHEN bonus > 0 AND strong THEN 'topic_fit_strong' END, CASE WHEN topical AND sup = 0 THEN 'weak_evidence_density' END,
  CASE WHEN topical AND sup >= 3 THEN 'evidence_dense' END], lambda v: v IS NOT NULL) AS reasons FROM t3)"""

# posts with the query "pricing codex", seen counts, and topic rules
SRC_SQL = f"""{POSTS_SQL}, {FIT_SQL}, src AS (SELECT * EXCLUDE (bonus, hits), ord % 3 + 1 AS seen, 2 AS tokens,
  contains({fold("concat(text, ' ', author, ' ', coalesce(url, ''))")}, 'pricing')::INT + contains({fold("concat(text, ' ', author, ' ', coalesce(url, ''))")}, 'codex')::INT AS hits,
  CASE WHEN matched THEN bonus ELSE 0 END AS bonus, CASE WHEN matched THEN fit.hits ELSE [] END AS fits, true AS strong FROM fit)"""
PLAIN_SQL = f"""{POSTS_SQL}, src AS (SELECT *, ord % 3 + 1 AS seen, 2 AS tokens,
  contains({fold("concat(text, ' ', author, ' ', coalesce(url, ''))")}, 'pricing')::INT + contains({fold("concat(text, ' ', author, ' ', coalesce(url, ''))")}, 'codex')::INT AS hits,
  0.0 AS bonus, CAST([] AS VARCHAR[]) AS fits, false AS strong FROM posts)"""


def _source(t):
    tokens = F.array(F.lit("pricing"), F.lit("codex"))
    posts = t.posts().withColumns({"seen_in_count": (F.col("ord") % 3 + 1).cast("bigint"), "query_tokens": tokens})
    return score.with_query_hits(posts)


def _scored(t):
    return score.score(_source(t))


def _scored_with_topics(t):
    parts = [F.col("title"), F.col("text"), F.col("author"), F.col("url")]
    return score.score(tf.evaluate(_source(t), parts, tf.TopicRules.of(RULES)))


@query("engagement_score", f"WITH {POSTS_SQL} SELECT ord, round({ENGAGEMENT_SQL}, 6) AS engagement FROM posts")
def engagement_score(t):
    from siftstone.functions.values import engagement_score as points

    return t.posts().select("ord", F.round(points(F.col("engagement")), 6).alias("engagement"))


@query("evidence_score", f"WITH {PLAIN_SQL}, {SCORE_SQL} SELECT ord, CAST(quality_score AS DOUBLE) AS quality_score, array_to_string(reasons, ',') AS reasons FROM scored")
def evidence_score(t):
    return _scored(t).select("ord", "quality_score", F.array_join("quality_reasons", ",").alias("reasons"))


@query("evidence_score_with_topics", f"WITH {SRC_SQL}, {SCORE_SQL} SELECT ord, CAST(quality_score AS DOUBLE) AS quality_score, array_to_string(reasons, ',') AS reasons FROM scored")
def evidence_score_with_topics(t):
    return _scored_with_topics(t).select("ord", "quality_score", F.array_join("quality_reasons", ",").alias("reasons"))


_NEG = "query_miss_penalty reply retweet thin_quote thin_content promo_language commerce_language cta_language generic_announcement low_evidence_promo cta_over_evidence weak_evidence_density coverage_topic_only media_only".split()


@query("quality_diagnostics", f"""WITH {PLAIN_SQL}, {SCORE_SQL}, r AS (SELECT unnest(reasons) AS key FROM scored)
SELECT 'scored' AS section, 'deterministic_evidence_v3' AS key, count(*) AS count FROM scored
UNION ALL SELECT 'reason', key, count(*) FROM r GROUP BY 2
UNION ALL SELECT 'negative', key, count(*) FROM r WHERE key IN ({", ".join(f"'{n}'" for n in _NEG)}) GROUP BY 2""")
def quality_diagnostics(t):
    return score.diagnostics(_scored(t))


@query("signal_counts", f"""WITH {PLAIN_SQL}, {SCORE_SQL} SELECT author, CAST(sum(concrete) AS BIGINT) AS concrete, count(*) FILTER (WHERE process) AS process,
 count(*) FILTER (WHERE hand) AS first_hand, count(*) FILTER (WHERE obs) AS observable, count(*) FILTER (WHERE cmp) AS comparison,
 count(*) FILTER (WHERE spec) AS specific, count(*) FILTER (WHERE promo) AS promo, count(*) FILTER (WHERE commerce) AS commerce,
 count(*) FILTER (WHERE cta) AS cta, count(*) FILTER (WHERE news) AS news FROM scored GROUP BY author""")
def signal_counts(t):
    s = score.with_signals(t.posts())
    n = lambda c, a: F.count_if(F.col(f"sig_{c}")).alias(a)
    return s.groupBy("author").agg(
        F.sum("sig_concrete").alias("concrete"), n("process", "process"), n("first_hand", "first_hand"), n("observable", "observable"),
        n("comparison", "comparison"), n("specific", "specific"), n("promo", "promo"), n("commerce", "commerce"), n("cta", "cta"), n("announcement", "news"),
    )


@query("top_by_score", f"WITH {PLAIN_SQL}, {SCORE_SQL} SELECT ord, CAST(quality_score AS DOUBLE) AS quality_score FROM scored ORDER BY quality_score DESC, ord LIMIT 25")
def top_by_score(t):
    return _scored(t).orderBy(F.desc("quality_score"), "ord").limit(25).select("ord", "quality_score")


_RANK_SQL = f"""{PLAIN_SQL}, {SCORE_SQL}, ranked AS (SELECT *, row_number() OVER (ORDER BY quality_score DESC, seen DESC, coalesce(published_at, ''), id, ord) AS rank FROM scored)"""


def _ranked(t):
    return curate.final_rank(_scored(t).withColumn("first_ord", F.col("ord")))


@query("final_rank", f"WITH {_RANK_SQL} SELECT rank, ord, CAST(quality_score AS DOUBLE) AS quality_score FROM ranked")
def final_rank(t):
    return _ranked(t).select("rank", "ord", "quality_score")


@query("diversity_one_cap", f"""WITH {_RANK_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY lower(author) ORDER BY rank) AS k FROM ranked)
SELECT rank, ord FROM n WHERE k <= 3""")
def diversity_one_cap(t):
    return curate.apply_diversity(_ranked(t), {"author_diversity": 3})[0].select("rank", "ord")


@query("diversity_three_caps", f"""WITH RECURSIVE {_RANK_SQL},
k AS (SELECT CAST(rank AS BIGINT) AS rank, ord, lower(author) AS a, lower(conversation_id) AS c, lower(rtrim(split_part(url, '#', 1), '/')) AS u FROM ranked),
walk(place, kept, outcome) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(a VARCHAR, c VARCHAR, u VARCHAR)[]), '' UNION ALL
 SELECT rank, CASE WHEN outcome = 'kept' THEN list_append(kept, {{'a': a, 'c': c, 'u': u}}) ELSE kept END, outcome FROM (
  SELECT k.*, kept, CASE WHEN len(list_filter(kept, lambda x: x.a = k.a)) >= 12 THEN 'author_diversity' WHEN len(list_filter(kept, lambda x: x.c = k.c)) >= 3 THEN 'thread_diversity'
   WHEN len(list_filter(kept, lambda x: x.u = k.u)) >= 1 THEN 'url_diversity' ELSE 'kept' END AS outcome FROM walk w JOIN k ON k.rank = w.place + 1))
SELECT k.rank, k.ord, outcome FROM walk JOIN k ON k.rank = walk.place""")
def diversity_three_caps(t):
    kept, dropped = curate.apply_diversity(_ranked(t), {"author_diversity": 12, "thread_diversity": 3, "url_diversity": 1})
    return kept.select("rank", "ord", F.lit("kept").alias("outcome")).unionByName(dropped.select("rank", "ord", F.col("reason").alias("outcome")))


@query("concentration", f"""WITH {POSTS_SQL}, k AS (SELECT 'authors' AS dimension, lower(author) AS key FROM posts UNION ALL SELECT 'threads', lower(conversation_id) FROM posts
  UNION ALL SELECT 'urls', lower(rtrim(split_part(url, '#', 1), '/')) FROM posts), c AS (SELECT dimension, key, count(*) AS n FROM k GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, key) AS i FROM c WHERE key IS NOT NULL)
SELECT dimension, 'unique' AS kind, CAST(NULL AS VARCHAR) AS key, count(*) FILTER (WHERE key IS NOT NULL) AS count FROM c GROUP BY dimension
UNION ALL SELECT dimension, 'missing', NULL, CAST(coalesce(sum(n) FILTER (WHERE key IS NULL), 0) AS BIGINT) FROM c GROUP BY dimension
UNION ALL SELECT dimension, 'top', key, n FROM r WHERE i <= 5""")
def concentration(t):
    return curate.concentration(t.posts())


@query("time_spread", f"""WITH {POSTS_SQL} SELECT left(published_at, 10) AS bucket, count(*) AS count, min(published_at) AS earliest, max(published_at) AS latest
FROM posts WHERE published_at IS NOT NULL GROUP BY 1""")
def time_spread(t):
    return curate.time_spread(t.posts())


# ---- near duplicates ---------------------------------------------------------------------------------------------

_STOPS = ", ".join(f"'{w}'" for w in patterns.STOP_TOKENS)
_PROMOISH = ", ".join(f"'{r}'" for r in score.PROMOISH_REASONS)
_LETTER = r"a-zA-Z0-9_\p{L}\p{N}"
_CLEAN = (
    f"""regexp_replace(regexp_replace(regexp_replace({fold("concat(coalesce(title, ''), ' ', coalesce(text, ''))")}, '(?:https?://|www\\.|t\\.co/)\\S+', ' ', 'g'),"""
    f""" '(^|[^{_LETTER}])@[A-Za-z0-9_]{{1,15}}', '\\1 ', 'g'), '(^|[^{_LETTER}])#([{_LETTER}]+)', '\\1 \\2 ', 'g')"""
)
# the rule as it is told: walk by falling score, join the first representative that matches, else become one
_NEAR_SQL = f"""{PLAIN_SQL}, {SCORE_SQL},
tk AS (SELECT ord, id, quality_score, reasons, {fold("trim(coalesce(author, ''))")} AS au, list_has_any(reasons, [{_PROMOISH}]) AS pr,
  list_filter([CASE WHEN regexp_full_match(x, '[0-9]+') THEN '0' ELSE x END FOR x IN regexp_extract_all({_CLEAN}, '[a-z0-9\\x{{131}}][a-z0-9\\x{{131}}_+-]*')],
    lambda x: (length(x) >= 3 OR x = '0') AND NOT list_contains([{_STOPS}], x)) AS al FROM scored),
sg AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY quality_score DESC, ord) AS r, list_distinct(al) AS tok, array_to_string(al[1:48], ' ') AS tkey, array_to_string(al[1:8], ' ') AS pkey
  FROM tk WHERE len(al) >= 6 AND len(list_distinct(al)) >= 5),
ex AS MATERIALIZED (SELECT r, unnest(tok) AS tn FROM sg),
sh AS (SELECT a.r AS ar, b.r AS br, count(*) AS sh FROM ex a JOIN ex b ON a.tn = b.tn AND a.r < b.r GROUP BY a.r, b.r HAVING count(*) >= 5),
pw AS (SELECT ar, br, sh, least(len(a.tok), len(b.tok)) AS sm, greatest(len(a.tok), len(b.tok)) AS bg,
  a.tkey = b.tkey AS st, a.pkey = b.pkey AS sp, length(a.au) > 0 AND a.au = b.au AS sa, a.pr OR b.pr AS pp FROM sh JOIN sg a ON a.r = ar JOIN sg b ON b.r = br),
mt AS MATERIALIZED (SELECT br, list(ar ORDER BY ar) AS mates FROM pw WHERE (st OR (sp AND sh / sm >= 0.75) OR (sh / sm >= 0.9 AND sh / (sm + bg - sh) >= 0.72)
  OR (sa AND pp AND sh / sm >= 0.62) OR (pp AND sh / sm >= 0.72 AND sh / (sm + bg - sh) >= 0.55)) GROUP BY br),
st AS MATERIALIZED (SELECT r, coalesce(mates, []) AS mates FROM sg LEFT JOIN mt ON br = r),
walk(place, reps, leader) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(0 AS BIGINT) UNION ALL
  SELECT r, CASE WHEN first IS NULL THEN list_append(reps, r) ELSE reps END, coalesce(first, r) FROM (
    SELECT st.r, w.reps, list_min(list_filter(st.mates, lambda x: list_contains(w.reps, x))) AS first FROM walk w JOIN st ON st.r = w.place + 1)),
cl AS (SELECT sg.*, l.ord AS leader_ord, leader, place = leader AS is_rep FROM walk JOIN sg ON sg.r = place JOIN sg l ON l.r = leader)"""


@query("near_duplicate_downrank", f"""WITH RECURSIVE {_NEAR_SQL}, dup AS (SELECT ord, row_number() OVER (PARTITION BY leader ORDER BY r) AS k FROM cl WHERE NOT is_rep)
SELECT s.ord, CAST(CASE WHEN k IS NULL THEN quality_score ELSE round(quality_score - least(4.0 + 1.5 * least(k, 3), 8.0), 3) END AS DOUBLE) AS quality_score,
 array_to_string(CASE WHEN k IS NULL THEN reasons ELSE list_concat(reasons, ['near_duplicate_downrank', CASE WHEN list_has_any(reasons, [{_PROMOISH}]) THEN 'near_duplicate_promo_cluster' ELSE 'near_duplicate_template' END]) END, ',') AS reasons
FROM scored s LEFT JOIN dup USING (ord)""")
def near_duplicate_downrank(t):
    out = neardup.downrank(_scored(t), "id", "ord", columns=("ord",))
    return out.select("ord", "quality_score", F.array_join("quality_reasons", ",").alias("reasons"))


@query("near_duplicate_clusters", f"WITH RECURSIVE {_NEAR_SQL} SELECT id AS row_id, leader_ord AS leader, is_rep FROM cl")
def near_duplicate_clusters(t):
    ranked = _scored(t).withColumn("rank", F.struct((F.lit(0.0) - F.col("quality_score")).alias("s"), F.col("ord").alias("o")))
    found = neardup.clusters(ranked, "id")
    return found.select("row_id", F.col("cluster.o").alias("leader"), "is_rep")


# ---- topic spread and coverage -----------------------------------------------------------------------------------

def topics(t, least: int | None = None):
    """Declared topics; two of them ask for as many posts as there are documents unless told otherwise."""
    n = t.documents.count() if least is None else least
    return (
        coverage.Topic("pricing", "Pricing", ("pricing", "coupon")),
        coverage.Topic("bench", "Benchmarks", ("latency", "baseline"), min_posts=n),
        coverage.Topic("agents", "Coding agents", ("codex",), queries=("codex agent", "agent review"), min_posts=n),
        coverage.Topic("none", "Nothing here", ("qqqzzz",)),
    )


TOPICS = topics(None, 1)


@query("coverage_topics", f"""WITH {POSTS_SQL}, h AS (SELECT ord, {fold("concat(title, ' ', text, ' ', author)")} AS h FROM posts)
SELECT ord, array_to_string(list_filter([CASE WHEN contains(h, 'pricing') OR contains(h, 'coupon') THEN 'pricing' END,
 CASE WHEN contains(h, 'latency') OR contains(h, 'baseline') THEN 'bench' END, CASE WHEN contains(h, 'codex') THEN 'agents' END], lambda v: v IS NOT NULL), ',') AS topics FROM h""")
def coverage_topics(t):
    a = coverage.annotate(t.posts(), TOPICS)
    names = F.array_join(F.transform("coverage_topics", lambda x: x["topic_id"]), ",")
    return a.select("ord", F.coalesce(names, F.lit("")).alias("topics"))


_COV = f"""{POSTS_SQL}, h AS (SELECT ord, id, {fold("concat(title, ' ', text, ' ', author)")} AS h FROM posts),
m AS (SELECT 0 AS t, 'pricing' AS topic_id, 1 AS min_posts, ord, id FROM h WHERE contains(h, 'pricing') OR contains(h, 'coupon')
 UNION ALL SELECT 1, 'bench', (SELECT count(*) FROM documents), ord, id FROM h WHERE contains(h, 'latency') OR contains(h, 'baseline')
 UNION ALL SELECT 2, 'agents', (SELECT count(*) FROM documents), ord, id FROM h WHERE contains(h, 'codex')),
rep AS (SELECT t, topic_id, count(*) AS count, min_posts, greatest(min_posts - count(*), 0) AS gap,
  array_to_string((list(id ORDER BY ord))[1:3], ',') AS samples FROM m GROUP BY ALL UNION ALL SELECT 3, 'none', 0, 1, 1, '')"""
_COV = _COV.replace('FROM m GROUP BY ALL', 'FROM m GROUP BY t, topic_id, min_posts')


def _report(t):
    return coverage.report(t.posts(), topics(t), rank="ord")


@query("coverage_report", f"WITH {_COV} SELECT topic_id, count, min_posts, gap, samples FROM rep")
def coverage_report(t):
    return _report(t).select("topic_id", "count", "min_posts", "gap", F.array_join("sample_ids", ",").alias("samples"))


def _gaps(t):
    spark = t.spark
    follow = coverage.follow_ups(spark, TOPICS, ["en", "ja"], objective="Tool research", target_posts=40)
    # what has been planned already: the languages of the table with one of the texts
    planned = t.documents.select("lang").distinct().select(F.lit(" Codex AGENT").alias("input"), "lang")
    return coverage.gap_queries(_report(t), follow, planned, max_queries=4)


@query("gap_queries", f"""WITH {_COV} SELECT * FROM (VALUES ('gap01-benchmarks-en', 'bench', 'Tool research Benchmarks', 'en', 20), ('gap02-benchmarks-ja', 'bench', 'Tool research Benchmarks', 'ja', 20),
 ('gap03-coding-agents-ja', 'agents', 'codex agent', 'ja', 20), ('gap04-coding-agents-en', 'agents', 'agent review', 'en', 20)) v(query_id, topic_id, input, lang, "limit")
WHERE (SELECT count(*) FROM rep WHERE t IN (1, 2) AND gap > 0) = 2""")
def gap_queries(t):
    return _gaps(t)[0].select("query_id", "topic_id", "input", "lang", "limit")


@query("gap_marking", f"""WITH {_COV} SELECT topic_id, gap, t IN (1, 2) AS queryable, CASE WHEN t IN (1, 2) THEN 2 ELSE 0 END AS planned_query_count,
 CASE WHEN t = 3 THEN 'query_budget_exhausted' END AS blocked_reason FROM rep""")
def gap_marking(t):
    return _gaps(t)[1].select("topic_id", "gap", "queryable", "planned_query_count", "blocked_reason")


@query("coverage_summary", f"""WITH {_COV} SELECT count(*) FILTER (WHERE gap > 0) AS topic_gap_count, 2 AS queryable_topic_gap_count,
 count(*) FILTER (WHERE gap > 0) - 2 AS unqueryable_topic_gap_count, 4 AS used_queries, 0 AS remaining_queries, true AS query_budget_exhausted,
 0 AS target_gap, false AS target_gap_report_only FROM rep""")
def coverage_summary(t):
    return coverage.coverage_summary(_gaps(t)[1], t.documents.count(), 100, 4)


@query("query_expansion", """SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 3 = 0 THEN 'search' WHEN n_nationkey % 3 = 1 THEN 'user_posts' ELSE 'search' END AS operation,
 unnest(CASE WHEN n_nationkey % 3 = 0 THEN (SELECT list(DISTINCT lang ORDER BY lang) FROM documents) WHEN n_nationkey % 3 = 1 THEN [NULL] ELSE ['pt'] END) AS lang FROM nation""")
def query_expansion(t):
    languages = t.documents.select("lang").where("lang IS NOT NULL").distinct()
    kind = F.col("n_nationkey") % 3
    q = t.nation.select(
        "n_nationkey", "n_name", F.when(kind == 1, "user_posts").otherwise("search").alias("operation"), F.when(kind == 2, "pt").alias("lang")
    )
    return coverage.expand_queries(q, languages)



_SPREAD_SQL = f"""WITH {_RANK_SQL}, h AS (SELECT *, {fold("concat(title, ' ', text, ' ', author)")} AS h FROM ranked),
f AS (SELECT *, contains(h, 'pricing') OR contains(h, 'coupon') AS a, contains(h, 'latency') OR contains(h, 'baseline') AS b, contains(h, 'codex') AS c FROM h),
p1 AS (SELECT rank, b AS has_b, c AS has_c FROM f WHERE a ORDER BY rank LIMIT 1),
p2 AS (SELECT rank, c AS has_c FROM f WHERE b AND NOT (SELECT has_b FROM p1) ORDER BY rank LIMIT 1),
p3 AS (SELECT rank FROM f WHERE c AND NOT (SELECT has_c FROM p1) AND NOT coalesce((SELECT has_c FROM p2), false) ORDER BY rank LIMIT 1),
tops AS (SELECT rank, 1 AS g FROM p1 UNION ALL SELECT rank, 2 FROM p2 UNION ALL SELECT rank, 3 FROM p3),
rest AS (SELECT rank, 4 AS g FROM f WHERE rank NOT IN (SELECT rank FROM tops) ORDER BY rank LIMIT 12)"""
_SPREAD_PICK = "SELECT row_number() OVER (ORDER BY g, rank) AS position, rank FROM (SELECT * FROM tops UNION ALL SELECT * FROM rest) QUALIFY position <= 12"


@query("topic_spread", f"""{_SPREAD_SQL} {_SPREAD_PICK}""")
def topic_spread(t):
    ranked = coverage.annotate(_ranked(t), TOPICS)
    chosen, _ = curate.topic_spread(ranked, [x.topic_id for x in TOPICS], 12)
    return chosen.select(F.col("position").cast("bigint").alias("position"), "rank")


_TOPIC_NAMES = "list_filter([CASE WHEN bool_or(a) THEN 'pricing' END, CASE WHEN bool_or(b) THEN 'bench' END, CASE WHEN bool_or(c) THEN 'agents' END], lambda v: v IS NOT NULL)"


@query("topic_spread_status", f"""{_SPREAD_SQL}, chosen AS ({_SPREAD_PICK}), s AS (SELECT chosen.position, f.* FROM chosen JOIN f USING (rank)),
x AS (SELECT {_TOPIC_NAMES} AS avail FROM f), y AS (SELECT {_TOPIC_NAMES} AS got, bool_or(position <> rank) AS moved, count(*) FILTER (rank > 12) AS promoted FROM s)
SELECT CASE WHEN len(got) < least(len(avail), 12) THEN 'applied_partial' WHEN moved THEN 'applied' ELSE 'already_satisfied' END AS status, len(avail) AS available_topic_count,
 array_to_string(got, ',') AS selected, array_to_string(list_filter(['pricing', 'bench', 'agents', 'none'], lambda v: NOT list_contains(avail, v)), ',') AS unavailable,
 array_to_string(list_filter(avail, lambda v: NOT list_contains(got, v)), ',') AS unselected, promoted AS promoted_count, moved AS reordered FROM x, y""")
def topic_spread_status(t):
    ranked = coverage.annotate(_ranked(t), TOPICS)
    status = curate.topic_spread(ranked, [x.topic_id for x in TOPICS], 12)[1]
    names = {"selected": "selected_topic_ids", "unavailable": "unavailable_topic_ids", "unselected": "unselected_available_topic_ids"}
    return status.select(
        "status",
        F.col("available_topic_count").cast("bigint").alias("available_topic_count"),
        *[F.array_join(column, ",").alias(name) for name, column in names.items()],
        F.col("promoted_count").cast("bigint").alias("promoted_count"),
        "reordered",
    )


# ---- judge -------------------------------------------------------------------------------------------------------


@query("judge_evidence", f"""WITH {_RANK_SQL} SELECT rank, id, left(text, 500) AS text_preview, author, CAST(quality_score AS DOUBLE) AS quality_score, 0 AS media_count FROM ranked WHERE rank <= 20""")
def judge_evidence(t):
    return judge.evidence(_ranked(t)).select("rank", "id", "text_preview", "author", "quality_score", "media_count")


@query("judge_handoff", f"""WITH {_RANK_SQL} SELECT r.rank, r.id, CASE WHEN l.doc_id IS NULL THEN 'unjudged' ELSE 'judged' END AS status,
 CASE WHEN l.doc_id IS NULL THEN 'fallback_keep' WHEN l.quality = 1 THEN 'keep' ELSE 'drop' END AS decision, l.doc_id IS NULL AS fallback_used
FROM ranked r LEFT JOIN labels l ON l.doc_id = r.ord""")
def judge_handoff(t):
    results = t.labels.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        F.when(F.col("quality") == 1, "keep").otherwise("drop").alias("decision"),
        F.lit(None).cast("double").alias("confidence"),
    )
    everything = _ranked(t)
    rows = judge.attach_results(everything.select("rank", "id"), results)
    return rows.select("rank", "id", "status", "decision", "fallback_used")


@query("judge_fallback", f"""WITH {_RANK_SQL} SELECT 'judge_result' AS record_type, 'unjudged' AS status, 'fallback_keep' AS decision, rank, id, 'judge_runner_not_configured' AS reason FROM ranked WHERE rank <= 20""")
def judge_fallback(t):
    rows = judge.fallback_rows(judge.evidence(_ranked(t)))
    return rows.select(
        "record_type", "status", "decision", F.col("candidate.rank").alias("rank"), F.col("candidate.id").alias("id"), F.get("reasons", F.lit(0)).alias("reason")
    )


# ---- whole plans -------------------------------------------------------------------------------------------------


@query("top_candidates", f"""WITH {SIGHT_SQL}, c AS (SELECT source_item_id, min(ord) AS first_ord, count(*) AS seen_in_count, arg_min(author, ord) AS author,
  arg_min(likes, ord) AS likes FROM sight GROUP BY 1), a AS (SELECT *, row_number() OVER (PARTITION BY lower(author) ORDER BY first_ord) AS n FROM c)
SELECT 'post:events:' || source_item_id AS candidate_key, first_ord, seen_in_count, author,
 round(CASE WHEN likes > 0 THEN least(log10(likes + 1), 4.0) ELSE 0 END, 3) AS engagement FROM a WHERE n <= 2 ORDER BY engagement DESC, first_ord LIMIT 20""")
def top_candidates(t):
    from siftstone.functions.values import engagement_score as points
    from siftstone.operators import dedupe

    kept = curate.post_filter(dedupe.dedupe(t.sightings(), "post").candidates, max_per_author=2).survivors
    value = F.round(F.least(points(F.col("engagement")), F.lit(4.0)), 3)
    ranked = kept.withColumn("engagement", value).orderBy(F.desc("engagement"), "first_ord").limit(20)
    return ranked.select("candidate_key", "first_ord", "seen_in_count", "author", "engagement")


@query("plan_candidates")
def plan_candidates_query(t):
    plan = plan_candidates(
        t.sightings(), by="post", limit=50, sort_by="quality_score", prefer_originals=True, drop_noise=True, drop_title_duplicates=True,
        max_per_author=5,
    )
    return plan.project(["id", "author", "seen_in_count", "intent", "quality_score", "candidate_key"])


@query("plan_candidates_on_posts")
def plan_candidates_on_posts(t):
    plan = plan_candidates(t.posts(), by="id", limit=100, sort_by="quality_score", drop_noise=True)
    return plan.project(["id", "author", "seen_in_count", "quality_score", "candidate_key"])


MISSION = Mission(
    target_posts=40, excluded_keywords=("coupon",), max_posts_per_author=4, max_posts_per_thread=2, require_topic_spread=True,
    require_query_match=False, topics=TOPICS,
)


@query("mission_ranked")
def mission_ranked(t):
    return curate_mission(t.posts(), MISSION).ranked.select("rank", "id", "author", "quality_score")


@query("mission_report")
def mission_report(t):
    return curate_mission(t.posts(), MISSION).report()


@query("mission_target")
def mission_target(t):
    out = curate_mission(t.posts(), MISSION).target()
    return out.withColumn("reasons", F.array_join("reasons", ","))


_HOT = "CASE WHEN event_id % 3 <> 0 THEN 'hot' WHEN event_id % 30 > 0 THEN concat('q', user_id % 10) END"


@query("mission_fair_share", f"""WITH s AS (SELECT event_id AS ord, {_HOT} AS query_id FROM events),
q AS (SELECT 'hot' AS query_id, CAST(NULL AS INT) AS own UNION ALL SELECT concat('q', n), CASE n WHEN 1 THEN 7 WHEN 2 THEN 30 END FROM range(9) t(n) UNION ALL SELECT 'never', NULL),
n AS (SELECT s.*, coalesce(own, CAST(ceil(100 / (SELECT count(*) FROM q)) AS INT)) AS share, row_number() OVER (PARTITION BY s.query_id ORDER BY ord) AS k FROM s JOIN q USING (query_id))
SELECT ord, query_id FROM n WHERE k <= share UNION ALL SELECT ord, query_id FROM s WHERE query_id IS NULL""")
def mission_fair_share(t):
    sightings = t.events.select(F.col("event_id").alias("ord"), F.expr(_HOT).alias("query_id"))
    planned = [("hot", None), ("never", None), *[(f"q{n}", {1: 7, 2: 30}.get(n)) for n in range(9)]]
    queries = t.spark.createDataFrame(planned, "query_id string, limit int")
    return Mission(target_posts=100).fair_share(sightings, queries)


GAPS = Mission(
    target_posts=60, require_query_match=False, quality_profile="recall", languages=("en",), objective="latency", max_gap_queries=3, max_posts_per_author=None,
    topics=(coverage.Topic("coupons", "Coupons", ("coupon",), ("coupon", "shop"), min_posts=6), coverage.Topic("none", "none", ("zzqx",), ("zzqx",)),
            coverage.Topic("tests", "Tests", ("latency",), min_posts=3)),
)


@query("mission_with_gap_fill")
def mission_with_gap_fill(t):
    """Collected so far: posts of the documents that follow someone; everything can be searched."""
    posts = t.posts()
    return fill_gaps(posts.where(F.contains("text", F.lit("follow @one"))), posts, GAPS).gaps()
