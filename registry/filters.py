"""Filter queries: metric floors, noise, promo, query match, quality backfill, topic rules, searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftstone.functions import text as T
from siftstone.operators import curate, noise, search
from siftstone.operators import topic_fit as tf

from .base import MARKED_SQL, POSTS_SQL, fold, query

# text with non-ASCII letters as '_' so that the SQL engine's ASCII word boundaries agree with Unicode ones
MASK = "regexp_replace({0}, '[^\\x00-\\x7F]', '_', 'g')"
# fixed values: the promotion phrases, plainly, as the SQL engine has no such list
PROMO_TEXTS = (
    "airdrop", "giveaway", "sponsored", "affiliate", "referral", "promo code", "coupon", "discount", "shop now", "buy now", "order now",
    "use code", "link in bio", "merch", "storefront", "invite code", "dm me", "dm us", "follow back", "whitelist", "mint live", "プレゼント企画",
)
PROMO = "(" + " OR ".join(f"contains(f, '{p}')" for p in PROMO_TEXTS) + ")"


def squeezed(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


def counts_sql(text: str, urls: str = "0") -> str:
    """Structural counts of a masked text expression; the leading boundary is a non-word character or the start."""
    m = MASK.format(text)
    return f"""len(regexp_extract_all({m}, '(^|[^A-Za-z0-9_])#[A-Za-z0-9_]')) AS hashtags,
  len(regexp_extract_all({m}, '(^|[^A-Za-z0-9_])\\$[A-Za-z]')) AS cashtags,
  len(regexp_extract_all({m}, '(^|[^A-Za-z0-9_])@[A-Za-z0-9_]')) AS mentions,
  greatest(len(regexp_extract_all({text}, '(?i)(https?://|www\\.|t\\.co/)\\S+')), {urls}) AS urls"""


NOISE_SQL = "(hashtags >= 5 OR cashtags >= 3 OR mentions >= 4 OR urls >= 2)"


@query(
    "metric_filters",
    """WITH r AS (SELECT event_type, value, list_filter([CASE WHEN floor(value * 10) < 100 THEN 'min_likes' END,
  CASE WHEN floor(value) < 5 THEN 'min_retweets' END, CASE WHEN floor(value * 100) < 1500 THEN 'min_views' END], lambda x: x IS NOT NULL) AS reasons FROM events)
SELECT event_type, coalesce(reason, 'kept') AS reason, count(*) AS n
FROM (SELECT event_type, unnest(CASE WHEN len(reasons) = 0 THEN ['kept'] ELSE reasons END) AS reason FROM r) GROUP BY ALL""",
)
def metric_filters(t):
    e = t.events.select(
        "event_type",
        F.create_map(
            F.lit("likes"), F.floor(F.col("value") * 10).cast("double"), F.lit("retweets"), F.floor("value").cast("double"),
            F.lit("views"), F.floor(F.col("value") * 100).cast("double"),
        ).alias("engagement"),
    )
    reasons = noise.metric_reasons(F.col("engagement"), min_likes=100, min_retweets=5, min_views=1500)
    marked = e.select("event_type", F.when(F.size(reasons) == 0, F.array(F.lit("kept"))).otherwise(reasons).alias("reasons"))
    return marked.select("event_type", F.explode("reasons").alias("reason")).groupBy("event_type", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("structural_noise", f"""WITH {MARKED_SQL}, c AS (SELECT doc_id, {counts_sql('text')} FROM marked)
SELECT doc_id, hashtags, cashtags, mentions, urls, {NOISE_SQL} AS noisy FROM c""")
def structural_noise(t):
    counts = noise.structural_counts(F.col("text"))
    return t.marked().select(
        "doc_id", *[c.cast("bigint").alias(n) for n, c in counts.items()], noise.structural_noise(F.col("text")).alias("noisy")
    )


@query("promo_and_low_content", f"""WITH {MARKED_SQL}, l AS (SELECT doc_id, text AS line, doc_id % 3 = 0 AS quote FROM marked
  UNION ALL SELECT doc_id, split_part(text, ' ', 1) || ':' AS line, doc_id % 3 = 0 FROM marked),
s AS (SELECT doc_id, quote, {squeezed('line')} AS q, {fold('line')} AS f FROM l)
SELECT doc_id, {PROMO} AS promo, length(q) <= 12 OR (quote AND len(string_split(q, ' ')) <= 8 AND ends_with(q, ':')) AS thin, count(*) AS n
FROM s GROUP BY ALL""")
def promo_and_low_content(t):
    kind = F.when(F.col("doc_id") % 3 == 0, "quote").otherwise("original").alias("kind")
    m = t.marked().withColumn("kind", kind)
    stub = F.concat(F.split_part("text", F.lit(" "), F.lit(1)), F.lit(":"))
    lines = m.select("doc_id", "kind", F.explode(F.array("text", stub)).alias("line"))
    return (
        lines.select("doc_id", noise.promo_phrase(F.col("line")).alias("promo"), noise.low_content(F.col("line"), F.col("kind")).alias("thin"))
        .groupBy("doc_id", "promo", "thin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


TOKENS = ["pricing", "baseline", "codex", "order"]


@query("query_match", f"""WITH {MARKED_SQL}, h AS (SELECT doc_id, {fold("concat(text, ' ', author)")} AS h FROM marked)
SELECT doc_id, array_to_string(list_filter(['pricing', 'baseline', 'codex', 'order'], lambda x: contains(h, x)), ',') AS matched FROM h""")
def query_match(t):
    hay = T.casefold(T.joined(F.col("text"), F.col("author")))
    toks = F.array(*[F.lit(x) for x in TOKENS])
    return t.marked().withColumn("h", hay).select("doc_id", F.array_join(T.shared_parts(F.col("h"), toks), ",").alias("matched"))


REASONS_SQL = f"""j AS (SELECT *, list_filter([CASE WHEN kind = 'retweet' THEN 'retweet' END, CASE WHEN kind = 'reply' THEN 'reply' END,
  CASE WHEN miss THEN 'query_miss' END, CASE WHEN {NOISE_SQL} THEN 'structural_noise' END, CASE WHEN {PROMO} THEN 'promo_phrase' END,
  CASE WHEN NOT (coalesce(views, 0) >= 1000 OR coalesce(likes, 0) >= 25 OR coalesce(retweets, 0) >= 5) THEN 'engagement_gate' END], lambda x: x IS NOT NULL) AS reasons FROM c)"""
QUALITY_SQL = f"""WITH {POSTS_SQL}, c AS (SELECT *, {counts_sql('text', 'CASE WHEN url IS NULL THEN 0 ELSE 1 END')}, {fold('text')} AS f,
  NOT contains({fold("concat(text, ' ', author, ' ', coalesce(url, ''))")}, 'e') AS miss FROM posts), {REASONS_SQL},
k AS (SELECT *, CASE WHEN len(reasons) = 0 THEN 0 WHEN reasons = ['engagement_gate'] THEN 1 ELSE 2 END AS class FROM j),
n AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY class, ord) AS position,
  count(*) FILTER (WHERE class = 0) OVER (PARTITION BY author) AS clean FROM k WHERE class < 2)"""


def _quality(t):
    posts = t.posts().withColumn("query_tokens", F.array(F.lit("e")))
    return noise.QualityFilter(posts, query="author", order="ord", limit=10)


@query("quality_backfill", QUALITY_SQL + "SELECT author, ord, position, class = 1 AS backfilled FROM n WHERE position <= 10")
def quality_backfill(t):
    return _quality(t).kept.select("author", "ord", F.col("position").cast("bigint").alias("position"), "backfilled")


@query("quality_drop_counts", QUALITY_SQL + """, d AS (SELECT author, unnest(reasons) AS reason FROM k WHERE class = 2
  UNION ALL SELECT author, 'engagement_gate' FROM n WHERE class = 1 AND position > 10)
SELECT author, reason, count(*) AS count FROM d GROUP BY ALL""")
def quality_drop_counts(t):
    return _quality(t).drop_counts


@query("item_quality", QUALITY_SQL + "SELECT ord, array_to_string(reasons, ',') AS reasons FROM k")
def item_quality(t):
    posts = t.posts().withColumn("query_tokens", F.array(F.lit("e")))
    miss = ~noise.query_hit(noise.collected_parts(), F.col("query_tokens"))
    reasons = noise.noise_reasons(
        text=F.col("text"), urls=F.col("urls"), kind=F.col("timeline_item_kind"), query_miss=miss,
        engagement=F.col("engagement"), profile="balanced", drop_retweets=True, drop_replies=True,
    )
    return posts.select("ord", F.array_join(reasons, ",").alias("reasons"))


@query("drop_samples", QUALITY_SQL + """, x AS (SELECT unnest(reasons) AS reason, id, ord FROM k),
 r AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY ord) AS sample FROM x) SELECT reason, id, sample FROM r WHERE sample <= 5""")
def drop_samples(t):
    posts = t.posts().withColumn("query_tokens", F.array(F.lit("e")))
    miss = ~noise.query_hit(noise.collected_parts(), F.col("query_tokens"))
    reasons = noise.noise_reasons(
        text=F.col("text"), urls=F.col("urls"), kind=F.col("timeline_item_kind"), query_miss=miss,
        engagement=F.col("engagement"), profile="balanced", drop_retweets=True, drop_replies=True,
    )
    rows = posts.select("id", "ord", F.explode(reasons).alias("reason"))
    return noise.first_samples(rows, "reason", "ord", 5).select("reason", "id", F.col("sample").cast("bigint").alias("sample"))


@query("excluded_keywords", f"""WITH {POSTS_SQL}, h AS (SELECT author, {fold("concat(title, ' ', text, ' ', author)")} AS h FROM posts)
SELECT author, contains(h, 'coupon') OR contains(h, 'codex') AS dropped, count(*) AS n FROM h GROUP BY ALL""")
def excluded_keywords(t):
    kept, dropped = curate.drop_keywords(t.posts(), ["Coupon", "codex", " "])
    both = kept.select("author", F.lit(False).alias("dropped")).unionByName(dropped.select("author", F.lit(True).alias("dropped")))
    return both.groupBy("author", "dropped").agg(F.count(F.lit(1)).alias("n"))


# ---- inline grammar and searches ---------------------------------------------------------------------------------

_INLINE = """concat('Model x:y from:', source, ' Lang:', lang, CASE WHEN doc_id % 2 = 0 THEN ' has:links has:media' ELSE ' since:' END,
 ' min_likes:', CAST(doc_id % 50 AS {0}), CASE WHEN doc_id % 3 = 0 THEN ' min-likes:7' ELSE '' END, ' type:top')"""


@query("inline_query_grammar", """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'given' ELSE source END AS from_user, lang, 'top' AS search_type,
 CASE WHEN doc_id % 3 = 0 THEN 7 ELSE doc_id % 50 END AS min_likes,
 CASE WHEN doc_id % 2 = 0 THEN 'links,media' ELSE '' END AS has, CASE WHEN doc_id % 2 = 0 THEN 'Model x:y' ELSE 'Model x:y since:' END AS words FROM documents""")
def inline_query_grammar(t):
    q = t.documents.select(
        "doc_id", F.expr(_INLINE.format("STRING")).alias("query"), F.when(F.col("doc_id") % 5 == 0, "given").alias("from_user")
    )
    p = search.parse_inline(q)
    return p.select(
        "doc_id", "from_user", "lang", "search_type", "min_likes", F.coalesce(F.array_join("has", ","), F.lit("")).alias("has"), "words"
    )


@query("search_filter", f"""WITH {POSTS_SQL} SELECT ord, author FROM posts
WHERE published_ts >= TIMESTAMP '2024-01-01 12:00:00' AND published_ts < TIMESTAMP '2024-01-20 00:00:00' AND lang = 'en'
 AND url IS NOT NULL AND kind IS DISTINCT FROM 'retweet' AND kind IS DISTINCT FROM 'reply' AND likes >= 20""")
def search_filter(t):
    found = search.search_filter(
        t.posts(), since="2024-01-01 12:00:00", until="2024-01-20", lang="en", has=["links"], exclude=["retweets", "replies"], min_likes=20
    )
    return found.select("ord", "author")


def _search_sql(name: str, where: str, order: str, limit: int) -> str:
    """Pool in result order, quality reasons, backfill: the CTEs of one search, ending in one named ``name``."""
    pool = f"""SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM posts WHERE kind IS DISTINCT FROM 'retweet' AND kind IS DISTINCT FROM 'reply'
   AND {where} ORDER BY place LIMIT {3 * limit}"""
    return f"""SELECT ord, place, class FROM (WITH pool AS ({pool}),
c AS (SELECT *, {counts_sql('text', 'CASE WHEN url IS NULL THEN 0 ELSE 1 END')}, {fold('text')} AS f, false AS miss FROM pool), {REASONS_SQL},
k AS (SELECT *, CASE WHEN len(reasons) = 0 THEN 0 WHEN reasons = ['engagement_gate'] THEN 1 ELSE 2 END AS class FROM j)
SELECT ord, place, class FROM k WHERE class < 2 ORDER BY class, place LIMIT {limit}) {name}"""


_TOP, _LATEST = "coalesce(likes, 0) DESC, ord", "published_ts DESC NULLS LAST, ord"


@query("search_posts", f"""WITH {POSTS_SQL} SELECT ord, place AS search_rank, class = 1 AS backfilled FROM ({_search_sql('s', f"contains({fold('text')}, 'workflow')", _TOP, 10)})""")
def search_posts(t):
    kept = search.search_posts(t.posts(), "workflow", limit=10).kept
    return kept.select("ord", F.col("search_rank").cast("bigint").alias("search_rank"), "backfilled")


@query("search_inline", f"""WITH {POSTS_SQL} SELECT ord, place AS search_rank, unbounded FROM (
 SELECT *, false AS unbounded FROM ({_search_sql('s', f"contains({fold('text')}, 'workflow') AND contains({fold('text')}, 'logs') AND lang = 'en' AND likes >= 20 AND published_ts >= TIMESTAMP '2024-01-01 00:00:00'", _LATEST, 10)}))""")
def search_inline(t):
    kept = search.search_posts(t.posts(), "workflow lang:en min_likes:20 since:2024-01-01 TYPE:latest logs", limit=10).kept
    return kept.select("ord", F.col("search_rank").cast("bigint").alias("search_rank"), F.col("unbounded_time_window").alias("unbounded"))


@query("search_from_user", f"""WITH {POSTS_SQL} SELECT ord, place AS search_rank FROM ({_search_sql('s', f"lower(author) = 'src0' AND contains({fold('text')}, 'workflow')", _TOP, 10)})""")
def search_from_user(t):
    kept = search.search_posts(t.posts(), "workflow from:@SRC0", limit=10).kept
    return kept.select("ord", F.col("search_rank").cast("bigint").alias("search_rank"))


@query("search_many_queries", f"""WITH {POSTS_SQL} SELECT 'workflow' AS query_id, ord, place AS search_rank FROM ({_search_sql('a', f"contains({fold('text')}, 'workflow')", _TOP, 10)})
UNION ALL SELECT 'latency type:latest', ord, place FROM ({_search_sql('b', f"contains({fold('text')}, 'latency')", _LATEST, 10)})
UNION ALL SELECT 'nothing:here latency', ord, place FROM ({_search_sql('c', f"contains({fold('text')}, 'nothing:here')", _TOP, 10)})""")
def search_many_queries(t):
    kept = search.search_many(t.posts(), ["workflow", "latency type:latest", "nothing:here latency"], limit=10).kept
    return kept.select("query_id", "ord", F.col("search_rank").cast("bigint").alias("search_rank"))


@query("hashtag_posts", f"""WITH {MARKED_SQL} SELECT doc_id AS ord FROM marked
WHERE regexp_matches({MASK.format(fold('text'))}, '(^|[^A-Za-z0-9_])#c($|[^A-Za-z0-9_])')""")
def hashtag_posts(t):
    return search.hashtag_posts(t.marked().withColumnRenamed("doc_id", "ord"), "#C").select("ord")


@query("user_timelines", f"""WITH {POSTS_SQL}, m AS (SELECT * FROM posts WHERE kind IS DISTINCT FROM 'retweet' AND coalesce(likes, 0) >= 30),
c AS (SELECT *, {counts_sql('text', 'CASE WHEN url IS NULL THEN 0 ELSE 1 END')}, {fold('text')} AS f, false AS miss FROM m
  WHERE NOT contains({fold("concat(text, ' ', author, ' ', coalesce(url, ''))")}, 'shop')),
{REASONS_SQL.replace("CASE WHEN kind = 'reply' THEN 'reply' END,", "")},
k AS (SELECT *, CASE WHEN len(reasons) = 0 THEN 0 WHEN reasons = ['engagement_gate'] THEN 1 ELSE 2 END AS class FROM j),
n AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY class, ord) AS position FROM k WHERE class < 2)
SELECT author, ord, position FROM n WHERE position <= 5""")
def user_timelines(t):
    rules = tf.TopicRules.of({"excluded_terms": ["shop"]})
    chosen, _ = search.user_posts(t.posts(), min_likes=30, rules=rules, limit=5)
    return chosen.kept.select("author", "ord", F.col("position").cast("bigint").alias("position"))


@query("user_timeline_drops", f"""WITH {POSTS_SQL}, m AS (SELECT * FROM posts WHERE kind IS DISTINCT FROM 'retweet')
SELECT author, CASE WHEN coalesce(likes, 0) < 30 THEN 'min_likes' ELSE 'topic_fit_excluded_term' END AS reason, count(*) AS count FROM m
WHERE coalesce(likes, 0) < 30 OR contains({fold("concat(text, ' ', author, ' ', coalesce(url, ''))")}, 'shop') GROUP BY ALL""")
def user_timeline_drops(t):
    rules = tf.TopicRules.of({"excluded_terms": ["shop"]})
    return search.user_posts(t.posts(), min_likes=30, rules=rules, limit=5)[1]


@query("profiles", """SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def profiles(t):
    accounts = t.customer.select("c_custkey", "c_name", F.concat(F.lit("Acct"), F.col("c_custkey").cast("string")).alias("handle"))
    asked = t.orders.where("o_orderstatus = 'P'").select(
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("@acct"), F.col("o_custkey").cast("string")))
        .otherwise(F.concat(F.lit("https://x.com/acct"), F.col("o_custkey").cast("string"), F.lit("?s=1")))
        .alias("name")
    )
    return search.profiles(accounts, asked).select("c_custkey", "c_name")


@query("threads", """SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')""")
def threads(t):
    c = t.conversations
    post = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    posts = c.select("conv_id", "turn", post.alias("id"), F.col("conv_id").cast("string").alias("conversation_id"))
    asked = c.where("role = 'system'").select(F.concat(F.lit("https://x.com/i/status/"), post).alias("post"))
    return search.threads(posts, asked).select("conv_id", "turn")


# ---- topic rules -------------------------------------------------------------------------------------------------

RULES = {
    "required_any_terms": ["agent", "workflow", "latency"],
    "required_all_terms": ["e"],
    "preferred_terms": ["baseline", "Pricing", "logs", "measured", "pricing"],
    "excluded_terms": ["coupon"],
    "exact_phrases": ["setup notes", "compared the baseline"],
    "negative_phrases": ["join us today"],
    "synonym_groups": [["workflow", "process"], ["codex", "assistant"], ["latency", "lag"]],
}
_hit = lambda *terms: "(" + " OR ".join(f"contains(h, '{x}')" for x in terms) + ")"
FIT_SQL = f"""h AS (SELECT *, {squeezed(fold("concat_ws(' ', coalesce(title,''), text, author, coalesce(url,''))"))} AS h FROM posts),
x AS (SELECT *, {_hit('agent', 'workflow', 'process', 'latency', 'lag')} AS any_hit, contains(h, 'e') AS all_hit,
  {_hit('baseline')}::INT + {_hit('pricing')}::INT + {_hit('logs')}::INT + {_hit('measured')}::INT AS pref,
  {_hit('coupon')} AS excl, {_hit('join us today')} AS neg,
  {_hit('setup notes')}::INT + {_hit('compared the baseline')}::INT AS phrases,
  {_hit('workflow', 'process')}::INT + {_hit('codex', 'assistant')}::INT + {_hit('latency', 'lag')}::INT AS syn FROM h),
fit AS (SELECT *, NOT excl AND NOT neg AND any_hit AND all_hit AS matched,
  list_filter([CASE WHEN excl THEN 'topic_fit_excluded_term' END, CASE WHEN neg THEN 'topic_fit_negative_phrase' END,
   CASE WHEN NOT any_hit THEN 'topic_fit_missing_required_any' END, CASE WHEN NOT all_hit THEN 'topic_fit_missing_required_all' END], lambda v: v IS NOT NULL) AS drops,
  list_filter([CASE WHEN any_hit THEN 'topic_fit_required_any' END, CASE WHEN all_hit THEN 'topic_fit_required_all' END,
   CASE WHEN pref > 0 THEN 'topic_fit_preferred' END, CASE WHEN phrases > 0 THEN 'topic_fit_exact_phrase' END, CASE WHEN syn > 0 THEN 'topic_fit_synonym_group' END], lambda v: v IS NOT NULL) AS hits,
  CASE WHEN any_hit THEN 2.0 ELSE 0 END + CASE WHEN all_hit THEN 1.0 ELSE 0 END + least(pref, 3) + least(phrases, 2) * 2.0 + least(syn, 3) * 0.75 AS bonus FROM x)"""


def evaluated(t):
    posts = t.posts().withColumn("urls", F.array().cast("array<string>"))
    # parts beyond those of the SQL are empty here, and the canonical URL only repeats the URL
    parts = [F.col("title"), F.col("text"), F.col("author"), F.col("url")]
    return tf.evaluate(posts, parts, tf.TopicRules.of(RULES))


@query("topic_fit", f"""WITH {POSTS_SQL}, {FIT_SQL}
SELECT ord, matched, array_to_string(drops, ',') AS drops, array_to_string(hits, ',') AS hits, CAST(bonus AS DOUBLE) AS bonus FROM fit""")
def topic_fit(t):
    f = F.col("topic_fit")
    return evaluated(t).select(
        "ord", f["matched"].alias("matched"), F.array_join(f["drop_reasons"], ",").alias("drops"),
        F.array_join(f["match_reasons"], ",").alias("hits"), f["score_bonus"].alias("bonus"),
    )


@query("topic_fit_summary", f"""WITH {POSTS_SQL}, {FIT_SQL}, r AS (SELECT 'total' AS section, 'evaluated' AS key, 1 AS n FROM fit
 UNION ALL SELECT 'total', CASE WHEN matched THEN 'matched' ELSE 'dropped' END, 1 FROM fit UNION ALL SELECT 'drop', unnest(drops), 1 FROM fit
 UNION ALL SELECT 'match', unnest(hits), 1 FROM fit UNION ALL SELECT 'missing', 'required_any_terms', 3 FROM fit WHERE NOT any_hit
 UNION ALL SELECT 'missing', 'required_all_terms', 1 FROM fit WHERE NOT all_hit)
SELECT section, key, CAST(sum(n) AS BIGINT) AS count FROM r GROUP BY ALL""")
def topic_fit_summary(t):
    return tf.summary(evaluated(t))


@query("topic_fit_many_rules", f"""WITH {MARKED_SQL}, h AS (SELECT doc_id, {squeezed(fold("concat(text, ' ', author)"))} AS h FROM marked)
SELECT doc_id, 'build' AS rule_set_id, {_hit('workflow', 'agent')} AS matched, CASE WHEN {_hit('workflow', 'agent')} THEN 2.0 ELSE 0.0 END AS bonus FROM h
UNION ALL SELECT doc_id, 'no_ads', NOT {_hit('coupon')}, 0.0 FROM h
UNION ALL SELECT doc_id, 'both', contains(h, 'pricing') AND contains(h, 'codex'), contains(h, 'pricing')::INT * 1.0 + contains(h, 'codex')::INT FROM h""")
def topic_fit_many_rules(t):
    sets = {
        "build": tf.TopicRules.of({"required_any_terms": ["workflow", "agent"]}),
        "no_ads": tf.TopicRules.of({"excluded_terms": ["coupon"]}),
        "both": tf.TopicRules.of({"required_all_terms": ["pricing", "codex"]}),
    }
    out = tf.evaluate_many(t.marked(), [F.col("text"), F.col("author")], sets)
    return out.select("doc_id", "rule_set_id", F.col("topic_fit.matched").alias("matched"), F.col("topic_fit.score_bonus").alias("bonus"))


