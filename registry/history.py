"""Deduplication queries: keys, merged candidates, sightings, alternates, tokens, label counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftstone.operators import curate, dedupe

from .base import POSTS_SQL, SIGHT_SQL, canonical_sql, fold, query


def _key_query(name: str, by: str, key_sql: str, table: str = "sight"):
    sql = f"""WITH {SIGHT_SQL}, k AS (SELECT *, {key_sql} AS candidate_key FROM sight)
SELECT candidate_key, min(ord) AS first_ord, count(*) AS seen_in_count, arg_min(id, ord) AS id, arg_min(author, ord) AS author,
 (array_agg(intent ORDER BY ord) FILTER (WHERE intent IS NOT NULL))[1] AS intent,
 (array_agg(source_role ORDER BY ord) FILTER (WHERE source_role IS NOT NULL))[1] AS source_role
FROM k WHERE candidate_key IS NOT NULL GROUP BY candidate_key"""

    @query(name, sql)
    def run(t):
        found = dedupe.dedupe(t.sightings(), by).candidates
        return found.select("candidate_key", "first_ord", "seen_in_count", "id", "author", "intent", "source_role")

    return run


_URL = canonical_sql("url")
_HOST = "lower(regexp_extract(url, '://([^/?#]*)', 1))"
_key_query("dedupe_by_url", "url", f"coalesce('url:' || {_URL}, 'id:events:' || id)")
_key_query("dedupe_by_normalized_url", "normalized_url", f"'normalized_url:' || {_URL}")
_key_query("dedupe_by_id", "id", "'id:events:' || id")
_key_query("dedupe_by_source_item_id", "source_item_id", "'source_item_id:events:' || source_item_id")
_key_query("dedupe_by_domain", "domain", f"'domain:' || {_HOST}")
_key_query("dedupe_by_author", "author", "'author:events:' || author")
_key_query("dedupe_by_post", "post", "'post:events:' || source_item_id")

_RANKED = f"""WITH {SIGHT_SQL}, k AS (SELECT *, 'post:events:' || source_item_id AS candidate_key,
  CASE kind WHEN 'original' THEN 0 WHEN 'quote' THEN 1 WHEN 'reply' THEN 2 WHEN 'retweet' THEN 3 ELSE 4 END AS r FROM sight),
p AS (SELECT *, min(r) OVER (PARTITION BY candidate_key ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM k),
w AS (SELECT *, best_before IS NULL OR r < best_before AS wins FROM p)"""


@query("prefer_originals", _RANKED + """ SELECT candidate_key, min(ord) AS first_ord, count(*) AS seen_in_count,
 arg_max(author, ord) FILTER (WHERE wins) AS author, arg_max(url, ord) FILTER (WHERE wins) AS url,
 coalesce(arg_max(intent, ord) FILTER (WHERE wins AND intent IS NOT NULL), arg_min(intent, ord) FILTER (WHERE intent IS NOT NULL)) AS intent,
 coalesce(arg_max(source_role, ord) FILTER (WHERE wins AND source_role IS NOT NULL), arg_min(source_role, ord) FILTER (WHERE source_role IS NOT NULL)) AS source_role
FROM w GROUP BY candidate_key""")
def prefer_originals(t):
    found = dedupe.dedupe(t.sightings(), "post", True).candidates
    return found.select("candidate_key", "first_ord", "seen_in_count", "author", "url", "intent", "source_role")


@query("alternate_urls", f"""WITH {SIGHT_SQL}, f AS (SELECT source_item_id, arg_min(url, ord) AS shown FROM sight GROUP BY 1)
SELECT 'post:events:' || s.source_item_id AS candidate_key, s.url, min(s.ord) AS ord FROM sight s JOIN f USING (source_item_id)
WHERE s.url <> f.shown GROUP BY ALL""")
def alternate_urls(t):
    return dedupe.dedupe(t.sightings(), "post").alternate_urls.select("candidate_key", "url", "ord")


@query("alternate_urls_with_promotion", _RANKED + """, s AS (SELECT *, max(CASE WHEN wins THEN ord END) OVER (PARTITION BY candidate_key ORDER BY ord
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS shown_ord FROM w)
SELECT s.candidate_key, s.url, min(s.ord) AS ord FROM s JOIN w ON w.candidate_key = s.candidate_key AND w.ord = s.shown_ord
WHERE s.url <> w.url GROUP BY ALL""")
def alternate_urls_with_promotion(t):
    return dedupe.dedupe(t.sightings(), "post", True).alternate_urls.select("candidate_key", "url", "ord")


@query("sightings", f"""WITH {SIGHT_SQL} SELECT 'post:events:' || source_item_id AS candidate_key, ord, run_id, channel, operation, input,
 id AS item_id, url, intent, query_id, source_role FROM sight""")
def sightings(t):
    return dedupe.dedupe(t.sightings(), "post").sightings


@query("sighting_pages", f"""WITH {SIGHT_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY source_item_id ORDER BY ord) AS n FROM sight)
SELECT 'post:events:' || source_item_id AS candidate_key, (n - 1) // 50 AS page, count(*) AS size, min(n) AS first_n,
 arg_min(run_id || '/' || query_id, n) AS first_seen, md5(string_agg(run_id || query_id, ',' ORDER BY n)) AS digest FROM n GROUP BY ALL""")
def sighting_pages(t):
    pages = dedupe.dedupe(t.sightings(), "post").sighting_pages(50)
    joined = F.array_join(F.transform("seen_in", lambda s: F.concat(s["run_id"], s["query_id"])), ",")
    first = F.get("seen_in", F.lit(0))
    return pages.select(
        "candidate_key",
        F.col("page").cast("bigint").alias("page"),
        F.size("seen_in").cast("bigint").alias("size"),
        first["n"].alias("first_n"),
        F.concat_ws("/", first["run_id"], first["query_id"]).alias("first_seen"),
        F.md5(joined.cast("binary")).alias("digest"),
    )


@query("merged_query_tokens", f"""WITH {SIGHT_SQL}, x AS (SELECT DISTINCT source_item_id, user_q FROM (SELECT source_item_id, input AS user_q FROM sight WHERE operation = 'search')),
tok AS (SELECT source_item_id, unnest(CASE user_q WHEN 'pricing feedback' THEN ['pricing','feedback'] WHEN 'baseline workflow' THEN ['baseline','workflow']
  WHEN 'latency lang:en' THEN ['latency'] WHEN '"codex" agent' THEN ['codex','agent'] ELSE ['zzqx','unmatched'] END) AS token FROM x)
SELECT DISTINCT 'post:events:' || source_item_id AS candidate_key, token FROM tok""")
def merged_query_tokens(t):
    return dedupe.dedupe(t.sightings(), "post").query_tokens


@query("candidate_query_hits", f"""WITH {SIGHT_SQL}, x AS (SELECT DISTINCT source_item_id, input AS user_q FROM sight WHERE operation = 'search'),
tok AS (SELECT DISTINCT source_item_id, unnest(CASE user_q WHEN 'pricing feedback' THEN ['pricing','feedback'] WHEN 'baseline workflow' THEN ['baseline','workflow']
  WHEN 'latency lang:en' THEN ['latency'] WHEN '"codex" agent' THEN ['codex','agent'] ELSE ['zzqx','unmatched'] END) AS token FROM x),
c AS (SELECT source_item_id, {fold("concat_ws(' ', arg_min(text, ord), arg_min(author, ord), arg_min(url, ord))")} AS h FROM sight GROUP BY 1)
SELECT 'post:events:' || c.source_item_id AS candidate_key, count(token) AS tokens, count(*) FILTER (WHERE contains(h, token)) AS hits
FROM c LEFT JOIN tok USING (source_item_id) GROUP BY ALL""")
def candidate_query_hits(t):
    d = dedupe.dedupe(t.sightings(), "post")
    hits = dedupe.with_token_hits(d.candidates, d.query_tokens)
    return hits.select(
        "candidate_key",
        F.col("query_token_count").cast("bigint").alias("tokens"),
        F.col("query_token_hits").cast("bigint").alias("hits"),
    )


@query("label_counts", f"""WITH {SIGHT_SQL} SELECT 'channel' AS dimension, 'events' AS label, count(DISTINCT source_item_id) AS count FROM sight
UNION ALL SELECT 'source_role', source_role, count(DISTINCT source_item_id) FROM sight WHERE source_role IS NOT NULL GROUP BY 2
UNION ALL SELECT 'intent', intent, count(DISTINCT source_item_id) FROM sight WHERE intent IS NOT NULL GROUP BY 2""")
def label_counts(t):
    return dedupe.dedupe(t.sightings(), "post").label_counts()


@query("candidate_summary", f"""WITH {SIGHT_SQL}, k AS (SELECT {_URL} AS u FROM sight), g AS (SELECT u, count(*) AS n FROM k GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS items_seen, CAST(coalesce(sum(n) FILTER (WHERE u IS NULL), 0) AS BIGINT) AS skipped_items,
 count(*) FILTER (WHERE u IS NOT NULL) AS candidate_count, count(*) FILTER (WHERE u IS NOT NULL AND n > 1) AS multi_seen_candidates,
 CAST(max(n) FILTER (WHERE u IS NOT NULL) AS BIGINT) AS max_seen_in FROM g""")
def candidate_summary(t):
    return dedupe.dedupe(t.sightings(), "normalized_url").summary()


def _posts_as_candidates(t):
    return t.posts().withColumns(
        {"candidate_key": F.col("id"), "first_ord": F.col("ord"), "seen_in_count": (F.col("ord") % 3 + 1).cast("bigint")}
    )


_FILTER_SQL = f"""WITH {POSTS_SQL}, s AS (SELECT *, ord % 3 + 1 AS seen, trim(regexp_replace({fold('title')}, '\\s+', ' ', 'g')) AS tk FROM posts),
a AS (SELECT *, CASE WHEN length(tk) = 0 OR (length(tk) < 24 AND len(string_split(tk, ' ')) < 4) THEN chr(1) || id ELSE tk END AS tkey FROM s WHERE seen >= 2),
b AS (SELECT *, row_number() OVER (PARTITION BY tkey ORDER BY ord) AS tn FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY lower(author) ORDER BY ord) AS an FROM b WHERE tn = 1)"""


@query("post_filter", _FILTER_SQL + "SELECT ord, author FROM c WHERE an <= 7")
def post_filter(t):
    kept = curate.post_filter(_posts_as_candidates(t), min_seen_in=2, drop_title_duplicates=True, max_per_author=7)
    return kept.survivors.select("ord", "author")


@query("post_filter_drop_counts", _FILTER_SQL + """SELECT 'seen_in' AS reason, count(*) AS count FROM s WHERE seen < 2
UNION ALL SELECT 'title_duplicate', count(*) FROM b WHERE tn > 1 HAVING count(*) > 0
UNION ALL SELECT 'author_cap', count(*) FROM c WHERE an > 7 HAVING count(*) > 0""")
def post_filter_drop_counts(t):
    return curate.post_filter(_posts_as_candidates(t), min_seen_in=2, drop_title_duplicates=True, max_per_author=7).drop_counts


@query("author_cap", f"""WITH {POSTS_SQL}, c AS (SELECT ord, author, row_number() OVER (PARTITION BY lower(author) ORDER BY ord) AS an FROM posts)
SELECT ord, author FROM c WHERE an <= 2""")
def author_cap(t):
    return curate.post_filter(_posts_as_candidates(t), max_per_author=2).survivors.select("ord", "author")


@query("title_dedupe", _FILTER_SQL.replace("WHERE seen >= 2", "") + "SELECT ord, title FROM b WHERE tn = 1")
def title_dedupe(t):
    return curate.post_filter(_posts_as_candidates(t), drop_title_duplicates=True).survivors.select("ord", "title")


@query("min_seen_in", f"""WITH {SIGHT_SQL} SELECT 'author:events:' || author AS candidate_key, count(*) AS seen_in_count FROM sight
GROUP BY 1 HAVING count(*) >= 60""")
def min_seen_in(t):
    kept = curate.post_filter(dedupe.dedupe(t.sightings(), "author").candidates, min_seen_in=60)
    return kept.survivors.select("candidate_key", "seen_in_count")
