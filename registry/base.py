"""Input views shared by the registered queries, in Spark and as SQL common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions import text as T
from siftstone.operators.items import build_items
from siftstone.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL where SQL can say it over whole tables."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(configure(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


# text marker per document, so that text signals occur; written once for both engines
SUFFIX = """CASE doc_id % 8
    WHEN 0 THEN ' We tested v2.1 on 2026-04-10 and measured 37% less latency.'
    WHEN 1 THEN ' Shop now with coupon code DEV20, order today, link in bio.'
    WHEN 2 THEN ' #a #b #c #d #e follow @one @two'
    WHEN 3 THEN ' see https://example.com/a and https://example.com/b'
    WHEN 4 THEN ' Compared the baseline workflow with screenshots and logs.'
    WHEN 5 THEN ' introducing our new drop, join us today'
    WHEN 6 THEN ' pricing feedback: codex agent setup notes'
    ELSE '' END"""
KIND = """CASE event_type WHEN 'view' THEN 'original' WHEN 'click' THEN 'quote' WHEN 'purchase' THEN 'reply'
    WHEN 'signup' THEN 'retweet' END"""

MARKED_SQL = f"""marked AS (
  SELECT doc_id, lang, source AS author, concat(text, {SUFFIX}) AS text FROM documents)"""

# casefold for the characters of the test tables (sharp s is the only one lower() leaves alone)
FOLD = "replace(lower({0}), 'ß', 'ss')"


def fold(expr: str) -> str:
    return FOLD.format(expr)


POSTS_SQL = f"""{MARKED_SQL},
posts AS (
  SELECT m.doc_id AS ord, concat('d', CAST(m.doc_id AS VARCHAR)) AS id, m.author, m.lang, m.text, p.url,
    left(trim(list_filter(string_split(m.text, chr(10)), lambda x: length(trim(x)) > 0)[1]), 80) AS title,
    {KIND} AS kind, floor(e.value * 10) AS likes, floor(e.value) AS retweets, floor(e.value * 100) AS views,
    e.ts AS published_ts, strftime(e.ts, '%Y-%m-%dT%H:%M:%SZ') AS published_at,
    concat('c', CAST(e.user_id AS VARCHAR)) AS conversation_id
  FROM marked m LEFT JOIN pages p ON p.page_id = m.doc_id LEFT JOIN events e ON e.event_id = m.doc_id)"""

SIGHT_SQL = f"""{MARKED_SQL},
sight AS (
  SELECT e.event_id AS ord, concat('run-', CAST(e.event_id % 3 AS VARCHAR)) AS run_id, 'events' AS channel,
    CASE WHEN e.event_id % 7 = 0 THEN 'user_posts' ELSE 'search' END AS operation,
    concat('q', CAST(e.user_id % 10 AS VARCHAR)) AS query_id,
    CASE WHEN e.event_id % 4 = 0 THEN NULL ELSE concat('intent-', CAST(e.event_id % 5 AS VARCHAR)) END AS intent,
    CASE WHEN e.event_id % 6 = 0 THEN NULL ELSE concat('role-', CAST(e.event_id % 2 AS VARCHAR)) END AS source_role,
    CASE e.user_id % 10 WHEN 0 THEN 'pricing feedback' WHEN 1 THEN 'baseline workflow' WHEN 2 THEN 'latency lang:en'
      WHEN 3 THEN '"codex" agent' ELSE 'zzqx unmatched' END AS input,
    CAST(e.k AS VARCHAR) AS source_item_id, concat('d', CAST(e.k AS VARCHAR)) AS id,
    concat('user', CAST(e.user_id AS VARCHAR)) AS author, {KIND} AS kind, floor(e.value * 10) AS likes,
    strftime(e.ts, '%Y-%m-%dT%H:%M:%SZ') AS published_at, m.text, p.url
  FROM (SELECT *, event_id % (SELECT count(*) FROM documents) AS k FROM events) e
  LEFT JOIN marked m ON m.doc_id = e.k
  LEFT JOIN pages p ON p.page_id = (e.k + e.user_id) % (SELECT count(*) FROM pages))"""


def canonical_sql(url: str, collapse: bool = True) -> str:
    """Canonical form of an absolute URL in SQL."""
    host = f"lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
    if collapse:
        host = (
            f"CASE WHEN {host} IN ('twitter.com','www.twitter.com','mobile.twitter.com','www.x.com') THEN 'x.com' ELSE {host} END"
        )
    path = f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    q = f"regexp_extract({url}, '^[^?#]*([?][^#]*)', 1)"
    scheme = f"lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
    return (
        f"CASE WHEN {url} IS NULL THEN NULL ELSE {scheme} || '://' || {host} || "
        f"CASE WHEN {path} = '/' THEN '/' ELSE rtrim({path}, '/') END || CASE WHEN {q} = '?' THEN '' ELSE {q} END END"
    )


class Tables:
    """Driver tables of one scale, and the item views built from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def marked(self) -> DataFrame:
        return self.documents.select("doc_id", "lang", F.col("source").alias("author"), F.expr(f"concat(text, {SUFFIX})").alias("text"))

    def posts(self) -> DataFrame:
        """Documents as posts, with metrics and time from the event of the same number and the page's URL."""
        e = self.events.select(
            F.col("event_id").alias("doc_id"),
            F.expr(KIND).alias("timeline_item_kind"),
            F.floor(F.col("value") * 10).cast("double").alias("likes"),
            F.floor("value").cast("double").alias("retweets"),
            F.floor(F.col("value") * 100).cast("double").alias("views"),
            F.col("ts").alias("published_ts"),
            F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("conversation_id"),
        )
        p = self.pages.select(F.col("page_id").alias("doc_id"), "url")
        joined = self.marked().join(p, "doc_id", "left").join(e, "doc_id", "left")
        pairs = [part for n in ("likes", "retweets", "views") for part in (F.lit(n), F.col(n))]
        items = joined.select(
            F.col("doc_id").alias("ord"),
            F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
            F.lit("post").alias("kind"),
            T.derive_title(F.col("text")).alias("title"),
            "url",
            "text",
            "author",
            "lang",
            F.date_format("published_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"),
            "published_ts",
            F.lit("documents").alias("source"),
            F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("engagement"),
            "timeline_item_kind",
            "conversation_id",
            F.array_compact(F.array("url")).alias("urls"),
        )
        return build_items(items)

    def sightings(self) -> DataFrame:
        """Events as sightings, dealt over all documents and pages."""
        n_docs, n_pages = max(self.documents.count(), 1), max(self.pages.count(), 1)
        e = self.events.withColumn("k", F.col("event_id") % n_docs).withColumn("page_id", (F.col("k") + F.col("user_id")) % n_pages)
        docs = self.marked().select(F.col("doc_id").alias("k"), "text")
        # texts come last: a join behind them would move them again, once per sighting
        rows = e.join(self.pages.select("page_id", "url"), "page_id", "left").join(docs, "k", "left")
        text = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
        n = F.col("event_id")
        topic = F.col("user_id") % 10
        items = rows.select(
            n.alias("ord"),
            F.concat(F.lit("run-"), (n % 3).cast("string")).alias("run_id"),
            F.lit("events").alias("channel"),
            F.when(n % 7 == 0, F.lit("user_posts")).otherwise(F.lit("search")).alias("operation"),
            F.concat(F.lit("q"), topic.cast("string")).alias("query_id"),
            F.when(n % 4 != 0, F.concat(F.lit("intent-"), (n % 5).cast("string"))).alias("intent"),
            F.when(n % 6 != 0, F.concat(F.lit("role-"), (n % 2).cast("string"))).alias("source_role"),
            F.when(topic == 0, "pricing feedback")
            .when(topic == 1, "baseline workflow")
            .when(topic == 2, "latency lang:en")
            .when(topic == 3, '"codex" agent')
            .otherwise("zzqx unmatched")
            .alias("input"),
            F.col("k").cast("string").alias("source_item_id"),
            text("d", "k").alias("id"),
            F.lit("post").alias("kind"),
            T.derive_title(F.col("text")).alias("title"),
            text("user", "user_id").alias("author"),
            F.expr(KIND).alias("timeline_item_kind"),
            F.create_map(F.lit("likes"), F.floor(F.col("value") * 10).cast("double")).alias("engagement"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"),
            F.col("ts").alias("published_ts"),
            "text",
            "url",
            F.lit("events").alias("source"),
        )
        tokens = F.when(F.col("operation") == "search", T.query_tokens(F.col("input"))).otherwise(F.array().cast("array<string>"))
        items = items.withColumn("query_tokens", tokens)
        # the identity here is the post number, not the item id
        return build_items(items.withColumn("identifiers", F.create_map(F.lit("post_id"), F.col("source_item_id"))))
