"""Corpus preparation in stages: quality, near duplicates, decontamination, mixing, sharding.

Each stage takes the documents its predecessor kept and returns documents; the last one adds ``shard``. Between stages the rows are written and read again,
so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone.llm.decontam import decontaminate
from siftstone.llm.mixing import mixture
from siftstone.llm.near import near_duplicates
from siftstone.llm.quality import importance_sample
from siftstone.llm.sharding import assign_shards
from siftstone.plans.skew import durable
from siftstone.session import configure

SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the good labels takes."""
    return importance_sample(docs, _table(spark, sf_dir, "labels")).where("kept").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more), the one of least id; rows without id stay.

    Of rows with one id the first by their content stays (columns that cannot be ordered left aside).
    """
    configure(spark)
    dropped = durable(near_duplicates(docs, shingle=5).where("NOT kept").select(F.col("doc_id").alias("__dropped")), "dropped")
    named = docs.where("doc_id IS NOT NULL").join(dropped, F.col("doc_id") == F.col("__dropped"), "left_anti")
    rest = [c for c, t in docs.dtypes if c != "doc_id" and not any(k in t for k in ("map<", "variant"))]
    first = named.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy(*(rest or ["doc_id"])))).where("__n = 1")
    return first.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, _table(spark, sf_dir, "benchmark")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled towards the tempered source, language and topic shares; those of which more is wanted than there is come more than once."""
    configure(spark)
    copies = mixture(docs).where("mix_copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return copies.select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard; equal texts share one."""
    configure(spark)
    return assign_shards(docs, SHARDS)


STAGES = [
    ("quality classifier", keep_quality),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: sampling by a fitted model and a heap have no SQL; the tests hold each stage and the whole against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = durable(docs, f"stage-{n}")
    return docs
