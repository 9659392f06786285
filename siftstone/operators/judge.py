"""Judge hand-off: evidence rows, fallback rows, joining results back, and a hook for a caller's judge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

DEFAULT_LIMIT = 20
REASON_NOT_RUN = "judge_runner_not_configured"


def evidence(ranked: DataFrame, limit: int = DEFAULT_LIMIT, rank: str = "rank") -> DataFrame:
    """Compact evidence of the first ``limit`` ranked rows."""
    media = F.transform("media_references", lambda m: F.coalesce(m["media_type"], m["type"]))
    return ranked.where(F.col(rank) <= limit).select(
        F.col(rank).alias("rank"),
        "id",
        "source_item_id",
        "url",
        "canonical_url",
        "title",
        F.left(T.main_text(F.col("text"), F.col("title")), F.lit(500)).alias("text_preview"),
        "author",
        "quality_score",
        "quality_reasons",
        "coverage_topics",
        F.coalesce(F.size("media_references"), F.lit(0)).alias("media_count"),
        F.coalesce(F.array_sort(F.array_distinct(F.array_compact(media))), F.array().cast("array<string>")).alias("media_types"),
    )


def fallback_rows(evidence_rows: DataFrame, *, policy: str = "keep_ranked") -> DataFrame:
    """``unjudged`` judge rows for evidence nobody judged."""
    decision = "fallback_keep" if policy == "keep_ranked" else "unsure"
    return evidence_rows.select(
        F.lit("judge_result").alias("record_type"),
        F.lit("unjudged").alias("status"),
        F.lit(decision).alias("decision"),
        F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("double").alias("confidence"),
        F.array(F.lit(REASON_NOT_RUN)).alias("reasons"),
        F.struct(*evidence_rows.columns).alias("candidate"),
        F.lit(True).alias("fallback_used"),
    )


def attach_results(evidence_rows: DataFrame, results: DataFrame, *, policy: str = "keep_ranked") -> DataFrame:
    """Join judge results (id, decision, confidence) to the evidence; rows without a result get the fallback."""
    fallback = F.lit("fallback_keep" if policy == "keep_ranked" else "unsure")
    judged = F.col("__decision").isNotNull()
    # several results of one id count as one: the most confident
    best = F.max_by(F.struct("decision", "confidence"), F.struct(F.coalesce("confidence", F.lit(-1.0)), "decision"))
    r = results.where("id IS NOT NULL").groupBy("id").agg(best.alias("r"))
    r = r.select("id", F.col("r.decision").alias("__decision"), F.col("r.confidence").alias("__confidence"))
    return evidence_rows.join(r, "id", "left").select(
        *evidence_rows.columns,
        F.when(judged, F.lit("judged")).otherwise(F.lit("unjudged")).alias("status"),
        F.coalesce(F.col("__decision"), fallback).alias("decision"),
        F.col("__confidence").alias("confidence"),
        (~judged).alias("fallback_used"),
    )


def run_judge(
    evidence_rows: DataFrame, judge: Callable[[pd.DataFrame], pd.DataFrame], schema: str = "id string, decision string, confidence double"
) -> DataFrame:
    """Apply a caller's judge to Arrow batches of evidence rows."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield judge(part)

    return evidence_rows.mapInPandas(batches, schema)
