"""The numbered queries: each applies its operator to whole tables and derives the columns its contract names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from siftstone.llm import chat, fim, lexical, mixing, oracles, pieces
from siftstone.llm.decontam import contained_items
from siftstone.llm.html_template import extract_main_text
from siftstone.llm.near import near_duplicates
from siftstone.llm.quality import importance_sample
from siftstone.llm.registry import register, table
from siftstone.llm.sharding import assign_shards, number_slots, size_of
from siftstone.llm.substring import remove_repeats
from siftstone.llm.topk import exact_top_k, quantised
from siftstone.llm.toxicity import score_toxicity


@register("op1_benchmark_decontamination", oracles.CONTAINED)
def op1(spark, sf_dir):
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op2_minhash_near_dedup", oracles.NEAR)
def op2(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


@register("op3_mixing_raking", mixing.oracle_sql())
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mixture(docs)
    return mixed.select(
        "doc_id",
        "source",
        "lang",
        mixing.topic_of(F.col("text")).alias("topic"),
        mixing.tokens_of(F.col("text")).alias("tokens"),
        F.round("mix_probability", 6).alias("probability"),
        F.col("mix_kept").alias("kept"),
        F.col("mix_copies").alias("copies"),
    )


@register("op8_substring_superkmer", oracles.REPEATS)
def op8(spark, sf_dir):
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op9_quality_importance_resampling")
def op9(spark, sf_dir):
    sampled = importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return sampled.select("doc_id", (F.col("log_weight") / 1048576.0).alias("log_weight"), (F.col("sample_key") / 1048576.0).alias("sample_key"), "kept")


@register("op10_lpt_sharding")
def op10(spark, sf_dir):
    text = F.col("text")
    placed = assign_shards(table(spark, sf_dir, "documents"), 24).select(
        "doc_id",
        size_of(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
    )
    return number_slots(placed).withColumn("grown_shard", F.lit(None).cast("int"))


@register(
    "op4_exact_topk_nra",
    """
WITH v AS (SELECT vec_id, [CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.vec[i] * c.vec[i] FOR i IN range(1, len(q.vec) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""",
)
def op4(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("vec"))
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


@register("op5_toxicity_string_kernel")
def op5(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op6_html_template_extraction")
def op6(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@register("op7_chat_prefix_targets", chat.ORACLE)
def op7(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.digests(chat.prefix_examples(turns.unionByName(probe)))


@register("op11_sentencepiece_agenda")
def op11(spark, sf_dir):
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), model).drop("text")
    both = pieces.decode_ids(encoded, model)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("ids_agree") & F.col("decoded_agree")).alias("agrees"),
    )


@register("op12_lexical_bag_search", lexical.ORACLE)
def op12(spark, sf_dir):
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


@register("op13_fill_in_middle", fim.ORACLE)
def op13(spark, sf_dir):
    cut = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), unit="lines", seed=7, rate=100, spm=50)
    return cut.select(
        "doc_id",
        F.col("fim_units").alias("n"),
        F.col("fim_form").alias("form"),
        F.col("fim_prefix_chars").alias("prefix_chars"),
        F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2("fim_output", 256).alias("output_sha256"),
        F.sha2(fim.restore(F.col("fim_output"), F.col("fim_form")), 256).alias("restored_sha256"),
    )
