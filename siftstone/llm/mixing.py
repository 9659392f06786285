"""Mixing by iterative proportional fitting, in DataFrame operations only.

Documents fall into cells (source, language, topic). Raking scales the cells' token weights to the target share of each source, then of each
language, then of each topic, and again, until all three marginals hold together. A document's weight is ``fraction * fitted / observed`` tokens of its
cell: up to 1 the chance of being sampled, decided by a hash of its id, so a rerun takes the same documents; above 1 the document is taken as many
times as the weight has wholes, and once more by the chance that is left, so the expected tokens are the raked ones.
Documents are read once to sum tokens per cell (with map-side combine) and once to be sampled; everything between works on cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.plans.skew import durable

DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 8
FRACTION = 0.5
#: share of a value in the target is proportional to its observed share to this power
TEMPER = {"source": 0.7, "lang": 0.5, "topic": 0.9}

WORD = r"[^\x20\x09-\x0D]+"


def tokens_of(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """Form of the text as a coarse topic: table, contact, statement with marks, or prose."""
    return (
        F.when(text.contains(" | "), F.lit("table"))
        .when(text.contains("@"), F.lit("contact"))
        .when(text.contains("!!") | text.contains("%%%"), F.lit("noisy"))
        .otherwise(F.lit("prose"))
    )


def draw_of(id_col: Column) -> Column:
    """Number in [0, 1) from the id, the same in every run."""
    return F.conv(F.substring(F.md5(id_col.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def tempered_targets(cells: DataFrame, temper: dict[str, float]) -> DataFrame:
    """(dim, value, share): each value's observed token share to the power of its dimension's exponent, made to sum to 1."""
    parts = [
        cells.groupBy(F.lit(d).alias("dim"), F.col(d).alias("value")).agg(F.sum("tokens").alias("t")).select("dim", "value", F.pow(F.col("t").cast("double"), F.lit(float(a))).alias("w"))
        for d, a in temper.items()
    ]
    weights = parts[0]
    for p in parts[1:]:
        weights = weights.unionByName(p)
    total = weights.groupBy("dim").agg(F.sum("w").alias("all"))  # one row per dimension
    return weights.join(F.broadcast(total), "dim").select("dim", "value", (F.col("w") / F.col("all")).alias("share"))


def rake(cells: DataFrame, targets: DataFrame, rounds: int = ROUNDS, dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Cells with ``fitted``: tokens scaled so that every dimension's sums are share x all tokens, after ``rounds`` passes.

    ``cells`` has the dimensions and ``tokens`` (cells without tokens get none); ``targets`` has (dim, value, share), null values included. A
    value without target gets 0. Shares that no weights can meet leave the last dimension exact and the others as near as raking brings them.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    goal = durable(targets.select("dim", "value", (F.col("share") * F.lit(total)).alias("goal")), "goal")
    state = cells.withColumn("fitted", F.col("tokens").cast("double"))
    for _ in range(rounds):
        for d in dims:
            now = state.groupBy(F.col(d).alias("value")).agg(F.sum("fitted").alias("now"))
            want = goal.where(F.col("dim") == d).select(F.col("value").alias("v2"), "goal")
            factor = now.join(want, F.col("value").eqNullSafe(F.col("v2")), "left").select(
                F.col("value").alias("__value"), F.when(F.col("now") > 0, F.coalesce("goal", F.lit(0.0)) / F.col("now")).otherwise(0.0).alias("__factor")
            )
            state = state.join(factor, F.col(d).eqNullSafe(F.col("__value")), "left").withColumn("fitted", F.col("fitted") * F.col("__factor"))
            state = durable(state.select(*cells.columns, "fitted"), "raked")
    return state


def mixture(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    topic: Column | None = None,
    targets: DataFrame | None = None,
    temper: dict[str, float] | None = None,
    fraction: float = FRACTION,
    rounds: int = ROUNDS,
) -> DataFrame:
    """All rows and columns of ``docs`` with ``mix_weight`` (expected copies), ``mix_copies``, ``mix_probability`` (of a copy at least), ``mix_draw`` and ``mix_kept``
    (columns of these names are replaced). The raked sample has each row ``mix_copies`` times; ``mix_kept`` alone has it once.

    Null source, language or topic is a value of its own. Documents without words belong to their cell but add no tokens; a cell without tokens has
    probability 0 and keeps nothing. Repeated rows share their draw, a null id draws as an empty id. ``targets`` (dim, value, share) may be given;
    otherwise shares are tempered. An empty table gives no rows.
    """
    names = ("mix_weight", "mix_copies", "mix_probability", "mix_draw", "mix_kept")
    topic = topic_of(F.col(text_col)) if topic is None else topic
    keys = docs.select(
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), topic.alias("topic"), tokens_of(F.col(text_col)).alias("tokens")
    )
    cells = durable(keys.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    targets = tempered_targets(cells, temper or TEMPER) if targets is None else targets
    fitted = rake(cells, targets, rounds).select(
        *[F.col(d).alias(f"__{d}") for d in DIMENSIONS],
        F.when(F.col("tokens") > 0, F.lit(fraction) * F.col("fitted") / F.col("tokens")).otherwise(0.0).alias("__w"),
    )
    fitted = durable(fitted, "calibrated")
    marked = docs.drop(*names).withColumn("__topic_of", topic)
    on = (
        F.col("source").cast("string").eqNullSafe(F.col("__source"))
        & F.col("lang").cast("string").eqNullSafe(F.col("__lang"))
        & F.col("__topic_of").eqNullSafe(F.col("__topic"))
    )
    # Spark broadcasts the cells while their written size is small and otherwise shuffles, splitting hot cells
    joined = marked.join(fitted, on, "left")
    draw = draw_of(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return (
        joined.withColumn("mix_weight", F.coalesce("__w", F.lit(0.0)))
        .withColumn("mix_probability", F.least(F.lit(1.0), F.col("mix_weight")))
        .withColumn("mix_draw", draw)
        .withColumn("mix_copies", F.floor("mix_weight") + (F.col("mix_draw") < F.col("mix_weight") - F.floor("mix_weight")).cast("long"))
        .withColumn("mix_kept", F.col("mix_draw") < F.col("mix_probability"))
        .drop("__topic_of", "__w", *[f"__{d}" for d in DIMENSIONS])
    )


def oracle_sql(rounds: int = ROUNDS, fraction: float = FRACTION, temper: dict[str, float] = TEMPER) -> str:
    """DuckDB SQL of the same result: the passes written out one after another."""
    steps = [
        """d AS (SELECT doc_id, source, lang,
  CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '@') THEN 'contact'
    WHEN contains(text, '!!') OR contains(text, '%%%') THEN 'noisy' ELSE 'prose' END AS topic,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS tokens FROM documents)""",
        "c AS (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL)",
    ]
    for dim, a in temper.items():
        steps.append(f"w_{dim} AS (SELECT {dim} AS value, pow(CAST(sum(tokens) AS DOUBLE), {a}) AS w FROM c GROUP BY 1)")
        steps.append(f"g_{dim} AS (SELECT value, w / (SELECT sum(w) FROM w_{dim}) * (SELECT CAST(sum(tokens) AS DOUBLE) FROM c) AS goal FROM w_{dim})")
    steps.append("s0 AS (SELECT *, CAST(tokens AS DOUBLE) AS fitted FROM c)")
    k = 0
    for _ in range(rounds):
        for dim in DIMENSIONS:
            steps.append(
                f"s{k + 1} AS (SELECT s.source, s.lang, s.topic, s.tokens, s.fitted * CASE WHEN m.now > 0 THEN coalesce(g.goal, 0) / m.now ELSE 0 END AS fitted "
                f"FROM s{k} s JOIN (SELECT {dim} AS value, sum(fitted) AS now FROM s{k} GROUP BY 1) m ON s.{dim} IS NOT DISTINCT FROM m.value "
                f"LEFT JOIN g_{dim} g ON m.value IS NOT DISTINCT FROM g.value)"
            )
            k += 1
    steps = [s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps]
    return f"""WITH {', '.join(steps)},
p AS (SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens,
  CASE WHEN s.tokens > 0 THEN {fraction} * s.fitted / s.tokens ELSE 0.0 END AS weight,
  CAST(concat('0x', substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 AS draw
  FROM d JOIN s{k} s ON d.source IS NOT DISTINCT FROM s.source AND d.lang IS NOT DISTINCT FROM s.lang AND d.topic IS NOT DISTINCT FROM s.topic)
SELECT doc_id, source, lang, topic, tokens, round(least(1.0, weight), 6) AS probability, draw < least(1.0, weight) AS kept,
  CAST(floor(weight) + CAST(draw < weight - floor(weight) AS INT) AS BIGINT) AS copies FROM p"""
