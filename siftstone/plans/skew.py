"""Building blocks that keep hot keys off a single task and cut long lineage on shared storage.

* :func:`durable` writes a table below the cluster's checkpoint folder and reads it back.
* :func:`top_per_group` keeps the first n rows of every group with a map-side limit, whatever the group size.
* :func:`number_within` gives exact row numbers (or running sums) inside groups of any size without a one-task window.
* :func:`fetch_rows` joins the few rows that were chosen by id with their wide columns.
* :func:`lookup` joins a fact side with a keyed table, broadcasting only the keys proven to be few and heavy.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"


def scratch_folder(spark: SparkSession) -> str:
    """Shared checkpoint folder of the session; a local temporary one only when running in local mode without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("siftstone.scratch", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="siftstone-")
    spark.conf.set("siftstone.scratch", folder)
    return folder


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Materialise on shared storage. Survives executor loss, ends the lineage, and gives later plans real sizes."""
    path = f"{scratch_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def top_per_group(
    df: DataFrame, keys: list[Column | str], order: list[Column], n: int, rank_col: str = "__rn"
) -> DataFrame:
    """First ``n`` rows per group, with their 1-based position in ``rank_col``.

    Below Spark's group-limit threshold the filter on ``row_number`` is pushed under the shuffle, so a map task ships at
    most n rows of any group. Beyond it a salted first pass does the same by hand.
    """
    threshold = int(df.sparkSession.conf.get(_LIMIT_CONF, "1000"))
    if n >= threshold:
        salts = max(df.sparkSession.sparkContext.defaultParallelism, 8)
        # descending order expressions cannot be hashed, so the salt comes from the row's columns
        plain = [c for c in df.columns if not df.schema[c].dataType.typeName().startswith(("map", "variant"))]
        df = df.withColumn("__salt", F.pmod(F.xxhash64(*plain), F.lit(salts)))
        first = Window.partitionBy(*keys, "__salt").orderBy(*order)
        df = df.withColumn("__rn0", F.row_number().over(first)).where(F.col("__rn0") <= n).drop("__rn0", "__salt")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(window)).where(F.col(rank_col) <= n)


def number_within(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    position: str | None = "position",
    running: dict[str, Column] | None = None,
) -> DataFrame:
    """Exact 1-based position and running sums inside each group (the whole table when ``keys`` is empty).

    The rows are written once, as the sampling of range bounds would compute them a second time. Only their keys, order and summed values are
    range-partitioned, so a hot group spreads over many tasks; each task numbers its own slice, and the slices' totals (one row per group and task) are
    summed up and added back. The other columns meet their numbers at the end, those that are asked for.
    """
    running = dict(running or {})
    values = {name: f"__v_{name}" for name in running}
    flat = df.select("*", *[expr.alias(values[name]) for name, expr in running.items()], F.monotonically_increasing_id().alias("__row"))
    flat = durable(flat, "rows")
    used = list(dict.fromkeys([*keys, *order]))
    narrow = flat.select("__row", *used, *values.values())
    ranged = narrow.repartitionByRange(*[F.col(c) for c in used]).withColumn("__pid", F.spark_partition_id())
    # the range bounds come from sampling, so fix the assignment before it is used twice
    ranged = durable(ranged, "ranged")
    slice_window = Window.partitionBy(*keys, "__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__pid").orderBy(*order)))
    for name, value in values.items():
        local = local.withColumn(f"__s_{name}", F.sum(value).over(slice_window))
    totals = ranged.groupBy(*keys, "__pid").agg(
        F.count(F.lit(1)).alias("__t_n"), *[F.sum(v).alias(f"__t_{name}") for name, v in values.items()]
    )
    # at most (tasks) rows per group here, whatever the group size
    before = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "__pid",
        F.coalesce(F.sum("__t_n").over(before), F.lit(0)).alias("__o_n"),
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in running],
    )
    # only groups that span tasks need an offset; there are fewer than (tasks) such rows, so they can be broadcast
    offsets = offsets.where(F.col("__o_n") > 0)
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, "__pid"]]
    joined = local.alias("l").join(F.broadcast(offsets).alias("o"), on, "left")
    out = [(F.col(f"l.__s_{name}") + F.coalesce(F.col(f"o.__o_{name}"), F.lit(0))).alias(name) for name in running]
    if position:
        out = [(F.col("l.__n") + F.coalesce(F.col("o.__o_n"), F.lit(0))).cast("long").alias(position), *out]
    if set(df.columns) <= set(used):
        return joined.select(*[F.col(f"l.{c}") for c in df.columns], *out)
    # what was range-partitioned is taken from there, so a query for keys and numbers alone reads no other column
    numbered = joined.select("l.__row", *[F.col(f"l.{c}") for c in used], *out)
    rest = flat.select("__row", *[c for c in df.columns if c not in used])
    added = [*([position] if position else []), *running]
    return numbered.join(rest, "__row").select(*[c for c in df.columns if c not in added], *added)


def lookup(facts: DataFrame, table: DataFrame, key: str, weight: str, heavy_above: int) -> DataFrame:
    """Left join ``facts`` with a table that is unique on ``key``, safe against hot keys.

    ``weight`` is the number of fact rows per key. Keys with more than ``heavy_above`` rows number at most
    rows / heavy_above, so that slice is broadcast; every other key has few rows and goes through an ordinary shuffle
    join. ``weight`` is dropped from the result.
    """
    table_cols = [c for c in table.columns if c not in (key, weight)]
    heavy = table.where(F.col(weight) > heavy_above).select(key, *table_cols, F.lit(True).alias("__heavy"))
    light = table.where(F.col(weight) <= heavy_above).select(key, *table_cols)
    marked = facts.join(F.broadcast(heavy), key, "left")
    hot = marked.where(F.col("__heavy")).drop("__heavy")
    cold = marked.where(F.col("__heavy").isNull()).drop("__heavy", *table_cols).join(light, key, "left")
    return hot.unionByName(cold)


def fetch_rows(found: DataFrame, rows: DataFrame, id_col: str, *, few: int = 1 << 22, row_id: str = "ord") -> DataFrame:
    """``found`` with the columns of the row of ``rows`` that each names in ``id_col``; ``row_id`` is unique in ``rows``.

    Up to ``few`` ids (eight bytes each where they are numbers) are broadcast as a filter first, which Spark moves below the expressions of ``rows`` to its
    scan: only the rows asked for are built and moved. Beyond that both sides are shuffled on the id. ``found`` should be a written table, as it is counted.
    """
    if found.count() <= few:
        wanted = found.select(F.col(id_col).alias("__wanted")).where("__wanted IS NOT NULL").distinct()
        # as a predicate it moves below the expressions of the rows; a join stays above expressions that hold nullif()
        rows = rows.where(F.col(row_id).isin(F.broadcast(wanted)))
    return found.join(rows.withColumnRenamed(row_id, "__row_id"), F.col(id_col) == F.col("__row_id")).drop("__row_id")


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One row holding the columns of several one-row frames, without a join."""
    stacked = rows[0]
    for row in rows[1:]:
        stacked = stacked.unionByName(row, allowMissingColumns=True)
    return stacked.agg(*[F.any_value(c, F.lit(True)).alias(c) for c in stacked.columns])
