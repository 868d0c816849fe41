"""Building blocks shared by the operators: skew-safe ranking, keyed merges, top-k."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def as_cols(values) -> list[Column]:
    return [F.col(v) if isinstance(v, str) else v for v in values]


def top_k(df: DataFrame, keys, order, k: int | None, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key; None ranks all rows.

    ``row_number() <= k`` plans as WindowGroupLimit, which trims every task to k rows per key
    before the shuffle, so a key holding a third of all rows sends k rows per task, not its group.
    """
    window = Window.partitionBy(*as_cols(keys)).orderBy(*as_cols(order))
    ranked = df.withColumn(rank, F.row_number().over(window))
    return ranked if k is None else ranked.filter(F.col(rank) <= k)


def best_row(df: DataFrame, keys, order: Column, maximum: bool = True) -> DataFrame:
    """One row per key by the largest (or smallest) order value; partial aggregation absorbs hot keys."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if maximum else F.min_by)(F.struct(*rest), order).alias("_row")
    return df.groupBy(*keys).agg(pick).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def positions(df: DataFrame, keys, order, out: str = "position", parts: int | None = None) -> DataFrame:
    """Exact 1-based row number per key when groups may be huge.

    Rows are range-partitioned on (key, order) and stored, numbered inside (part, key), and shifted by
    the counts of earlier parts of the same key. No task ever holds more than one range part.
    """
    keys = list(keys)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *as_cols(keys), *as_cols(order)).withColumn("_part", F.spark_partition_id())
    placed = cut_lineage(placed)
    inner = Window.partitionBy("_part", *keys).orderBy(*as_cols(order))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    if not keys:
        before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = placed.groupBy("_part", *keys).count().withColumn(
        "_shift", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    numbered = placed.withColumn("_local", F.row_number().over(inner))
    return (numbered.join(shifts, ["_part", *keys]).withColumn(out, F.col("_local") + F.col("_shift"))
            .drop("_part", "_local", "_shift"))


def running_max(df: DataFrame, keys, order, value: str, out: str, parts: int | None = None) -> DataFrame:
    """Largest ``value`` up to each row of its key, in order, when groups may be huge; ``order`` tells the rows of a key apart.

    Like ``positions``: range parts are scanned on their own and raised by the maxima of earlier parts of the same key.
    """
    keys = list(keys)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(df.repartitionByRange(parts, *as_cols(keys), *as_cols(order)).withColumn("_part", F.spark_partition_id()))
    inner = Window.partitionBy("_part", *keys).orderBy(*as_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tops = placed.groupBy("_part", *keys).agg(F.max(value).alias("_top")).withColumn("_before", F.max("_top").over(before)).drop("_top")
    local = placed.withColumn("_local", F.max(value).over(inner))
    return local.join(tops, ["_part", *keys]).withColumn(out, F.greatest("_local", "_before")).drop("_part", "_local", "_before")


def distinct_values(df: DataFrame, keys, value, out: str) -> DataFrame:
    """Sorted distinct array per key; pairs are made distinct map-side first, so repeats never travel."""
    pairs = df.select(*keys, F.col(value).alias("_v") if isinstance(value, str) else value.alias("_v"))
    pairs = pairs.filter(F.col("_v").isNotNull()).distinct()
    return pairs.groupBy(*keys).agg(F.array_sort(F.collect_list("_v")).alias(out))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give CPU-heavy per-row work enough tasks when the input has fewer splits than the cluster has cores.

    Inputs with enough splits, which is the normal case at scale, are returned unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def latest_wins(existing: DataFrame, incoming: DataFrame, keys, order) -> DataFrame:
    """Keyed merge: per key the newest incoming row, plus untouched existing rows."""
    fresh = best_row(incoming, keys, order if isinstance(order, Column) else F.col(order))
    kept = existing.join(fresh.select(*keys), list(keys), "left_anti")
    return kept.select(*existing.columns).unionByName(fresh.select(*existing.columns))


def newest_wins(existing: DataFrame, incoming: DataFrame, keys, order) -> DataFrame:
    """Keyed merge for data that may arrive out of order or twice: stored and incoming rows compete on ``order``."""
    return best_row(existing.unionByName(incoming.select(*existing.columns)), keys, order if isinstance(order, Column) else F.col(order))


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys, order, place=()) -> DataFrame:
    """Rows to append: first incoming row per key whose key is not stored yet; a null in a key equals no stored one.

    Stored keys and incoming rows are shuffled once and compete in one window. ``place`` names columns of both that the keys determine; rows that
    agree in them come out in one task, ready to be written there.
    """
    order = order if isinstance(order, Column) else F.col(order)
    known = existing.dropna(subset=list(keys)).select(*place, *keys, F.lit(True).alias("_known"))
    both = incoming.withColumn("_known", F.lit(False)).unionByName(known, allowMissingColumns=True)
    first = top_k(both.repartition(*place) if place else both, [*place, *keys], [F.desc("_known"), order.asc_nulls_last()], 1, "_first")
    return first.filter(~F.col("_known")).select(*incoming.columns)


def visible_profiles(profiles: DataFrame, opt_outs: DataFrame | None = None) -> DataFrame:
    """Read path for profiles: deleted rows and handles with a processed opt-out never come out."""
    out = profiles.filter(~F.col("is_deleted"))
    if opt_outs is not None:
        out = out.join(opt_outs.filter("status = 'processed'").select("source", "handle"), ["source", "handle"],
                       "left_anti")
    return out
