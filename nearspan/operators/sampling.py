"""Deterministic samples by hashes of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearspan.functions import hash_score

from .ordered import running_sum


def bottom_k(rows: DataFrame, key: str, seed: int, k: int) -> DataFrame:
    """The ``k`` rows of the least scores: a top-k of each task, then of those."""
    return rows.withColumn("score", hash_score(seed, F.col(key))).orderBy("score", key).limit(k)


def bottom_k_per_bin(rows: DataFrame, key: str, bin_of: Column, seed: int, k: int, excluded: DataFrame | None = None) -> DataFrame:
    """The ``k`` rows of the least scores in each bin, without those whose key
    ``excluded`` has. Spark keeps each task's first ``k`` of a bin before dealing."""
    if excluded is not None:
        rows = rows.join(excluded.select(key), key, "left_anti")
    scored = rows.withColumn("score", hash_score(seed, F.col(key))).withColumn("bin", bin_of)
    place = F.row_number().over(Window.partitionBy("bin").orderBy("score", key))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def stratified(rows: DataFrame, key: str, strata: list[str], seed: int, n: int) -> DataFrame:
    """``n`` rows, taken in rounds over the strata in their order, by score in
    each. With ``place`` in its stratum, that is the order (place, strata); no
    stratum gives more than ``n``."""
    scored = rows.withColumn("score", hash_score(seed, F.col(key)))
    place = F.row_number().over(Window.partitionBy(*strata).orderBy("score", key))
    return scored.withColumn("place", place).where(F.col("place") <= n).orderBy("place", *strata).limit(n)


def enough(sample: DataFrame, n: int) -> DataFrame:
    """``sample``, or ValueError if it has fewer than ``n`` rows (counts it)."""
    if sample.count() < n:
        raise ValueError(f"requested {n} samples from a dataset with too few rows")
    return sample


def rows_by_key(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def nearest_by(rows: DataFrame, *order: Column) -> DataFrame:
    """The first row of an order."""
    return rows.orderBy(*order).limit(1)


def median_ranked(rows: DataFrame, order: str, key: str) -> DataFrame:
    """The row in the middle of an order (ties by key): of n rows the one that
    n // 2 rows come before. Places come from running sums over ranges."""
    n = rows.count()
    placed = running_sum(rows.groupBy(order).agg(F.sort_array(F.collect_list(key)).alias("_keys")).withColumn("_n", F.size("_keys")), order, "_n", "_stop")
    middle = placed.where((F.col("_stop") > n // 2) & (F.col("_stop") - F.col("_n") <= n // 2))
    return middle.select(F.get("_keys", (F.lit(n // 2) - F.col("_stop") + F.col("_n")).cast("int")).alias(key), order)
