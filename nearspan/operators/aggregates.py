"""Counts and sums over atoms and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a pair in arrays: two 64-bit indices and three 32-bit shifts.
PAIR_BYTES = 2 * 8 + 3 * 4


def degrees(atoms: DataFrame, pairs: DataFrame) -> DataFrame:
    """(structure_id, atom_id, degree), 0 for atoms without a pair."""
    counted = pairs.groupBy(F.col("i").alias("atom_id")).agg(F.count("*").alias("degree"))
    return atoms.select("structure_id", "atom_id").join(counted, "atom_id", "left").select("structure_id", "atom_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def pairs_by_structure(structures: DataFrame, pairs: DataFrame) -> DataFrame:
    """(structure_id, n_pairs, n_bytes), 0 for structures without a pair."""
    counted = pairs.groupBy("structure_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return structures.select("structure_id").join(counted, "structure_id", "left").select("structure_id", n.alias("n_pairs"), (n * PAIR_BYTES).alias("n_bytes"))


def structure_bounds(atoms: DataFrame) -> DataFrame:
    """Number of atoms, bounds and largest magnitude of each structure."""
    sums = [f(x).alias(f"{n}_{x}") for x in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    return atoms.groupBy("structure_id").agg(F.count("*").alias("n_atoms"), *sums, F.max(F.greatest(*(F.abs(x) for x in "xyz"))).alias("max_abs"))


def bin_occupancy(atoms: DataFrame, width: float) -> DataFrame:
    """Atoms in each filled bin of a grid from each structure's least corner."""
    low = atoms.groupBy("structure_id").agg(*(F.min(x).alias(f"min_{x}") for x in "xyz"))
    at = atoms.join(low, "structure_id").select("structure_id", *(F.floor((F.col(x) - F.col(f"min_{x}")) / width).alias(f"g{x}") for x in "xyz"))
    return at.groupBy("structure_id", "gx", "gy", "gz").agg(F.count("*").alias("n_atoms"))


def dense_candidates(images: DataFrame, counts: DataFrame) -> DataFrame:
    """Pairs that a dense search of all images would test: sum of n*n*images."""
    own = counts.join(images.groupBy("structure_id").agg(F.count("*").alias("n_images")), "structure_id")
    return own.agg(F.coalesce(F.sum(F.col("n_atoms") * F.col("n_atoms") * F.col("n_images")), F.lit(0)).alias("candidates"))


def argmin_per_group(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The row of each group that is least by ``order``; partial minima."""
    rest = [c for c in rows.columns if c not in (*group, *order)]
    best = rows.groupBy(*group).agg(F.min(F.struct(*order, *rest)).alias("_best"))
    return best.select(*group, *(F.col(f"_best.{c}").alias(c) for c in (*order, *rest)))


def timing_summary(runs: DataFrame) -> DataFrame:
    """runs: name, seconds, pairs. Median, least, most and pairs a second."""
    return runs.groupBy("name").agg(
        F.median("seconds").alias("median_s"), F.min("seconds").alias("min_s"), F.max("seconds").alias("max_s"), (F.max("pairs") / F.median("seconds")).alias("pairs_per_s")
    )


def summary(rows: DataFrame, ids: str, others: list[str]) -> DataFrame:
    """One row: numbers of rows and of different ids, and of each other column
    the number of different values, the least and the most."""
    of = [f(c).alias(f"{n}_{c}") for c in others for n, f in (("n", F.countDistinct), ("min", F.min), ("max", F.max))]
    return rows.agg(F.count("*").alias("n_rows"), F.countDistinct(ids).alias("n_ids"), *of)
