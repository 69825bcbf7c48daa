"""Structures and pair lists made from others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearspan.functions import hash_score

from .ordered import carried, running_sum

SHIFT = ["sx", "sy", "sz"]


def supercell(atoms: DataFrame, structures: DataFrame, times: tuple[int, int, int]) -> tuple[DataFrame, DataFrame]:
    """Each structure repeated along its cell. An atom's copies have the ids
    ``atom_id * copies + copy``; cell rows are multiplied. Copies are made by
    explode, which needs no exchange."""
    na, nb, nc = (int(n) for n in times)
    if min(na, nb, nc) < 1:
        raise ValueError("repetitions must be positive")
    out = atoms.join(structures.select("structure_id", "cell"), "structure_id")
    for name, n in zip(("ka", "kb", "kc"), (na, nb, nc)):
        out = out.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    k = [F.col(c).cast("double") for c in ("ka", "kb", "kc")]
    moved = {x: F.col(x) + (k[0] * F.col("cell")[0][m] + k[1] * F.col("cell")[1][m] + k[2] * F.col("cell")[2][m]) for m, x in enumerate("xyz")}
    copy = (F.col("ka") * nb + F.col("kb")) * nc + F.col("kc")
    out = out.withColumns(moved | {"atom_id": F.col("atom_id") * (na * nb * nc) + copy}).select(*atoms.columns)
    rows = F.array(*(F.transform(F.col("cell")[m], lambda x, n=n: x * n) for m, n in enumerate((na, nb, nc))))
    new = structures.withColumn("cell", rows)
    if "source_id" in structures.columns:
        new = new.withColumn("source_id", F.concat("source_id", F.lit(f"__{na}x{nb}x{nc}")))
    return out, new


def collate(batches: list[DataFrame]) -> DataFrame:
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b)
    return out


def batch_offsets(structures: DataFrame, atoms: DataFrame) -> DataFrame:
    """(structure_id, n_atoms, start, stop): where each structure's atoms would
    lie if all were put one after another by id (numbers)."""
    counted = atoms.groupBy("structure_id").agg(F.count("*").alias("n"))
    own = structures.select("structure_id").join(counted, "structure_id", "left").select("structure_id", F.coalesce("n", F.lit(0)).alias("n_atoms"))
    summed = running_sum(own, "structure_id", "n_atoms", "stop")
    return summed.select("structure_id", "n_atoms", (F.col("stop") - F.col("n_atoms")).alias("start"), "stop")


def structure_of(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """Rows (atom_id) with the structure whose range start <= atom_id < stop has
    them. Starts are merged into the order of ids and carried forward."""
    starts = offsets.where("stop > start").select(F.col("start").alias("atom_id"), "structure_id")
    return carried(rows, starts, "atom_id", "structure_id").select("structure_id", "atom_id")


def reverse(pairs: DataFrame) -> DataFrame:
    signs = {c: -F.col(c) for c in (*SHIFT, "dx", "dy", "dz") if c in pairs.columns}
    return pairs.select(*(F.col("j").alias(c) if c == "i" else F.col("i").alias(c) if c == "j" else signs.get(c, F.col(c)).alias(c) for c in pairs.columns))


def _own_reverse():
    return (F.col("i") == F.col("j")) & (F.col("sx") == 0) & (F.col("sy") == 0) & (F.col("sz") == 0)


def half_to_full(pairs: DataFrame) -> DataFrame:
    """Adds each pair's reverse; zero-shift selves are their own. A half list has
    one direction of a pair, so nothing has to be made distinct."""
    return pairs.unionByName(reverse(pairs.where(~_own_reverse())))


def full_to_half(pairs: DataFrame) -> DataFrame:
    """Keeps the smaller of each pair and its reverse: a filter."""
    shift = F.struct(*SHIFT)
    return pairs.where((F.col("i") < F.col("j")) | ((F.col("i") == F.col("j")) & (shift <= F.struct(*(F.lit(0).alias(s) for s in SHIFT)))))


def with_selves(pairs: DataFrame, atoms: DataFrame) -> DataFrame:
    """Adds one zero-shift self for each atom to (structure_id, i, j, S)."""
    zero = [F.lit(0).cast("int").alias(s) for s in SHIFT]
    return pairs.select("structure_id", "i", "j", *SHIFT).unionByName(atoms.select("structure_id", F.col("atom_id").alias("i"), F.col("atom_id").alias("j"), *zero))


def minibatches(structures: DataFrame, seed: int, size: int) -> DataFrame:
    """(structure_id, batch): structures in a seeded order, ``size`` at a time."""
    rows = structures.select("structure_id", hash_score(seed, F.col("structure_id")).alias("_score"))
    # 48 bits of the score give the order; ids break what ties they leave
    own = rows.withColumn("_order", F.conv(F.substring("_score", 1, 12), 16, 10).cast("long")).groupBy("_order").agg(F.sort_array(F.collect_list(F.struct("_score", "structure_id"))).alias("_own"))
    placed = running_sum(own.withColumn("_n", F.size("_own")), "_order", "_n", "_stop")
    each = placed.select(F.posexplode("_own").alias("_k", "_one"), (F.col("_stop") - F.col("_n")).alias("_start"))
    return each.select(F.col("_one.structure_id").alias("structure_id"), F.floor((F.col("_start") + F.col("_k")) / size).cast("long").alias("batch"))
