"""Scalar functions as columns, and geometry of whole structures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Boundaries of the strata of crystals and of molecule sizes.
ATOM_BOUNDARIES = (4, 8, 16, 32, 64, 128, 256)
ANISOTROPY_BOUNDARIES = (1.2, 1.5, 2.0, 3.0, 6.0)
SKEW_BOUNDARIES = (0.05, 0.2, 0.4, 0.7)
HEAVY_ATOM_BOUNDARIES = (10, 20, 30, 40, 50, 65, 80)
#: Elements that molecule files may have.
ATOMIC_NUMBERS = {"H": 1, "C": 6, "N": 7, "O": 8, "F": 9, "P": 15, "S": 16, "Cl": 17, "Br": 35, "I": 53}


def bucket_right(x: Column, boundaries) -> Column:
    """How many boundaries are at or below x: a value at one goes up."""
    return sum((F.when(x >= b, 1).otherwise(0) for b in boundaries), F.lit(0)).cast("int")


def bucket_left(x: Column, boundaries) -> Column:
    """How many boundaries are below x: a value at one stays down."""
    return sum((F.when(x > b, 1).otherwise(0) for b in boundaries), F.lit(0)).cast("int")


def hash_score(seed: int | str, key: Column) -> Column:
    """SHA-256 of ``seed:key`` as fixed-width hex, whose order is the number's."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)


def atomic_number(symbol: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in ATOMIC_NUMBERS.items() for x in pair))
    return known[symbol]


def element_symbol(number: Column) -> Column:
    known = F.create_map(*(F.lit(x) for s, z in ATOMIC_NUMBERS.items() for x in (z, s)))
    return known[number]


def joined_list(values: Column) -> Column:
    """Distinct values in order, with bars between, for a cell of a CSV file."""
    return F.array_join(F.array_sort(F.array_distinct(values)).cast("array<string>"), "|")


def first_with_prefix(names: Column, prefix: str) -> Column:
    return F.get(F.filter(names, lambda n: F.startswith(n, F.lit(prefix))), F.lit(0))


def cell_metrics(structures: DataFrame) -> DataFrame:
    """structure_id, lengths and angles (degrees) of the cell, anisotropy, skew
    and volume. A cell vector of length 0 raises ValueError's message."""
    row = lambda k: [F.col("cell")[k][m].cast("double") for m in range(3)]
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    a, b, c = row(0), row(1), row(2)
    rows = structures.select("structure_id", "cell", *(F.sqrt(dot(v, v)).alias(f"len_{n}") for n, v in zip("abc", (a, b, c))))
    la, lb, lc = (F.col(f"len_{n}") for n in "abc")
    zero = F.when((la <= 0) | (lb <= 0) | (lc <= 0), F.raise_error(F.lit("structure contains a zero cell vector")).cast("double")).otherwise(la)
    rows = rows.withColumn("len_a", zero)
    clip = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    rows = rows.select("*", clip(dot(b, c) / (lb * lc)).alias("cos_a"), clip(dot(a, c) / (la * lc)).alias("cos_b"), clip(dot(a, b) / (la * lb)).alias("cos_c"))
    volume = F.abs(a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0]))
    cosines = [F.col(f"cos_{n}") for n in "abc"]
    return rows.select(
        "structure_id", "len_a", "len_b", "len_c", *(F.degrees(F.acos(x)).alias(f"angle_{n}") for n, x in zip("abc", cosines)),
        (F.greatest(la, lb, lc) / F.least(la, lb, lc)).alias("anisotropy"), F.greatest(*(F.abs(x) for x in cosines)).alias("skew"), volume.alias("volume"),
    )


def radius_of_gyration(atoms: DataFrame) -> DataFrame:
    """Root mean squared distance to the centroid, from sums and squares of
    coordinates about a point of each structure; partial sums, one pass after."""
    base = atoms.groupBy("structure_id").agg(*(F.avg(x).alias(f"m{x}") for x in "xyz"))
    off = atoms.join(base, "structure_id")
    d2 = sum(((F.col(x).cast("double") - F.col(f"m{x}")) ** 2 for x in "xyz"), F.lit(0.0))
    return off.groupBy("structure_id").agg(F.sqrt(F.avg(d2)).alias("radius_of_gyration"))


def shape_ratios(atoms: DataFrame) -> DataFrame:
    """Singular values of centred positions over the largest, rounded to 8
    digits; null where there are fewer points than axes. They are roots of the
    eigenvalues of a 3 x 3 matrix of sums, which have a closed form."""
    base = atoms.groupBy("structure_id").agg(*(F.avg(x).alias(f"m{x}") for x in "xyz"))
    off = atoms.join(base, "structure_id")
    of = {x: F.col(x).cast("double") - F.col(f"m{x}") for x in "xyz"}
    pairs = ["xx", "xy", "xz", "yy", "yz", "zz"]
    sums = off.groupBy("structure_id").agg(*(F.sum(of[p[0]] * of[p[1]]).alias(p) for p in pairs), F.count("*").alias("n"))
    xx, xy, xz, yy, yz, zz = map(F.col, pairs)
    mean = (xx + yy + zz) / 3
    sums = sums.withColumn("mean", mean).withColumn("size", F.sqrt(((xx - mean) ** 2 + (yy - mean) ** 2 + (zz - mean) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6))
    a, b, c = ((x - F.col("mean")) / F.col("size") for x in (xx, yy, zz))
    d, e, f = (x / F.col("size") for x in (xy, xz, yz))
    half_det = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half_det))) / 3
    turned = lambda k: F.col("mean") + 2 * F.col("size") * F.cos(F.when(F.col("size") > 0, angle).otherwise(F.lit(0.0)) + k * 2 * math.pi / 3)
    sums = sums.withColumn("big", turned(0)).withColumn("small", turned(1))
    roots = [F.col("big"), 3 * F.col("mean") - F.col("big") - F.col("small"), F.col("small")]
    ratio = lambda x: F.when(F.col("big") > 0, F.sqrt(F.greatest(F.lit(0.0), x) / F.col("big"))).otherwise(F.lit(0.0))
    return sums.select("structure_id", *(F.when(F.col("n") > k, F.round(ratio(x), 8)).alias(f"ratio_{k + 1}") for k, x in enumerate(roots)))
