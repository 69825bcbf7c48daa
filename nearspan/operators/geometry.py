"""Lattices of whole tables: duals, image ranges, and how a structure is searched."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

AXES, XYZ = "abc", "xyz"
#: Images of a structure, at most; the grid that forced bins must
#: fit in, bins at all and for each image; the bound of wraps and shifts.
MOST_IMAGES = 1 << 24
MOST_BINS, MOST_BINS_PER_IMAGE = 1 << 26, 64
INT32 = float(1 << 31)
#: Roundings that an expression of displacements may pile up.
ROUNDINGS = 64

CELL = [f"c_{a}{x}" for a in AXES for x in XYZ]
DUAL = [f"d_{a}{x}" for a in AXES for x in XYZ]
PERIODIC = [f"p_{a}" for a in AXES]
BOUNDS = [f"{side}_{x}" for side in ("min", "max") for x in XYZ]

#: How a structure is searched: by one task, by blocks of space, by groups of its points.
WHOLE, BLOCKS, GROUPS = 0, 1, 2

BAD_CELL = "cell must contain only finite values"
DEPENDENT = "cell rows of periodic axes must be linearly independent"
TOO_MANY_IMAGES = "periodic image count exceeds the resource limit"
BAD_PLACE = "positions must contain only finite values"
BAD_WRAP = "representative wraps exceed int32"
BAD_BINS = "cell_list cannot safely process this structure"
BAD_SHIFT = "output cell shift exceeds int32"


def dual_rows(cells: np.ndarray, pbc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Duals (n, 3, 3) of the active rows, 0 elsewhere, and whether these rows
    are independent: the least singular value against the largest or 1."""
    duals, good = np.zeros_like(cells), np.ones(len(cells), bool)
    finite = np.isfinite(cells).all(axis=(1, 2))
    for bits in range(1, 8):
        active = np.array([bits >> k & 1 for k in range(3)], bool)
        rows = np.flatnonzero((pbc == active).all(axis=1) & finite)
        if len(rows):
            own = cells[np.ix_(rows, np.flatnonzero(active))]
            s = np.linalg.svd(own, compute_uv=False)
            good[rows] = s[:, -1] > 3 * EPS * np.maximum(s[:, 0], 1)
            some = rows[good[rows]]
            inverse = np.linalg.pinv(cells[np.ix_(some, np.flatnonzero(active))], rcond=0)
            duals[np.ix_(some, np.flatnonzero(active))] = inverse.transpose(0, 2, 1)
    return duals, good


EPS = float(np.finfo(np.float64).eps)


def checked_duals(cells: np.ndarray, pbc: np.ndarray, n: np.ndarray, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Duals, and images to each side (n, 3), of checked cells. Cells of empty
    structures only have to be finite. Errors come in a fixed order."""
    if not np.isfinite(cells).all():
        raise ValueError(BAD_CELL)
    duals, good = dual_rows(cells, pbc)
    if not good[n > 0].all():
        raise ValueError(DEPENDENT)
    lengths = np.sqrt((duals**2).sum(axis=2))
    far = np.where(pbc, np.ceil(cutoff * lengths * (1 + 1e-12)), 0.0)
    far[n == 0] = 0
    if not (far < INT32).all() or ((2 * far + 1).prod(axis=1) > MOST_IMAGES).any():
        raise ValueError(TOO_MANY_IMAGES)
    return duals, far.astype(np.int64)


def wraps_of(points: np.ndarray, duals: np.ndarray, pbc: np.ndarray) -> np.ndarray:
    """Whole cells (n, 3) that each point lies away from its wrapped place."""
    x, y, z = points.T
    f = np.stack([x * duals[:, a, 0] + y * duals[:, a, 1] + z * duals[:, a, 2] for a in range(3)], axis=1)
    if not np.isfinite(points).all():
        raise RuntimeError(BAD_PLACE)
    if ((f >= INT32) | (f < -INT32)).any():
        raise RuntimeError(BAD_WRAP)
    return np.where(pbc, np.floor(f), 0.0).astype(np.int64)


def moved(points: np.ndarray, shift: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """points + shift times the cell, in double precision."""
    s = shift.astype(np.float64)
    return points + (s[:, :1] * cells[:, 0] + s[:, 1:2] * cells[:, 1] + s[:, 2:] * cells[:, 2])


def search_plan(cells, pbc, n, low, high, cutoff: float, eps: float, algorithm: str, most_whole: int) -> dict[str, np.ndarray]:
    """For each structure: duals, images to each side that may hold neighbors,
    the width within which neighbors are sought, and the grid of blocks.

    low, high: bounds of the points as they are. eps is that of the points'
    own precision: displacements are rounded in it, and nothing that the final
    test may take in must be left out before."""
    duals, far = checked_duals(cells, pbc, n, cutoff)
    if not (np.isfinite(low).all() and np.isfinite(high).all()):
        raise RuntimeError(BAD_PLACE)
    lengths = np.sqrt((duals**2).sum(axis=2))
    # fractional bounds of the box of points, and whether all lie in one cell
    parts = np.sort(np.stack([duals * low[:, None], duals * high[:, None]]), axis=0)
    f_low, f_high = parts[0].sum(axis=2), parts[1].sum(axis=2)
    reach = np.maximum(np.abs(low), np.abs(high))
    slack = 16 * EPS * (np.abs(duals) * reach[:, None]).sum(axis=2)
    if ((f_high >= 2 * INT32) | (f_low < -2 * INT32))[pbc].any():
        raise RuntimeError(BAD_WRAP)
    first, last = np.floor(f_low - slack), np.floor(f_high + slack)
    span = np.where(first == last, f_high - f_low + 2 * slack, 1 + 2 * slack)
    most_wrap = np.where(pbc, np.maximum(np.abs(first), np.abs(last)), 0)
    of_wraps = 2 * reach + ((far + 2 * most_wrap)[:, :, None] * np.abs(cells)).sum(axis=1)
    scale = of_wraps + np.abs(cells).sum(axis=1)
    pad = ROUNDINGS * eps * (scale.sum(axis=1) + cutoff)
    width = (cutoff + pad) * (1 + 1e-9)
    images = np.where(pbc, np.floor(width[:, None] * lengths + span), 0).astype(np.int64)
    # wrapped places: what is left without the periodic parts, and up to one cell more
    rest = np.eye(3) - np.einsum("nax,nay->nxy", cells * pbc[:, :, None], duals)
    sides = np.sort(np.stack([rest * low[:, None], rest * high[:, None]]), axis=0)
    cell_low = (np.minimum(cells, 0) * pbc[:, :, None]).sum(axis=1) - width[:, None] * 1e-6
    cell_high = (np.maximum(cells, 0) * pbc[:, :, None]).sum(axis=1) + width[:, None] * 1e-6
    box_low, box_high = sides[0].sum(axis=2) + cell_low, sides[1].sum(axis=2) + cell_high
    with np.errstate(over="ignore"):
        bins = (np.floor((np.where(pbc.any(axis=1)[:, None], box_high - box_low, high - low)) / width[:, None]) + 1).prod(axis=1)
    if algorithm == "cell_list" and ((ROUNDINGS * eps * of_wraps.max(axis=1) > cutoff) | (bins > MOST_BINS) | (bins > MOST_BINS_PER_IMAGE * n * (2.0 * far + 1).prod(axis=1)))[n > 0].any():
        raise RuntimeError(BAD_BINS)
    small = n <= most_whole
    kind = np.where(small, WHOLE, GROUPS if algorithm == "brute_force" else BLOCKS)
    extent = np.maximum(box_high - box_low, width[:, None])
    share = max(1, most_whole // 2)
    block = np.maximum(2 * width, np.cbrt(extent.prod(axis=1) * (share / np.maximum(n, 1))))
    blocks = np.floor(extent / block[:, None]).astype(np.int64) + 1
    return {"far": far, "duals": duals, "images": images, "width": width, "kind": kind, "low": box_low, "high": box_high, "block": block, "blocks": blocks, "groups": -(-n // share)}


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def scalar_structures(structures: DataFrame) -> DataFrame:
    """structure_id, the cell's nine numbers as double and three flags."""
    cell = [F.col("cell")[k][m].cast("double").alias(f"c_{a}{x}") for k, a in enumerate(AXES) for m, x in enumerate(XYZ)]
    return structures.select("structure_id", *cell, *(F.col("pbc")[k].alias(f"p_{a}") for k, a in enumerate(AXES)))


def matrix(batch: pa.RecordBatch, names: list[str], kind=np.float64) -> np.ndarray:
    """Columns side by side; nulls of numbers become NaN."""
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1).astype(kind)


def mapped(rows: DataFrame, add, added: str) -> DataFrame:
    """``rows`` and the columns that ``add`` makes of each batch (name to array)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = add(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v) for v in new.values())], [*batch.schema.names, *new])

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, {added}")


def with_geometry(structures: DataFrame, counts: DataFrame, cutoff: float) -> DataFrame:
    """Of each structure with atoms (counts: structure_id, n_atoms): cell,
    flags, duals, ``r_a..r_c`` images to each side, ``n_images``."""
    rows = scalar_structures(structures).join(counts, "structure_id", "left").withColumn("n_atoms", F.coalesce("n_atoms", F.lit(0)).cast("long"))

    def add(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        duals, far = checked_duals(matrix(batch, CELL).reshape(-1, 3, 3), matrix(batch, PERIODIC, bool), batch.column("n_atoms").to_numpy(), cutoff)
        return dict(zip(DUAL, duals.reshape(-1, 9).T.copy())) | {f"r_{a}": far[:, k].copy() for k, a in enumerate(AXES)} | {"n_images": (2.0 * far + 1).prod(axis=1)}

    added = [*(f"{d} double" for d in DUAL), *(f"r_{a} long" for a in AXES), "n_images double"]
    return mapped(rows, add, ", ".join(added)).where("n_atoms > 0")


def image_table(structures: DataFrame) -> DataFrame:
    """A row (structure_id, na, nb, nc) for each image in range."""
    out = structures
    for a in AXES:
        out = out.withColumn(f"n{a}", F.explode(F.sequence(-F.col(f"r_{a}"), F.col(f"r_{a}"))))
    return out.select("structure_id", *(F.col(f"n{a}").cast("int").alias(f"n{a}") for a in AXES))


def is_single(atoms: DataFrame) -> bool:
    return all(isinstance(atoms.schema[x].dataType, FloatType) for x in XYZ)
