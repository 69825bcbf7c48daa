"""The neighbor operator over arrays: one call from arrays to arrays.

The arrays are at hand, so all errors in data are found before any job runs, in
a fixed order; only a pair's shift out of range shows in the job itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .arguments import checked
from .geometry import BAD_SHIFT, MOST_IMAGES, TOO_MANY_IMAGES, checked_duals, search_plan, wraps_of
from .neighbors import MOST_WHOLE, neighbor_pairs


def as_numpy(x, name: str) -> np.ndarray:
    """A NumPy array, or a CPU tensor of a library with ``detach`` and ``numpy``."""
    if isinstance(x, np.ndarray):
        return x
    if hasattr(x, "detach") and hasattr(x, "numpy"):
        return x.detach().cpu().numpy()
    raise TypeError(f"{name} must be an array")


def checked_arrays(positions, cell, pbc, batch_ptr):
    positions, cell, pbc = (as_numpy(x, n) for x, n in ((positions, "positions"), (cell, "cell"), (pbc, "pbc")))
    if positions.ndim != 2 or positions.shape[1] != 3:
        raise ValueError("positions must have shape (N, 3)")
    if positions.dtype not in (np.float32, np.float64):
        raise ValueError("positions must be float32 or float64")
    if batch_ptr is None:
        if cell.shape != (3, 3) or pbc.shape != (3,):
            raise ValueError("cell and pbc must have shapes (3, 3) and (3,)")
        cell, pbc, ptr = cell[None], pbc[None], np.array([0, len(positions)], np.int64)
    else:
        ptr = as_numpy(batch_ptr, "batch_ptr")
        if ptr.ndim != 1 or len(ptr) < 1 or ptr.dtype != np.int64:
            raise ValueError("batch_ptr must be a vector of int64")
        if cell.shape != (len(ptr) - 1, 3, 3) or pbc.shape != (len(ptr) - 1, 3):
            raise ValueError("cell and pbc must have shapes (B, 3, 3) and (B, 3)")
    if cell.dtype != positions.dtype:
        raise ValueError("cell and positions must have one dtype")
    if pbc.dtype != np.bool_:
        raise ValueError("pbc must be bool")
    check_offsets(ptr, len(positions))
    return positions, cell, pbc, ptr


def check_offsets(ptr: np.ndarray, n: int) -> None:
    if ptr[0] != 0:
        raise ValueError("batch_ptr must start at zero")
    if (np.diff(ptr) < 0).any():
        raise ValueError("batch_ptr must be nondecreasing")
    if ptr[-1] != n:
        raise ValueError("batch_ptr must end at the number of positions")


def to_frames(spark: SparkSession, positions: np.ndarray, cell: np.ndarray, pbc: np.ndarray, ptr: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """atoms and structures of a batch of arrays; ids count from 0."""
    owner = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    atoms = pa.table({"structure_id": pa.array(owner, pa.int64()), "atom_id": pa.array(np.arange(len(positions))), **{x: pa.array(np.ascontiguousarray(positions[:, k])) for k, x in enumerate("xyz")}})
    kind = pa.from_numpy_dtype(cell.dtype)
    structures = pa.table({
        "structure_id": pa.array(np.arange(len(cell)), pa.int64()),
        "cell": pa.array(cell.tolist(), pa.list_(pa.list_(kind))),
        "pbc": pa.array(pbc.tolist(), pa.list_(pa.bool_())),
    })
    return spark.createDataFrame(atoms), spark.createDataFrame(structures)


def check_data(positions: np.ndarray, cell: np.ndarray, pbc: np.ndarray, ptr: np.ndarray, cutoff: float, algorithm: str) -> None:
    """Raises what the search would, and checks the images of all structures together."""
    n = np.diff(ptr)
    cells = cell.astype(np.float64)
    duals, far = checked_duals(cells, pbc, n, cutoff)
    if (2.0 * far + 1).prod(axis=1)[n > 0].sum() > MOST_IMAGES:
        raise ValueError(TOO_MANY_IMAGES)
    owner, places = np.repeat(np.arange(len(n)), n), positions.astype(np.float64)
    wraps_of(places, duals[owner], pbc[owner])
    some = n > 0
    if some.any():
        heads = ptr[:-1][some]
        low, high = np.minimum.reduceat(places, heads), np.maximum.reduceat(places, heads)
        search_plan(cells[some], pbc[some], n[some], low, high, cutoff, float(np.finfo(positions.dtype).eps), algorithm, MOST_WHOLE)


def neighbor_arrays(spark: SparkSession, quantities: str, positions, cell, pbc, cutoff: float, batch_ptr=None, *, algorithm="auto", cpu_threads=None, sorted=False, half_list=False, include_self=False) -> tuple[np.ndarray, ...]:
    """Arrays in the order of ``quantities``; indices run over all positions.
    Errors in data come as ValueError or RuntimeError."""
    checked(quantities=quantities, algorithm=algorithm, cpu_threads=cpu_threads, sorted=sorted, half_list=half_list, include_self=include_self)
    positions, cell, pbc, ptr = checked_arrays(positions, cell, pbc, batch_ptr)
    checked(cutoff=cutoff)
    check_data(positions, cell, pbc, ptr, float(cutoff), algorithm)
    atoms, structures = to_frames(spark, positions, cell, pbc, ptr)
    try:
        found = neighbor_pairs(atoms, structures, cutoff, algorithm=algorithm, cpu_threads=cpu_threads, sorted=sorted, half_list=half_list, include_self=include_self).toArrow()
    except PySparkException as error:
        if BAD_SHIFT in str(error):
            raise RuntimeError(BAD_SHIFT) from error
        raise
    column = lambda name: found.column(name).to_numpy()
    stack = lambda names, kind: np.stack([column(n) for n in names], axis=1).astype(kind, copy=False).reshape(-1, len(names))
    make = {
        "i": lambda: column("i"), "j": lambda: column("j"), "P": lambda: stack("ij", np.int64), "S": lambda: stack(("sx", "sy", "sz"), np.int32),
        "d": lambda: column("d"), "D": lambda: stack(("dx", "dy", "dz"), positions.dtype),
    }
    return tuple(make[q]() for q in quantities)


def pair_keys(pairs: np.ndarray, shifts: np.ndarray) -> list[tuple[int, ...]]:
    return [tuple(map(int, k)) for k in np.concatenate([pairs, shifts], axis=1)]


def edge_index(pairs: np.ndarray) -> np.ndarray:
    """Pairs (E, 2) as graph libraries take them, (2, E) and contiguous."""
    return np.ascontiguousarray(pairs.T)
