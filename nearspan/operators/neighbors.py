"""All pairs of points of a structure nearer than a cutoff, images included.

The logical operator is a self-join of each structure's points on a distance.
One aggregate of the points (numbers and bounds by structure, partial before its
exchange) decides how each structure is searched. A structure of few points is
dealt to one task, many to a task; one of many points is cut into blocks of
space of about equal numbers of points, to which points of other blocks, or
their images, are dealt where they lie within the cutoff of it. A structure of
any size so spreads over all tasks, and no task gets more than blocks. A batch
of whole groups is then searched by one call of the array kernel, which ends in
the exact predicate on the points as given.

Plan: a scan and a partial aggregate; a scan, the join with one row a structure
(which Spark sends to all tasks if it is small), and one exchange of the points
by structure and block. The pairs are made where they are found: nothing is
exchanged after them but for ``sorted``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arguments import checked
from .geometry import AXES, BLOCKS, BOUNDS, CELL, DUAL, GROUPS, PERIODIC, XYZ, is_single, mapped, matrix, moved, scalar_structures, search_plan, wraps_of
from .kernel import BOTH, RAW, SOURCE, TARGET, Points, Search, images

#: Points of a structure up to which one task searches it.
MOST_WHOLE = 8192
#: Points searched in one call, and held of a group that has more.
CALL_POINTS, HELD_POINTS = 32_768, 1 << 18

SHIFT = ["sx", "sy", "sz"]
_WRAP, _PLACE = [f"w_{a}" for a in AXES], [f"w{x}" for x in XYZ]


def bounds(points: DataFrame) -> DataFrame:
    """Number and bounds of each structure's points; a coordinate that is null
    or not finite makes its bounds so."""
    place = [F.coalesce(F.col(x).cast("double"), F.lit(float("nan"))) for x in XYZ]
    # NaN is above all numbers for max; the least of x and the negative largest of -x agree but for it
    low = [(-F.max(-p)).alias(f"min_{x}") for x, p in zip(XYZ, place)]
    return points.groupBy("structure_id").agg(F.count("*").alias("n_atoms"), *low, *(F.max(p).alias(f"max_{x}") for x, p in zip(XYZ, place)))


def _planned(structures: DataFrame, sums: DataFrame, cutoff: float, eps: float, algorithm: str, most_whole: int) -> DataFrame:
    """A row for each structure with points: how it is searched."""
    rows = scalar_structures(structures).join(sums, "structure_id", "left").withColumn("n_atoms", F.coalesce("n_atoms", F.lit(0)).cast("long"))
    rows = rows.withColumns({b: F.when(F.col("n_atoms") == 0, F.lit(0.0)).otherwise(F.col(b)) for b in BOUNDS})

    def add(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        box = matrix(batch, BOUNDS)
        plan = search_plan(matrix(batch, CELL).reshape(-1, 3, 3), matrix(batch, PERIODIC, bool), batch.column("n_atoms").to_numpy(), box[:, :3], box[:, 3:], cutoff, eps, algorithm, most_whole)
        out = dict(zip(DUAL, plan["duals"].reshape(-1, 9).T.copy()))
        out |= {f"r_{a}": plan["images"][:, k].astype(np.int32) for k, a in enumerate(AXES)}
        out |= {f"{n}_{x}": plan[n][:, k].copy() for n in ("low", "high", "blocks") for k, x in enumerate(XYZ)}
        return out | {"width": plan["width"], "block": plan["block"], "kind": plan["kind"].astype(np.int32), "groups": plan["groups"].astype(np.int64)}

    added = [*(f"{d} double" for d in DUAL), *(f"r_{a} int" for a in AXES), *(f"{n}_{x} double" for n in ("low", "high") for x in XYZ), *(f"blocks_{x} long" for x in XYZ), "width double, block double, kind int, groups long"]
    return mapped(rows, add, ", ".join(added)).where("n_atoms > 0").drop("n_atoms", *BOUNDS)


_DEALT = ["group", "role", "atom_id", *XYZ, *_WRAP, *_PLACE, *CELL, *(f"r_{a}" for a in AXES), "width"]


def _dealt(own: DataFrame, single: bool) -> DataFrame:
    """Rows of points and images, dealt to the groups that need them."""
    kind = "float" if single else "double"
    source = own.schema["structure_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, duals = matrix(batch, CELL).reshape(-1, 3, 3), matrix(batch, DUAL).reshape(-1, 3, 3)
            raw = matrix(batch, list(XYZ))
            wraps = wraps_of(raw, duals, matrix(batch, PERIODIC, bool))
            ids = batch.column("atom_id").to_numpy()
            own = Points(np.zeros(len(ids), np.int64), ids, raw, moved(raw, -wraps, cells), wraps)
            how = batch.column("kind").to_numpy()

            def rows(at: np.ndarray, group: np.ndarray, role: int, points: Points) -> pa.RecordBatch:
                """Rows of the batch's points ``at`` with what became of them."""
                taken = batch.take(pa.array(at))
                arrays = {"group": pa.array(group), "role": pa.array(np.full(len(at), role, np.int32))}
                arrays |= {w: pa.array(points.shift[:, k].copy()) for k, w in enumerate(_WRAP)} | {w: pa.array(points.place[:, k].copy()) for k, w in enumerate(_PLACE)}
                return pa.RecordBatch.from_arrays([taken.column("structure_id"), *(arrays[n] if n in arrays else taken.column(n) for n in _DEALT)], ["structure_id", *_DEALT])

            whole = np.flatnonzero(how < BLOCKS)
            if len(whole):
                yield rows(whole, np.zeros(len(whole), np.int64), BOTH, own.take(whole))
            some = np.flatnonzero(how == BLOCKS)
            if len(some):
                low, high, count = (matrix(batch, [f"{n}_{x}" for x in XYZ])[some] for n in ("low", "high", "blocks"))
                count, width, block = count.astype(np.int64), batch.column("width").to_numpy()[some, None], batch.column("block").to_numpy()[some, None]
                at = lambda place, row: np.clip(np.floor((place - low[row]) / block[row]).astype(np.int64), 0, count[row] - 1)
                number = lambda b, row: (b[:, 0] * count[row, 1] + b[:, 1]) * count[row, 2] + b[:, 2]
                here = np.arange(len(some))
                yield rows(some, number(at(own.place[some], here), here), SOURCE, own.take(some))
                ranges = matrix(batch, [f"r_{a}" for a in AXES], np.int64)[some]
                for row, made in images(own.take(some), cells[some], ranges, low - width, high + width):
                    first, last = at(made.place - width[row], row), at(made.place + width[row], row)
                    for step in range(8):  # a block is two widths wide: at most two along an axis
                        b = first + [step >> 2 & 1, step >> 1 & 1, step & 1]
                        fits = np.flatnonzero((b <= last).all(axis=1))
                        if len(fits):
                            yield rows(some[row[fits]], number(b[fits], row[fits]), TARGET, made.take(fits))
            some = np.flatnonzero(how == GROUPS)
            if len(some):
                groups = batch.column("groups").to_numpy()[some]
                yield rows(some, ids[some] % groups, SOURCE, own.take(some))
                upto = np.cumsum(groups)
                row = np.repeat(np.arange(len(some)), groups)
                for begin in range(0, len(row), CALL_POINTS):
                    part = slice(begin, begin + CALL_POINTS)
                    of = row[part]
                    yield rows(some[of], np.arange(begin, begin + len(of)) - (upto - groups)[of], RAW, own.take(some[of]))

    names = {"group": "long", "role": "int", "atom_id": "long", **dict.fromkeys(XYZ, kind), **dict.fromkeys(_WRAP, "long"), **dict.fromkeys(_PLACE, "double"), **dict.fromkeys(CELL, "double"), **{f"r_{a}": "int" for a in AXES}, "width": "double"}
    return own.mapInArrow(run, f"structure_id {source}, " + ", ".join(f"{n} {names[n]}" for n in _DEALT))


def _searched(dealt: DataFrame, search: Search, single: bool) -> DataFrame:
    """Pairs of each group; groups come one after another, sources first."""
    kind = np.float32 if single else np.float64
    source = dealt.schema["structure_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(rows: pa.Table | pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            group = _numbered(rows)
            heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            points = Points(group, rows.column("atom_id").to_numpy(), matrix(rows, list(XYZ), kind), matrix(rows, _PLACE), matrix(rows, _WRAP, np.int64))
            first = rows.take(pa.array(heads))
            cells, ranges, width = matrix(first, CELL).reshape(-1, 3, 3), matrix(first, [f"r_{a}" for a in AXES], np.int64), first.column("width").to_numpy()
            names = first.column("structure_id").combine_chunks()
            for g, i, j, shift, d in search.search(points, rows.column("role").to_numpy(), cells, ranges, width):
                arrays = [names.take(pa.array(g)), pa.array(i), pa.array(j), *(pa.array(shift[:, k].copy()) for k in range(3)), *(pa.array(d[:, k].copy()) for k in range(3))]
                yield pa.RecordBatch.from_arrays(arrays, ["structure_id", "i", "j", *SHIFT, "dx", "dy", "dz"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < CALL_POINTS:
                continue
            rows = pa.Table.from_batches(held)
            group = _numbered(rows)
            cut = int(np.searchsorted(group, group[-1]))  # the last group may go on
            if cut:
                yield from found(rows.slice(0, cut))
                rows = rows.slice(cut)
            if rows.num_rows > HELD_POINTS and rows.column("role")[-1].as_py() in (TARGET, RAW):
                yield from found(rows)  # sources stay, the targets seen are done
                role = rows.column("role").to_numpy()
                rows = rows.slice(0, int((role == SOURCE).sum()))
            held = rows.to_batches()
        if held:
            yield from found(pa.Table.from_batches(held))

    number = "float" if single else "double"
    return dealt.mapInArrow(run, f"structure_id {source}, i long, j long, sx int, sy int, sz int, dx {number}, dy {number}, dz {number}")


def _numbered(rows: pa.Table) -> np.ndarray:
    """Numbers of the groups of rows in order."""
    n, fresh = rows.num_rows, np.zeros(rows.num_rows, np.int64)
    for c in ("structure_id", "group"):
        column = rows.column(c).combine_chunks()
        fresh[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.cumsum(fresh)


def neighbor_pairs(
    atoms: DataFrame,
    structures: DataFrame,
    cutoff: float,
    *,
    algorithm: str = "auto",
    cpu_threads: int | None = None,
    sorted: bool = False,
    half_list: bool = False,
    include_self: bool = False,
    most_whole: int = MOST_WHOLE,
) -> DataFrame:
    """Pairs as scalar columns: structure_id, i, j, sx, sy, sz, d, dx, dy, dz.

    atoms: structure_id, atom_id (unique over all), x, y, z (all float: float
    arithmetic; else double). structures: structure_id, cell (rows of numbers),
    pbc (three booleans). Pairs at exactly the cutoff are left out. Argument
    errors raise at once; errors in data raise when the result is computed.
    """
    checked(cutoff=cutoff, algorithm=algorithm, cpu_threads=cpu_threads, sorted=sorted, half_list=half_list, include_self=include_self)
    cutoff = float(cutoff)
    single = is_single(atoms)
    eps = float(np.finfo(np.float32 if single else np.float64).eps)
    points = atoms.select("structure_id", F.col("atom_id").cast("long").alias("atom_id"), *(F.col(x) if single else F.col(x).cast("double").alias(x) for x in XYZ))
    plan = _planned(structures, bounds(points), cutoff, eps, algorithm, most_whole)
    dealt = _dealt(points.join(plan, "structure_id"), single)
    key = ["structure_id", "group"]
    # as many tasks as asked for, else as Spark finds fit
    dealt = dealt.repartition(min(cpu_threads, 1 << 16), *key) if cpu_threads else dealt.repartition(*key)
    search = Search(cutoff, half_list, include_self, by_bins=algorithm != "brute_force")
    pairs = _searched(dealt.sortWithinPartitions(*key, "role"), search, single)
    dx, dy, dz = (F.col(f"d{x}") for x in XYZ)
    distance = F.sqrt((dx * dx + dy * dy) + dz * dz)
    out = pairs.select("structure_id", "i", "j", *SHIFT, (distance.cast("float") if single else distance).alias("d"), "dx", "dy", "dz")
    return out.orderBy("i", "j", *SHIFT) if sorted else out


def project(pairs: DataFrame, quantities: str) -> DataFrame:
    """Columns in the order asked for; a repeated one gets a suffix."""
    checked(quantities=quantities)
    of = {
        "i": F.col("i"), "j": F.col("j"), "P": F.array("i", "j"), "S": F.array(*SHIFT), "d": F.col("d"), "D": F.array("dx", "dy", "dz"),
    }
    # names differ from each other even where case doesn't count
    name = {"i": "i", "j": "j", "P": "pair", "S": "shift", "d": "distance", "D": "displacement"}
    seen: dict[str, int] = {}
    out = []
    for q in quantities:
        seen[q] = seen.get(q, 0) + 1
        out.append(of[q].alias(name[q] if seen[q] == 1 else f"{name[q]}_{seen[q]}"))
    return pairs.select(*out)


def neighbor_list(quantities: str, atoms: DataFrame, structures: DataFrame, cutoff: float, **options) -> DataFrame:
    """``neighbor_pairs`` projected to ``quantities``: i, j, P(air), S(hift),
    d(istance), D(isplacement); any order and repeats."""
    checked(quantities=quantities)
    return project(neighbor_pairs(atoms, structures, cutoff, **options), quantities)
