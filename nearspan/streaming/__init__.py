"""Neighbor pairs of a stream of whole structures.

A row has a structure: structure_id, atoms (array of atom_id, x, y, z), cell,
pbc. Each row is judged on its own, so the query keeps no state and needs no
watermark: a late structure is as good as any. ``foreachBatch`` applies the
batch operator, with its choice of join, to each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearspan.operators.neighbors import neighbor_pairs


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """atoms and structures of rows that hold whole structures."""
    atoms = rows.select("structure_id", F.explode("atoms").alias("a")).select("structure_id", "a.atom_id", "a.x", "a.y", "a.z")
    return atoms, rows.select("structure_id", "cell", "pbc")


def neighbor_stream(rows: DataFrame, cutoff: float, sink: Callable[[DataFrame, int], None], **options):
    """A writer of the stream ``rows``; start it after adding a trigger and a
    checkpoint. The sink gets each batch's pairs and its number, which with an
    idempotent write makes results exactly-once."""

    def step(batch: DataFrame, number: int) -> None:
        sink(neighbor_pairs(*split(batch), cutoff, **options), number)

    return rows.writeStream.foreachBatch(step)
