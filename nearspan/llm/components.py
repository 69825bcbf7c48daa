"""Connected components of a table of links, without bringing links to the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, materialize

#: A key of more than one in so many of all rows is heavy: there are at most so
#: many such keys (twice as many where rows count twice), whatever the rows are,
#: so that they can be broadcast.
HEAVY_SHARE = 1000


def spread_join(rows: DataFrame, by_key: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the one row of ``by_key`` (key, n, others) of each row's
    key, if there is one; n is the number of rows of the key, ``total`` that of
    all. Rows of heavy keys stay where they are, so none are one task's."""
    others = [c for c in by_key.columns if c not in (key, "n")]
    heavy = by_key.where(F.col("n") > max(1, total // HEAVY_SHARE)).select(key, F.struct(*others).alias("_heavy"))
    known = rows.join(F.broadcast(heavy), key, "left")
    light = known.where("_heavy is null").drop("_heavy").join(by_key.select(key, *others), key)
    return light.unionByName(known.where("_heavy is not null").select(*rows.columns, *(F.col(f"_heavy.{c}").alias(c) for c in others)))


def _with_least(pairs: DataFrame, n: int) -> DataFrame:
    """pairs (u, v) of ``n`` links; adds m, the least of u and its neighbours,
    from partial sums."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return spread_join(pairs, least, "u", n).withColumn("m", F.least("m", "u"))


#: Nodes that a task joins at a time.
HELD_NODES = 1 << 20


def _contracted(links: DataFrame) -> DataFrame:
    """Links (a, b), a > b, that connect what ``links`` do: of each part that a
    task reads, a star about the least node of each of the part's components."""

    def run(batches):
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = y
            return x

        def stars():
            found = [(x, t) for x in root if (t := top(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = top(a), top(b)
                root[max(a, b)] = root[min(a, b)] = min(a, b)
            if len(root) >= HELD_NODES:
                yield stars()
                root.clear()
        if root:
            yield stars()

    return links.mapInArrow(run, "a long, b long")


def _large_star(links: DataFrame, n: int) -> DataFrame:
    """Links (a, b), a > b: each node's larger neighbours move to its least one."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _with_least(both, n).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def _small_star(links: DataFrame, n: int) -> DataFrame:
    """Links (a, b), a > b: each node and its smaller neighbours move to the least of these."""
    small = _with_least(links.select(F.col("a").alias("u"), F.col("b").alias("v")), n)
    own = small.select(F.col("u").alias("a"), F.col("m").alias("b"))
    others = small.select(F.col("v").alias("a"), F.col("m").alias("b"))
    return own.unionByName(others).where("a > b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a, b) of any order, repeated or not. Gives (node, component), the
    least node of its component, for each node but the least ones themselves.
    Each task joins what it reads. What is left of these links is joined by one
    task, if that can hold it; else rounds alternate large and small stars and
    join what a task reads, so that their number is about the logarithm of the
    longest path at most. Each step is written before the next, as its plan reads
    its input several times."""

    def written(rows: DataFrame) -> tuple[DataFrame, tuple]:
        """The table and what tells it from another, seen as it is written."""
        seen = Observation()
        now = materialize(rows.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")), "links")
        return now, (seen.get["n"], seen.get["s"])

    def then(before: DataFrame, rows: DataFrame) -> tuple[DataFrame, tuple]:
        after = written(rows)
        discard(before)
        return after

    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # the exchange keeps this Python step out of tasks of another one, which would need twice the workers
    now, last = written(_contracted(ordered.distinct()).distinct())
    if 2 * last[0] <= HELD_NODES:
        now, _ = then(now, _contracted(now.coalesce(1)))
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(most_rounds):
        now, (n, _) = then(now, _large_star(now, last[0]))
        now, _ = then(now, _small_star(now, n))
        now, found = then(now, _contracted(now).distinct())
        if found == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        last = found
    raise RuntimeError("components did not settle")
