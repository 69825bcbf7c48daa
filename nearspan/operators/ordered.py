"""Running sums and carried values over a whole order, without one task for all.

Rows are dealt to buckets, ranges of the order with bounds from quantiles. A
bucket's own window starts from what the buckets before it come to: one row a
bucket, at most ``BUCKETS``, summed on the driver.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 512
#: Rows of the order in a bucket, about; fewer rows take fewer buckets.
BUCKET_ROWS = 100_000


def bounds_of(rows: DataFrame, order: str, bucket_rows: int = BUCKET_ROWS) -> list[float]:
    n = min(BUCKETS, rows.count() // bucket_rows + 1)
    return sorted(set(rows.approxQuantile(order, [k / n for k in range(1, n)], 1 / (4 * n)))) if n > 1 else []


def bucket(order: str, bounds: list[float]) -> Column:
    # bounds as an array, and one comparison with each, stay an expression
    return F.size(F.filter(F.array(*(F.lit(b) for b in bounds)).cast("array<double>"), lambda b: b <= F.col(order).cast("double"))) if bounds else F.lit(0)


def _looked_up(values: dict[int, object], kind: str) -> Column:
    entries = [F.lit(x) for pair in values.items() for x in pair]
    return F.create_map(*entries)[F.col("_bucket")].cast(kind) if entries else F.lit(None).cast(kind)


def running_sum(rows: DataFrame, order: str, value: str, into: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds the sum of ``value`` up to each row in the order of ``order`` (unique)."""
    own = rows.withColumn("_bucket", bucket(order, bounds_of(rows, order, bucket_rows)))
    sums = {r["_bucket"]: r["s"] for r in own.groupBy("_bucket").agg(F.sum(value).alias("s")).collect()}
    keys = sorted(sums)
    before = dict(zip(keys, accumulate((sums[k] for k in keys[:-1]), initial=0)))
    upto = F.sum(value).over(Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn(into, upto + _looked_up(before, "long")).drop("_bucket")


def carried(rows: DataFrame, marks: DataFrame, order: str, value: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows (order) with the value of the last mark (order, value) at or before each."""
    bounds = bounds_of(rows.select(order), order, bucket_rows)
    kind = marks.schema[value].dataType.simpleString()
    both = marks.select(order, value, F.lit(0).alias("_kind")).unionByName(rows.select(order, F.lit(None).cast(kind).alias(value), F.lit(1).alias("_kind")))
    both = both.withColumn("_bucket", bucket(order, bounds))
    last = {r["_bucket"]: r["v"] for r in both.where("_kind = 0").groupBy("_bucket").agg(F.max_by(value, order).alias("v")).collect()}
    before, held = {}, None
    for k in range(len(bounds) + 1):
        if held is not None:
            before[k] = held
        held = last.get(k, held)
    window = Window.partitionBy("_bucket").orderBy(order, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = F.coalesce(F.last(value, ignorenulls=True).over(window), _looked_up(before, kind))
    return both.withColumn("_found", found).where("_kind = 1").select(order, F.col("_found").alias(value))
