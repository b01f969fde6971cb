"""Running sums over a whole table in the order of a key, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task orders, about; keys drawn for each range.
ROWS_PER_TASK = 1 << 20
DRAWN = 64


def running(rows: DataFrame, key: str, amount: str, name: str, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """rows, whose keys differ, with `name`: the sum of `amount` over all rows of smaller keys (null the smallest).

    A few keys are drawn by a hash as bounds of ranges; each range is summed within a task and shifted by the sums of the
    ranges before it. A bound and a sum for each range come to the driver.
    """
    many = rows.count()
    parts = -(-many // per_task)
    bounds: list = []
    if parts > 1:
        slots = 1 << 20
        share = max(1, min(slots, slots * DRAWN * parts // many))
        drawn = [r[0] for r in rows.select(key).where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(slots)) < share)).orderBy(key).collect()]
        bounds = drawn[:: max(1, -(-len(drawn) // parts))][1:]
    kind = rows.schema[key].dataType
    limits = F.array(*(F.lit(b).cast(kind) for b in bounds)) if bounds else F.array().cast(f"array<{kind.simpleString()}>")
    placed = rows.withColumn("__range", F.coalesce(F.size(F.filter(limits, lambda b: b <= F.col(key))), F.lit(0)))
    sums = {r[0]: r[1] for r in placed.groupBy("__range").agg(F.sum(amount)).collect()}
    before, total = [], 0
    for k in range(len(bounds) + 1):
        before.append(total)
        total += sums.get(k) or 0
    shift = F.element_at(F.array(*(F.lit(b).cast("bigint") for b in before)), F.col("__range") + 1)
    inside = F.sum(amount).over(Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    return placed.select(*rows.columns, (F.coalesce(inside, F.lit(0)) + shift).cast("bigint").alias(name))
