"""Numbers for rows in a global order, without a window over all rows.

Rows are range-partitioned and sorted; inside a partition a number without
gaps comes from the row's place, and the partitions' sizes (one number per
partition, the only thing the driver sees) shift it.  The order is written
to the shared checkpoint folder first, so a retried task sees the same
numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

PLACE = (1 << 33) - 1


def placed(df: DataFrame, order: list[Column]) -> tuple[DataFrame, dict[int, int]]:
    """``df`` in order with ``_part`` and ``_pos`` (place in the partition, from 0), and the rows of each partition.

    Rows that are equal in ``order`` keep the order of the input, and so are spread as well.
    """
    order = [*order, F.col("_row")]
    dealt = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_row")
    out = stored(dealt.withColumns({"_part": F.spark_partition_id(), "_pos": F.monotonically_increasing_id().bitwiseAND(F.lit(PLACE))}))
    sizes = {r["_part"]: r["n"] for r in out.groupBy("_part").agg((F.max("_pos") + 1).alias("n")).collect()}
    return out, sizes


def shifted(sizes: dict[int, int], step: int = 1) -> tuple[Column, int]:
    """For each ``_part`` the units of ``step`` rows before it (a partition starts a new one), and their total."""
    before, total = [0] * (max(sizes, default=0) + 1), 0
    for part in sorted(sizes):
        before[part] = total
        total += -(-sizes[part] // step)
    return F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("_part") + 1), total


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in ``order``."""
    rows, sizes = placed(df, order)
    before, _ = shifted(sizes)
    return rows.withColumn(name, before + F.col("_pos")).drop("_part", "_pos")
