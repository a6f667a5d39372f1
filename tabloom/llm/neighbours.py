"""Next and previous row in a global order, without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import written


def neighbours(rows: DataFrame, order: list[str], carry: list[str], wrap: bool = False) -> DataFrame:
    """``rows`` with structs ``before`` and ``after``: the ``carry`` columns of the adjacent rows (null at the ends).

    ``order`` names columns (ascending, nulls last) that tell all rows
    apart.  Rows are range-partitioned and sorted; only the first and last
    row of each partition meet in one place.  With ``wrap`` the last row is
    followed by the first.
    """
    keys = [F.col(c).asc_nulls_last() for c in order]
    placed = written(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "order")
    own = Window.partitionBy("_part").orderBy(*keys)
    me = F.struct(*carry)
    inside = placed.withColumns({"before": F.lag(me).over(own), "after": F.lead(me).over(own)})
    rank = F.struct(*(x for c in order for x in (F.col(c).isNull().alias(f"n_{c}"), F.col(c))))
    # one row for each partition
    ends = placed.groupBy("_part").agg(F.min_by(me, rank).alias("first"), F.max_by(me, rank).alias("final"))
    line = Window.orderBy("_part")
    joint = ends.select(
        F.col("_part").alias("_p"), F.lag("final").over(line).alias("_b"), F.lead("first").over(line).alias("_a"),
        *([F.last("final").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_z"),
           F.first("first").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_f")] if wrap else []),
    )
    joined = inside.join(F.broadcast(joint), F.col("_part") == F.col("_p"))
    before, after = F.coalesce("before", "_b"), F.coalesce("after", "_a")
    if wrap:
        before, after = F.coalesce(before, "_z"), F.coalesce(after, "_f")
    return joined.select(*rows.columns, before.alias("before"), after.alias("after"))
