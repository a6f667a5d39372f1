"""Rows in a global order, numbered without a window over whole groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import written

#: Rows in a block of consecutive numbers: no block meets more rows than that in one group.
BLOCK_BITS = 10


def placed(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``at``: a number that rises with ``order`` (ascending, nulls first).

    Rows are range-partitioned over all of ``order`` and their place in the
    input, so that a group with a third of all rows, or as many equal rows,
    spans several partitions.  Inside a partition the numbers have no gaps
    and a new partition starts at a new block, so ``shiftright(at,
    BLOCK_BITS)`` cuts every group into runs of at most 1024 rows.  The
    result is written to the shared folder: a retry sees the same numbers.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    given = rows.withColumn("_row", F.monotonically_increasing_id())
    dealt = given.repartitionByRange(*keys, F.col("_row")).sortWithinPartitions(*keys, F.col("_row")).drop("_row")
    return written(dealt.withColumn("at", F.monotonically_increasing_id()), label)


def block(at: str = "at"):
    return F.shiftright(F.col(at), BLOCK_BITS)
