"""Helpers shared by the registered queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...sources.readers import balanced
from ..faults import FAULTY_ORDERS, for_duckdb

DIGITS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return balanced(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def faulty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FAULTY_ORDERS, orders=table(spark, sf_dir, "orders"))


FAULTY_ORDERS_CTE = "faulty AS (" + for_duckdb(FAULTY_ORDERS) + ")"


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column and widen every integer column to bigint, so
    both engines hash the same values."""
    cols = []
    for f in df.schema.fields:
        c = F.col("`" + f.name + "`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            cols.append((F.round(c.cast("double"), digits) + F.lit(0.0)).alias(f.name))
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            cols.append(c.cast("long").alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def r(expr: str, digits: int = DIGITS) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
