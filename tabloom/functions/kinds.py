"""Column classes from the schema, and NaN normalisation on entry.

Every column is exactly one of ``numeric``, ``boolean``, ``datetime`` or
``categorical``.  Classification reads only ``df.schema``: no job runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = "numeric"
BOOLEAN = "boolean"
DATETIME = "datetime"
CATEGORICAL = "categorical"

_NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, _NUMERIC_TYPES):
        return NUMERIC
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, _DATETIME_TYPES):
        return DATETIME
    return CATEGORICAL


def column_kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def columns_of(df: DataFrame, *kinds: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) in kinds]


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def normalize_missing(df: DataFrame) -> DataFrame:
    """Turn NaN into null in float/double columns (missing = null or NaN).

    ±inf stays a value.  A pure projection; no job.
    """
    fields = df.schema.fields
    if not any(is_floating(f.dataType) for f in fields):
        return df
    cols = [
        F.when(F.isnan(F.col(q(f.name))), F.lit(None).cast(f.dataType)).otherwise(F.col(q(f.name))).alias(f.name)
        if is_floating(f.dataType)
        else F.col(q(f.name))
        for f in fields
    ]
    return df.select(*cols)


def q(name: str) -> str:
    """Back-quote a column name for use in ``F.col``/SQL text."""
    return "`" + name.replace("`", "``") + "`"


def as_text(c: Column, dtype: T.DataType) -> Column:
    """Render a value as text for value counts (nested types as JSON)."""
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if isinstance(dtype, T.BinaryType):
        return F.base64(c)
    return c.cast("string")
