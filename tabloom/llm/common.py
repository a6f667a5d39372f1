"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Largest size (bytes) of anything an operator broadcasts; beyond it the
#: operators work in blocks or with a shuffle join.
BROADCAST_BYTES = 32 << 20

#: crc32 of an ASCII string ``{}`` in DuckDB, which has no such function: bit by bit over its characters.
CRC32 = """xor(list_reduce(list_transform(string_split({}, ''), lambda c: ord(c)::BIGINT), lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END), 4294967295::BIGINT), 4294967295)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4 (a null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def row_key(id_col: str, text_col: str) -> Column:
    """Key of a row's id and text."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("-"))).cast("binary"))


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it again.

    Cuts the lineage with a table that every executor can read, so a lost
    executor costs at most the tasks it was running.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(taken: list[str], stem: str) -> str:
    """``stem``, lengthened until no column is called so (Spark's names ignore case)."""
    used = {c.lower() for c in taken}
    while stem.lower() in used:
        stem += "_"
    return stem


def utf8_slices(column, max_bytes: int = 2 << 20):
    """Yield (first row, one past last, offsets, bytes) slices of an Arrow string column.

    ``bytes`` is a uint8 view of the slice's UTF-8 data and ``offsets`` the
    rows' starts in it (one more than rows).  Null rows have length 0.  A
    slice holds at most ``max_bytes`` unless one row alone is longer.
    """
    import pyarrow as pa

    col = column.cast(pa.large_string()).fill_null("")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return
    _, off_buf, data_buf = col.buffers()
    off = np.frombuffer(off_buf, dtype=np.int64)[col.offset: col.offset + n + 1]
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, off[lo: hi + 1] - off[lo], data[off[lo]: off[hi]]
        lo = hi


def in_parts(batch, max_bytes: int = 2 << 20):
    """Yield consecutive slices of an Arrow batch, of some ``max_bytes`` if its rows are alike."""
    step = max(1, len(batch) * max_bytes // max(batch.nbytes, 1))
    for lo in range(0, len(batch), step):
        yield batch.slice(lo, step)


#: Tables that operators keep in a worker process from task to task.
_KEPT: list[dict] = []


def kept_in_worker() -> dict:
    """A dictionary for what an operator keeps in a worker process; other operators' tasks empty it (``release_memory``)."""
    _KEPT.append({})
    return _KEPT[-1]


def release_memory(own: dict | None = None) -> None:
    """Give freed memory back to the system: a worker that waits for its next task keeps none of the last one's.

    What operators keep from task to task goes as well, but for ``own``: a
    worker that goes on with another operator doesn't hold both's tables.
    """
    import ctypes

    import pyarrow as pa

    for kept in _KEPT:
        if kept is not own:
            kept.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def with_python_columns(df: DataFrame, inputs: list[str], outputs: dict[str, str], make, drop: tuple[str, ...] = (), release=release_memory) -> DataFrame:
    """``df`` with columns computed in Python, batch by batch.

    ``make()`` is called once in each task and returns a function of the
    ``inputs`` as lists, which returns the ``outputs`` (name -> type, with
    names that may replace columns) as lists in the same order.  It is called
    with a slice of a few MB at a time.  The other columns pass through as
    they are, whatever their types and nulls.  ``release`` is called before
    and after a task's rows.
    """
    import pyarrow as pa

    kinds = {
        "string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()),
        "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<array<int>>": pa.list_(pa.list_(pa.int32())),
    }
    keep = [c for c in df.columns if c not in outputs and c not in drop]

    def run(batches):
        release()
        function = make()
        for batch in batches:
            for part in in_parts(batch):
                got = function(*(part.column(c).to_pylist() for c in inputs))
                made = [pa.array(x, kinds[t]) for x, t in zip(got, outputs.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=[*keep, *outputs])
        release()

    schema = df.select(*keep, *(F.lit(None).cast(t).alias(c) for c, t in outputs.items())).schema
    return df.mapInArrow(run, schema)
