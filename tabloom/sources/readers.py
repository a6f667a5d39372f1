"""Readers (S1–S8): Parquet, CSV with delimiter and encoding detection,
routing by extension, user-registered formats and path checks.

Every reader returns a lazy DataFrame; delimiter, encoding and quoted line
breaks are found by one aggregate over all lines.  Files whose quoted
values hold line breaks are cut into records by ``records`` and stay
splittable.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import DataLoadError
from ..session import ensure_checkpoint_dir, fs_path, spread, stored

DELIMITERS = [",", "\t", ";", "|"]

Reader = Callable[..., DataFrame]
_REGISTRY: dict[str, Reader] = {}


def validate(spark: SparkSession, path: str) -> None:
    """Path exists and its extension has a reader (S8).  Directories are
    allowed: a Spark table is usually a folder of part files."""
    fs, p = fs_path(spark, path)
    if not fs.exists(p):
        raise DataLoadError(f"Dataset file not found: {path}")
    if extension(path) not in _REGISTRY and not fs.getFileStatus(p).isDirectory():
        raise DataLoadError(f"No loader registered for extension '{extension(path)}'. Supported: {supported_extensions()}")


def extension(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    return "." + name.rsplit(".", 1)[-1] if "." in name else ""


def supported_extensions() -> list[str]:
    return sorted(_REGISTRY)


def register(extensions: list[str], reader: Reader) -> None:
    """Register a reader ``fn(spark, path, **options) -> DataFrame`` for file
    extensions (S7).  A later registration of the same extension wins."""
    for e in extensions:
        _REGISTRY[e.lower() if e.startswith(".") else "." + e.lower()] = reader


def balanced(df: DataFrame) -> DataFrame:
    """Spread an input that is read by a single task (one file, one row group) over all cores.

    A row group is read by one task, however many splits its file has: rows are counted by partition (Parquet
    answers that from its footers).  Any other input is returned unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() == 1:
        return df.repartition(cores)
    return spread(df, least_share=2 / cores)


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Route by lower-cased extension (S6); directories read as Parquet."""
    validate(spark, path)
    ext = extension(path)
    reader = _REGISTRY.get(ext)
    if reader is None:
        reader = read_parquet
    return reader(spark, path, **options)


def read_parquet(spark: SparkSession, path: str, **options) -> DataFrame:
    """Parquet (S5); column pruning and filter pushdown come from Catalyst."""
    return spark.read.options(**options).parquet(path)


def csv_facts(spark: SparkSession, path: str) -> dict:
    """``encoding``, ``delimiter`` and ``multiline`` of a CSV file.

    The delimiter (comma, tab, semicolon, pipe) is the one that appears most
    often outside quotes and the same non-zero number of times in every
    non-empty record.  Records are lines, unless lines have unmatched quotes
    (a value continues on the next line): then the file is multi-line and
    its records are found first.  The encoding is UTF-8 unless some line's
    bytes aren't, then ISO-8859-1.
    """
    line = F.col("value")
    row = spark.read.text(path).agg(
        F.max(~F.expr("is_valid_utf8(value)")).alias("bad"), F.max(_quotes(line) % 2 == 1).alias("open"), *_delimiter_counts(line)
    ).first()
    encoding = "ISO-8859-1" if row["bad"] else "UTF-8"
    if row["open"]:
        row = records(spark, path, encoding).select(F.col("record").alias("value")).agg(*_delimiter_counts(line), F.lit(True).alias("open")).first()
    steady = [(row[f"lo{i}"], -i) for i in range(len(DELIMITERS)) if row[f"lo{i}"] and row[f"lo{i}"] == row[f"hi{i}"]]
    return {"encoding": encoding, "delimiter": DELIMITERS[-max(steady)[1]] if steady else ",", "multiline": bool(row["open"])}


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def _delimiter_counts(text: Column) -> list[Column]:
    """Least and most of each delimiter outside quotes, over texts with matched quotes."""
    bare = F.regexp_replace(text, '"[^"]*"', "")
    whole = (F.trim(text) != "") & (_quotes(text) % 2 == 0)
    counts = [F.when(whole, F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))) for d in DELIMITERS]
    return [x for i, c in enumerate(counts) for x in (F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"))]


def records(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(path, block, place, record): the CSV records of a file whose quoted values hold line breaks, read by many tasks.

    A line begins a record if an even number of quotes precedes it in its
    file.  Each split's number of quotes is counted first; the prefix sums
    over a file's splits (one row a split) tell every split whether it
    begins inside a value.  A second pass joins the lines of a record; only
    the ends of splits, where a record may go on in the next one, are put
    together afterwards.  ``(path, block, place)`` is the file's order.
    """
    text = (
        spark.read.option("lineSep", "\n").option("encoding", encoding).text(path)
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    )
    splits = text.groupBy("path", "block").agg((F.sum(_quotes(F.col("value"))) % 2).alias("odd"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = stored(splits.select("path", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside")))
    # one row for each split of at most 128 MB, some hundred bytes; the lines keep their order
    lines = text.join(F.broadcast(inside), ["path", "block"]).select("path", "block", "value", "inside")
    schema = "path string, block long, place long, record string, head boolean, open boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out, place, odd, size = None, [], [], 0, False, 0

        def close(open_: bool) -> None:
            """The record that has been collected; the first one of a split may be the rest of an earlier one."""
            nonlocal held, place
            if held:
                out.append((*now, place, "\n".join(held), head, open_))
                place += 1
                held = []

        def packed() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["path", "block", "place", "record", "head", "open"])

        head = False
        for batch in batches:
            for file, block, value, starts_inside in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != now:
                    if now is not None:
                        close(odd)
                    now, place, odd, head = (file, block), 0, starts_inside, starts_inside
                if not odd and held:
                    close(False)
                    head = False
                held.append(value)
                odd ^= value.count('"') % 2 == 1
                size += len(value)
                if size > 1 << 20 and out:
                    yield packed()
                    out, size = [], 0
        if now is not None:
            close(odd)
        if out:
            yield packed()

    cut = stored(lines.mapInArrow(run, schema))
    whole = cut.where("NOT head AND NOT open").select("path", "block", "place", "record")
    # at most two pieces a split: what an earlier split has begun, and what the next one ends
    ends = cut.where("head OR open")
    order = Window.partitionBy("path").orderBy("block", "place")
    number = F.sum(F.when(F.col("head"), 0).otherwise(1)).over(order)
    joined = ends.withColumn("n", number).groupBy("path", "n").agg(
        F.min(F.struct("block", "place")).alias("at"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "place", "record"))), lambda x: x["record"]), "\n").alias("record")
    )
    every = whole.unionByName(joined.select("path", "at.block", "at.place", "record"))
    return every.withColumn("record", F.regexp_replace("record", "\r$", ""))  # a line end of two characters


#: Characters of private use, two of which stand for line breaks while a file is parsed line by line.
_BREAKS = [chr(0xE000 + k) for k in range(16)]


def _read_records(spark: SparkSession, path: str, encoding: str, options: dict) -> DataFrame:
    """A multi-line file by its records: written with a mark for each line break, read as plain lines, and the marks turned back."""
    found = records(spark, path, encoding)
    used = found.agg(*[F.max(F.contains("record", F.lit(c))).alias(f"u{i}") for i, c in enumerate(_BREAKS)]).first()
    free = [c for c, u in zip(_BREAKS, used, strict=True) if not u]
    if len(free) < 2:
        raise DataLoadError(f"Every character that could mark a line break occurs in {path}")
    first = found.groupBy("path").agg(F.min(F.struct("block", "place", "record"))["record"].alias("record")).groupBy("record").count().collect()
    if len(first) > 1:
        raise DataLoadError(f"The files of {path} have different headers")
    where = f"{ensure_checkpoint_dir(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
    # each file's header goes; the header file is read before the others
    top = found.groupBy("path").agg(F.min(F.struct("block", "place")).alias("top"))
    body = found.join(F.broadcast(top), "path").where(F.struct("block", "place") != F.col("top"))
    ends, marks = "\n\r", "".join(free[:2])
    body.select(F.translate("record", ends, marks).alias("value")).write.text(f"{where}/body")
    header = first[0]["record"] if first else ""
    names = spark.read.options(**{**options, "header": False, "inferSchema": False}).csv(spark.sparkContext.parallelize([header])).first() if header else []
    rows = spark.read.options(**{**options, "header": False}).csv(f"{where}/body")
    named = rows.toDF(*[n if n is not None else f"_c{i}" for i, n in enumerate(names)]) if len(names) == len(rows.columns) else rows
    back = [F.translate(f"`{c}`", marks, ends).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in named.dtypes]
    return named.select(*back)


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    return csv_facts(spark, path)["delimiter"]


def detect_encoding(spark: SparkSession, path: str) -> str:
    return csv_facts(spark, path)["encoding"]


def read_csv(spark: SparkSession, path: str, *, sep: str | None = None, encoding: str | None = None, **options) -> DataFrame:
    """CSV with a header row and inferred types (S1); ``sep`` and ``encoding``
    are detected when not given (S2, S3).  Quotes inside a value are doubled;
    a file with quoted line breaks is cut into records by many tasks."""
    facts = csv_facts(spark, path)
    own = {"header": True, "inferSchema": True, "sep": sep if sep is not None else facts["delimiter"], "quote": '"', "escape": '"', "mode": "PERMISSIVE"} | options
    if facts["multiline"]:
        return _read_records(spark, path, encoding or facts["encoding"], own)
    return spark.read.options(**{"encoding": encoding or facts["encoding"], **own}).csv(path)


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    """``.tsv`` / ``.txt`` go through the CSV reader (S4); the delimiter is sniffed unless given."""
    return read_csv(spark, path, **options)


register([".csv"], read_csv)
register([".tsv", ".txt"], read_tsv)
register([".parquet", ".pq"], read_parquet)
