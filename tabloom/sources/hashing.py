"""Content hashes (S9): file bytes and row fingerprints.

``file_hashes`` reads many files at once with the ``binaryFile`` source and
hashes each one in the executor that reads it (Spark's ``sha2``/``md5``).
A file above ``STREAM_ABOVE`` bytes is read in splits as lines (any bytes
between line feeds) and hashed split by split: each task goes on from the
digest's state after the split before, so that it reads one split and holds
a few MB (or a line), whatever the file's size.  Files go side by side, the
splits of one file one after another, as its digest asks.
``row_fingerprints`` hashes the text of a row's columns, each with its length
in front and a mark for null, so that different rows have different texts.
"""

from __future__ import annotations

import bisect
import codecs
import ctypes
import hashlib
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataLoadError
from ..functions.kinds import as_text, q
from ..session import fs_path

#: Larger files are hashed as a stream, split by split; the binary source reads a file in one task.
STREAM_ABOVE = 1 << 27
#: Files that the text source would unpack, which the binary source reads (up to 2 GB, where its rows end).
PACKED = r"(?i)\.(gz|bz2|deflate|lz4|snappy|zst)$"
#: Bytes hashed at a time.
PIECE_BYTES = 4 << 20

ALGORITHMS = {"sha256": 256, "sha224": 224, "sha384": 384, "sha512": 512}


def _digest(c, algorithm: str):
    a = algorithm.lower()
    if a in ALGORITHMS:
        return F.sha2(c, ALGORITHMS[a])
    if a == "md5":
        return F.md5(c)
    if a == "sha1":
        return F.sha1(c)
    raise ValueError(f"Unsupported hash algorithm: {algorithm}")


class Digest:
    """A digest of OpenSSL, as in ``hashlib``, whose ``state`` is bytes with which another task can go on."""

    NAMES = {"md5": "MD5", "sha1": "SHA1", "sha224": "SHA224", "sha256": "SHA256", "sha384": "SHA384", "sha512": "SHA512"}
    #: Room for the largest state (SHA512_CTX, 216 bytes).
    ROOM = 256

    def __init__(self, algorithm: str, state: bytes | None = None):
        name, lib = self.NAMES[algorithm.lower()], _openssl()
        self._size = hashlib.new(algorithm).digest_size
        self._start, self._add, self._end = (getattr(lib, f"{name}_{step}") for step in ("Init", "Update", "Final"))
        self._state = ctypes.create_string_buffer(state or b"", self.ROOM)
        if state is None:
            self._start(self._state)

    @property
    def state(self) -> bytes:
        return self._state.raw

    def update(self, data: bytes) -> None:
        self._add(self._state, ctypes.c_char_p(data), ctypes.c_size_t(len(data)))

    def hexdigest(self) -> str:
        out, end = ctypes.create_string_buffer(self._size), ctypes.create_string_buffer(self.state, self.ROOM)
        self._end(out, end)
        return out.raw.hex()


def _openssl() -> ctypes.CDLL:
    """The library that this Python's ``hashlib`` uses."""
    import _hashlib

    return ctypes.CDLL(_hashlib.__file__)


def _goes_on(algorithm: str) -> bool:
    """Whether a digest's state can be taken out here: not where Python has no OpenSSL or holds it inside itself."""
    try:
        return Digest(algorithm).hexdigest() == hashlib.new(algorithm.lower()).hexdigest()
    except (ImportError, AttributeError, OSError):
        return False


def file_hashes(spark: SparkSession, path: str, algorithm: str = "sha256", glob: str | None = None, *, stream_above: int = STREAM_ABOVE) -> DataFrame:
    """``path, length, modified, hash`` for every file under ``path`` (a file,
    folder or glob), of any size.  Spark's sources leave out empty files of a
    folder; an empty file that is named itself has its hash."""
    empty = _digest(F.lit("").cast("binary"), algorithm)
    fs, p = fs_path(spark, path)
    if fs.exists(p) and fs.getFileStatus(p).isFile() and fs.getFileStatus(p).getLen() == 0:
        status = fs.getFileStatus(p)
        named = spark.createDataFrame([(status.getPath().toString(), 0, status.getModificationTime())], "path string, length long, ms long")
        return named.select("path", "length", F.timestamp_millis("ms").alias("modified"), empty.alias("hash"))
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    try:
        files = reader.load(path)
    except Exception as e:  # noqa: BLE001 - Spark raises AnalysisException for absent paths
        raise DataLoadError(f"Cannot hash: file not found: {path}") from e
    facts = ["path", "length", F.col("modificationTime").alias("modified")]
    # the filter on the length reaches the source: contents of larger files aren't read
    small = files.where(F.col("length") <= stream_above).select(*facts, _digest(F.col("content"), algorithm).alias("hash"))
    large = files.where(F.col("length") > stream_above).select(*facts)
    names = [r["path"] for r in large.select("path").where(F.col("path").rlike(PACKED)).collect()]
    out = small
    if names:
        packed = spark.read.format("binaryFile").load(names)
        out = out.unionByName(packed.select(*facts, _digest(F.col("content"), algorithm).alias("hash")))
    lengths = {r["path"]: r["length"] for r in large.where(~F.col("path").rlike(PACKED)).select("path", "length").collect()}
    if not lengths:
        return out
    hashed = _by_splits(spark, lengths, algorithm) if _goes_on(algorithm) else _streamed(spark, list(lengths), large, algorithm)
    return out.unionByName(large.join(hashed, "path"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines joined again by line feeds, some MB a row."""
    for batch in batches:
        step = max(1, len(batch) * PIECE_BYTES // max(batch.nbytes, 1))
        for lo in range(0, len(batch), step):
            yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(batch.column(0).slice(lo, step).to_pylist())], pa.binary())], names=["piece"])


def _by_splits(spark: SparkSession, lengths: dict[str, int], algorithm: str) -> DataFrame:
    """(path, hash) of files: a job for every file's next split, which starts from the states after the split before."""
    sc, algorithm = spark.sparkContext, algorithm.lower()
    files = [spark.read.option("lineSep", "\n").text(name).select(F.col("value").cast("binary")).mapInArrow(_pieces, "piece binary").rdd for name in lengths]
    counts = [f.getNumPartitions() for f in files]
    firsts = [0, *itertools.accumulate(counts)]
    pieces = sc.union(files)
    # a file's states without and with the mark that the source skips at its start, bytes read, and whether a line was
    blank = Digest(algorithm), Digest(algorithm)
    blank[1].update(codecs.BOM_UTF8)
    states = dict.fromkeys(range(len(files)), ([d.state for d in blank], 0, False))

    def going_on(states: dict):
        def run(split: int, rows: Iterable) -> Iterator:
            file = bisect.bisect_right(firsts, split) - 1
            now, done, met = states[file]
            digests = [Digest(algorithm, s) for s in now]
            for (piece,) in rows:
                for data in (b"\n", bytes(piece)) if met else (bytes(piece),):
                    done += len(data)
                    for d in digests:
                        d.update(data)
                met = True
            yield file, ([d.state for d in digests], done, met)

        return run

    for k in range(max(counts)):
        now = {file: first + k for file, (first, n) in enumerate(zip(firsts, counts, strict=False)) if k < n}
        states.update(sc.runJob(pieces.mapPartitionsWithIndex(going_on({file: states[file] for file in now})), list, list(now.values())))

    def close(length: int, now: list[bytes], done: int) -> str:
        marked = length - done >= len(codecs.BOM_UTF8)  # the source skips this mark at a file's start
        digest = Digest(algorithm, now[marked])
        if done + marked * len(codecs.BOM_UTF8) < length:  # the last line has a line feed
            digest.update(b"\n")
        return digest.hexdigest()

    hashes = [(name, close(length, *states[file][:2])) for file, (name, length) in enumerate(lengths.items())]
    return spark.createDataFrame(hashes, "path string, hash string")


def _streamed(spark: SparkSession, names: list[str], files: DataFrame, algorithm: str) -> DataFrame:
    """(path, hash) of files, read in splits, dealt by file and hashed in order by one task a file."""
    lines = (
        spark.read.option("lineSep", "\n").text(names)
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("line"))
    )
    sizes = files.select("path", F.lit(-1).cast("long").alias("block"), F.col("length").alias("place"), F.lit(None).cast("binary").alias("line"))
    given = lines.unionByName(sizes).repartition("path").sortWithinPartitions("path", "block", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digests, done, length, lead, out = None, [], 0, 0, True, []

        def add(data: bytes) -> None:
            for d in digests:
                d.update(data)

        def close() -> None:
            if now is None:
                return
            marked = length - done >= len(codecs.BOM_UTF8)  # the source skips this mark at a file's start
            if done + marked * len(codecs.BOM_UTF8) < length:  # the last line has a line feed
                add(b"\n")
            out.append((now, digests[marked].hexdigest()))

        for batch in batches:
            for file, block, place, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block < 0:  # the file's length comes first
                    close()
                    now, done, length, lead = file, 0, place, True
                    digests = [hashlib.new(algorithm.lower()), hashlib.new(algorithm.lower(), codecs.BOM_UTF8)]
                    continue
                if not lead:
                    add(b"\n")
                    done += 1
                lead = False
                add(line)
                done += len(line)
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out]), pa.array([h for _, h in out])], names=["path", "hash"])

    return given.mapInArrow(run, "path string, hash string")


def compute_file_hash(spark: SparkSession, path: str, algorithm: str = "sha256") -> str:
    """Hash of one file (hex)."""
    row = file_hashes(spark, path, algorithm).first()
    if row is None:
        raise DataLoadError(f"Cannot hash: file not found: {path}")
    return row["hash"]


def row_text(df: DataFrame, cols: list[str]) -> Column:
    """Unambiguous text of the columns: ``<length>:<text>`` for a value, ``~`` for null, joined by '|'."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    texts = [as_text(F.col(q(c)), fields[c]) for c in cols]
    return F.concat_ws("|", *[F.when(t.isNull(), "~").otherwise(F.concat(F.length(t).cast("string"), F.lit(":"), t)) for t in texts])


def row_fingerprints(df: DataFrame, cols: list[str] | None = None, algorithm: str = "sha256") -> DataFrame:
    """``df`` plus ``row_hash``: hash of ``row_text``."""
    return df.withColumn("row_hash", _digest(row_text(df, cols or df.columns), algorithm))
