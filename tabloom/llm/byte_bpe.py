"""Byte-level BPE encoding and decoding by DuckDB recursive queries.

Every partition cuts its texts into the pattern's pieces and hands the
pieces it has not met yet to a DuckDB query inside the task: a piece is the
list of its tokens, each with the rank of the pair it opens, and its
lowest-rank pair is contracted at its leftmost place until no pair is left
(a recursive query whose rows are keyed by piece, so only the current state
of each is kept).  In a step only the two pairs beside the new token join
the merge table.  Decoding selects the vocabulary's bytes by a list of ids
and joins them in its order; sequences are cut before every token that
starts with white space, and a task decodes each distinct run of ids once.
The ids a task has just made are decoded by the chunks they were made of,
which are the runs then.  What a task knows of chunks is two Arrow arrays
(ids and bytes); a text is the list of its chunks' numbers in them.

The merge table follows from the rank file: every cut of a token into two
tokens is a pair with that token's rank.  Texts are neither shuffled nor
cut short; the piece table a task keeps is bounded.

Defined results: a null or empty text has no ids and decodes to no bytes;
repeated rows are encoded alike and all returned.
"""

from __future__ import annotations

import base64
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import kept_in_worker, release_memory, table

#: Entries of a generation of encoded chunks (and of decoded runs); a task keeps the present one and the one before.
CACHE = 150_000
#: Characters of the longest chunk that is kept.
KEPT_CHUNK = 48
#: Bytes of text encoded at a time.
SLICE_BYTES = 3 << 19
#: Bytes of pieces in one recursive query.
QUERY_BYTES = 1 << 18

#: Runs of non-space with one space before them, and white space, as the pattern cuts them.
_CHUNKS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Taken for white space by ``re`` but not by the pattern.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Chunks of Latin letters alone, which are one piece.
_WORD = re.compile(r" ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+")

#: An entry of a short piece's state: rank of the pair it opens, first byte's place and token, from the highest bit.
_RANK, _PLACE, _TOKEN = 1 << 36, 1 << 16, (1 << 16) - 1
#: Rank where no pair opens, and the token at both ends of a state; no merge has them.
_NO_PAIR, _NO_TOKEN = (1 << 17) - 1, _TOKEN

#: One pair a piece and step: its lowest rank at the leftmost place.
_SHORT = f"""
WITH RECURSIVE r(w, state) USING KEY (w) AS (
  SELECT w, state FROM start
  UNION ALL
  SELECT w, state[:p - 2]
    || [(coalesce(l.tok, {_NO_PAIR})::BIGINT * {_RANK}) + (before & {_RANK - 1}),
        (coalesce(n.tok, {_NO_PAIR})::BIGINT * {_RANK}) + (low & {_RANK - 1 - _TOKEN}) + own]
    || state[p + 2:]
  FROM (
    SELECT w, state, p, low, low // {_RANK} AS own, state[p - 1] AS before, state[p + 2] & {_TOKEN} AS after
    FROM (SELECT w, state, list_min(state) AS low, list_position(state, low) AS p FROM r)
    WHERE low < {_NO_PAIR * _RANK}
  )
  LEFT JOIN merges l ON l.pair = (before & {_TOKEN}) * 65536 + own
  LEFT JOIN merges n ON n.pair = own * 65536 + after
)
SELECT w, list_transform(state[2:len(state) - 1], lambda x: (x & {_TOKEN})::INTEGER) AS toks FROM r
"""
#: For long pieces: the lowest rank at all its places in a step (leftmost first where they overlap).
#: A merge never makes a pair of lower rank, so the outcome is the same.
_LONG = """
WITH RECURSIVE r(w, toks) USING KEY (w) AS (
  SELECT w, toks FROM start
  UNION ALL
  SELECT w, list(CASE WHEN taken THEN best ELSE a END ORDER BY pos) FILTER (WHERE NOT gone) AS toks
  FROM (
    SELECT w, pos, a, best, taken, coalesce(lag(taken) OVER (PARTITION BY w ORDER BY pos), false) AS gone
    FROM (
      SELECT w, pos, a, best,
             hit AND (row_number() OVER (PARTITION BY w, hit, run ORDER BY pos)) % 2 = 1 AS taken
      FROM (
        SELECT w, pos, a, best, hit, pos - row_number() OVER (PARTITION BY w, hit ORDER BY pos) AS run
        FROM (
          SELECT w, pos, a, min(tok) OVER (PARTITION BY w) AS best,
                 coalesce(tok = min(tok) OVER (PARTITION BY w), false) AS hit
          FROM (
            SELECT q.w, q.pos, q.a, m.tok
            FROM (SELECT w, unnest(range(1, len(toks) + 1)) AS pos, unnest(toks) AS a, unnest(toks[2:] || [-1]) AS b
                  FROM r) q
            LEFT JOIN merges m ON m.pair = q.a::BIGINT * 65536 + q.b
          )
        ) WHERE best IS NOT NULL
      )
    )
  ) GROUP BY w
)
SELECT w, toks FROM r
"""
LONG_PIECE = 128

_DECODE = """
SELECT d, array_to_string(list_select(v.bytes, list_transform(ids, lambda x: x + 1)), '') AS bytes
FROM given, vocabulary v
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Generations:
    """What a task has worked out: the present generation of CACHE entries and the one before."""

    def __init__(self):
        self.now: dict = {}
        self.before: dict = {}

    def turn(self) -> bool:
        """Begin a generation if the present one is full."""
        full = len(self.now) > CACHE
        if full:
            self.before, self.now = self.now, {}
        return full

    def missing(self, used: set) -> set:
        """Those of ``used`` that aren't known; known ones are in the present generation afterwards."""
        missing = used.difference(self.now)
        kept = missing.intersection(self.before)
        self.now.update(zip(kept, map(self.before.__getitem__, kept), strict=True))
        return missing - kept


class Codec:
    """Encoder and decoder over one in-memory DuckDB connection."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        self.base = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        if max(ranks.values()) >= _NO_TOKEN:
            raise ValueError(f"Too many tokens in {path}")
        self.pairs = np.full(1 << 16, _NO_PAIR, dtype=np.int64)  # rank of each pair of bytes
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        self.coded = Generations()  # numbers of chunks: their places in the two arrays
        self.said = self.coded  # a chunk's ids and bytes have one number
        self.ids_of = _lists([], np.zeros(0, np.int32))  # ids of chunks
        self.bytes_of = _binaries([], b"")  # what they decode to, for as many of the first as were asked for
        self.decoded = Generations()  # bytes of runs of ids
        self.opens = np.zeros(max(ranks.values()) + 1, dtype=bool)  # tokens that start with white space
        self.opens[[r for t, r in ranks.items() if t[:1].isspace()]] = True
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        pairs, toks = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs.append(a * 65536 + b)
                    toks.append(rank)
        self._table("merges", pa.table({"pair": pa.array(pairs, pa.int64()), "tok": pa.array(toks, pa.int32())}))
        # one row: the tokens' bytes by id, one character per byte, so that joining strings joins bytes
        by_id: list[str | None] = [None] * len(self.opens)
        for token, rank in ranks.items():
            by_id[rank] = token.decode("latin-1")
        self._table("vocabulary", pa.table({"bytes": pa.array([by_id], pa.list_(pa.string()))}))

    def _table(self, name: str, data: pa.Table) -> None:
        self.con.register("arrow_in", data)
        self.con.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM arrow_in")
        self.con.unregister("arrow_in")

    def _states(self, part: list[bytes]) -> pa.Table:
        """What the query for short pieces starts from: an entry for each byte, between two that open no pair."""
        sizes = np.array([len(p) for p in part])
        data = np.frombuffer(b"".join(part), dtype=np.uint8)
        ends = np.append(0, np.cumsum(sizes + 2)).astype(np.int32)
        first = np.cumsum(sizes) - sizes
        ranks = np.full(len(data), _NO_PAIR, dtype=np.int64)
        ranks[:-1] = self.pairs[data[:-1].astype(np.int32) << 8 | data[1:]]
        ranks[first + sizes - 1] = _NO_PAIR  # the last byte of a piece
        place = np.arange(len(data)) - np.repeat(first, sizes)
        state = np.full(ends[-1], _NO_PAIR * _RANK + _NO_TOKEN, dtype=np.int64)
        state[place + 1 + np.repeat(ends[:-1], sizes)] = ranks * _RANK + place * _PLACE + self.base[data]
        return pa.table({"w": pa.array(np.arange(len(part), dtype=np.int32)), "state": pa.ListArray.from_arrays(pa.array(ends), pa.array(state))})

    def _tokens(self, part: list[bytes]) -> pa.Table:
        """What the query for long pieces starts from: the tokens of the bytes."""
        ends = np.cumsum([0, *map(len, part)]).astype(np.int32)
        toks = self.base[np.frombuffer(b"".join(part), dtype=np.uint8)]
        return pa.table({"w": pa.array(np.arange(len(part), dtype=np.int32)), "toks": pa.ListArray.from_arrays(pa.array(ends), pa.array(toks))})

    def _merge(self, pieces: list[bytes], sql: str) -> pa.ListArray:
        """Ids of each piece, by the recursive query."""
        out = [_lists([], np.zeros(0, np.int32))]
        for lo, hi in _slices([len(p) for p in pieces], QUERY_BYTES):
            part = pieces[lo:hi]
            self._table("start", self._states(part) if sql is _SHORT else self._tokens(part))
            got = self.con.sql(sql).to_arrow_table()
            toks = _column(got, "toks").take(pa.array(np.argsort(_column(got, "w").to_numpy())))
            out.append(_lists(pc.list_value_length(toks), toks.flatten().to_numpy(zero_copy_only=False).astype(np.int32)))
        return pa.concat_arrays(out)

    def _ids(self, pieces: list[str]) -> pa.ListArray:
        """Ids of each piece: its own, if it is a token, or those it is merged to."""
        data = [p.encode("utf-8", "surrogatepass") for p in pieces]
        own = np.fromiter(map(self.ranks.get, data, itertools.repeat(-1)), np.int32, len(data))
        long = np.fromiter(map(len, data), np.int64, len(data)) > LONG_PIECE
        tokens, short, long = np.flatnonzero(own >= 0), np.flatnonzero((own < 0) & ~long), np.flatnonzero((own < 0) & long)
        ids = [
            _lists(np.ones(len(tokens), np.int32), own[tokens]),
            self._merge([data[k] for k in short.tolist()], _SHORT),
            self._merge([data[k] for k in long.tolist()], _LONG),
        ]
        return pa.concat_arrays(ids).take(pa.array(np.argsort(np.concatenate([tokens, short, long]))))

    def _learn(self, chunks: set[str]) -> tuple[list[str], pa.ListArray]:
        """Chunks that aren't known, those to be kept first, and their ids; pieces that are known (as chunks of their own) aren't merged again."""
        words = list(filter(_WORD.fullmatch, chunks))  # one piece each
        others = list(chunks.difference(words))
        cut = list(map(self.pattern.findall, others))
        parts = set().union(*cut).difference(words)
        known: dict[str, int] = {}
        for have in (self.coded.before, self.coded.now):
            met = parts.intersection(have)
            known.update(zip(met, map(have.__getitem__, met), strict=True))
        pieces = [*words, *parts.difference(known)]
        ids = self._ids(pieces)
        known.update(zip(pieces, range(len(self.ids_of), len(self.ids_of) + len(pieces)), strict=True))
        both = pa.concat_arrays([self.ids_of, ids])
        chunk_ids = pa.concat_arrays([ids[: len(words)], _joined(both, _numbers(known, cut), list(map(len, cut)))])
        new = words + others
        order = np.argsort(np.fromiter(map(len, new), np.int64, len(new)) > KEPT_CHUNK, kind="stable")
        return [new[k] for k in order.tolist()], chunk_ids.take(pa.array(order))

    def _keep(self, numbers: dict[str, int]) -> dict[str, int]:
        """Leave the arrays these chunks only; their new numbers."""
        kept = pa.array(np.fromiter(numbers.values(), np.int64, len(numbers)))
        self.bytes_of = self.bytes_of.take(kept) if len(self.bytes_of) == len(self.ids_of) else self.bytes_of[:0]
        self.ids_of = self.ids_of.take(kept)
        return dict(zip(numbers, range(len(kept)), strict=True))

    def rest(self) -> None:
        """Keep the present generation only."""
        self.coded.before, self.coded.now = {}, self._keep(self.coded.now)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as int32 bytes."""
        return self.encode_and_decode(texts, False)[0]

    def encode_and_decode(self, texts: list[str | None], decoded: bool = True) -> tuple[list[bytes], list[bytes]]:
        """Ids of each text as int32 bytes and, if asked for, the bytes they decode to."""
        ids, said = self.arrays(texts, decoded)
        return [x.values.to_numpy().tobytes() for x in ids], said.to_pylist() if decoded else []

    def arrays(self, texts: list[str | None], decoded: bool = True) -> tuple[pa.ListArray, pa.BinaryArray | None]:
        """Ids of each text and, if asked for, the bytes they decode to."""
        cut = [
            [] if not t else _CHUNKS.findall(t) if not _ODD_SPACE.search(t) else self.pattern.findall(t) for t in texts
        ]
        if self.coded.turn():
            self.coded.before = self._keep(self.coded.before)
        new, ids = self._learn(self.coded.missing(set().union(*cut)))
        self.coded.now.update(zip(new, range(len(self.ids_of), len(self.ids_of) + len(new)), strict=True))
        self.ids_of = pa.concat_arrays([self.ids_of, ids])
        numbers, counts = _numbers(self.coded.now, cut), list(map(len, cut))
        out, said = _joined(self.ids_of, numbers, counts), None
        if decoded:
            self.bytes_of = pa.concat_arrays([self.bytes_of, self._bytes(self.ids_of[len(self.bytes_of):])])
            said = _joined(self.bytes_of, numbers, counts)
        dropped = list(itertools.takewhile(lambda c: len(c) > KEPT_CHUNK, reversed(new)))
        for c in dropped:
            del self.coded.now[c]
        stay = len(self.ids_of) - len(dropped)
        self.ids_of, self.bytes_of = self.ids_of[:stay], self.bytes_of[:stay]
        return out, said

    def _bytes(self, ids: pa.ListArray) -> pa.BinaryArray:
        """What each list of ids decodes to, in the order of its ids."""
        out = [_binaries([], b"")]
        for lo, hi in _slices(pc.list_value_length(ids).to_pylist(), QUERY_BYTES):
            self._table("given", pa.table({"d": pa.array(np.arange(hi - lo, dtype=np.int32)), "ids": ids[lo:hi]}))
            got = self.con.sql(_DECODE).to_arrow_table()
            text = _column(got, "bytes").take(pa.array(np.argsort(_column(got, "d").to_numpy())))
            size = pc.sum(pc.binary_length(text)).as_py()
            data = text.buffers()[2].to_pybytes()[:size] if size else b""
            out.append(_binaries(pc.utf8_length(text), data.decode().encode("latin-1")))
        return pa.concat_arrays(out)

    def _decode_runs(self, runs: list[bytes]) -> list[bytes]:
        """Bytes of each run of ids (int32 bytes), in the order of its ids."""
        return self._bytes(_lists([len(r) // 4 for r in runs], np.frombuffer(b"".join(runs), dtype=np.int32))).to_pylist()

    def runs(self, ids: list[np.ndarray]) -> list[list[bytes]]:
        """Each list of ids cut before every token that starts with white space."""
        out = []
        for one in ids:
            starts = np.flatnonzero(self.opens[one])
            cuts = (4 * np.unique(np.concatenate([[0], starts, [len(one)]]))).tolist()
            raw = one.tobytes()
            out.append([raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
        return out

    def decode(self, texts: list[list[bytes]]) -> list[bytes]:
        """Bytes of each text, given as runs of ids (int32 bytes)."""
        self.decoded.turn()
        new = list(self.decoded.missing(set().union(*texts)))
        known = self.decoded.now
        known.update(zip(new, self._decode_runs(new), strict=True))
        out = [b"".join(map(known.__getitem__, own)) for own in texts]
        for r in new:
            if len(r) > 96:
                del known[r]
        return out


_CODECS: dict[tuple[str, str], Codec] = kept_in_worker()


def codec(path: str, pattern: str) -> Codec:
    key = (path, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(path, pattern)
    return _CODECS[key]


def _release() -> None:
    release_memory(_CODECS)


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def _ends(sizes) -> np.ndarray:
    return np.append(0, np.cumsum(np.asarray(sizes, dtype=np.int64))).astype(np.int32)


def _lists(sizes, values: np.ndarray) -> pa.ListArray:
    """Lists of these sizes, of the values one after another."""
    return pa.ListArray.from_arrays(pa.array(_ends(sizes)), pa.array(values, pa.int32()))


def _binaries(sizes, data: bytes | pa.Buffer) -> pa.BinaryArray:
    """Binary values of these sizes, of the bytes one after another."""
    ends = _ends(sizes)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _column(got: pa.Table, name: str) -> pa.Array:
    return got.column(name).combine_chunks()


def _numbers(index: dict[str, int], cut: list[list[str]]) -> np.ndarray:
    return np.fromiter(map(index.__getitem__, itertools.chain.from_iterable(cut)), np.int64)


def _joined(own: pa.Array, numbers: np.ndarray, counts: list[int]) -> pa.Array:
    """Lists (or binary values) joined: the first ``counts[0]`` of those numbered, the next ``counts[1]`` and so on."""
    got = own.take(pa.array(numbers))
    lists = pa.types.is_list(own.type)
    sizes = (pc.list_value_length if lists else pc.binary_length)(got).to_numpy(zero_copy_only=False)
    joined = np.diff(_ends(sizes)[_ends(counts)])
    return _lists(joined, got.flatten().to_numpy(zero_copy_only=False)) if lists else _binaries(joined, got.buffers()[2] or b"")


def encode(
    docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids",
    decoded_col: str | None = None,
) -> DataFrame:
    """``docs`` without its text and with ``ids_col``: array of token ids.

    With ``decoded_col`` the same task decodes the ids again and adds their
    bytes (binary).
    """
    new = [ids_col, *([decoded_col] if decoded_col else [])]
    keep = [c for c in docs.columns if c not in (text_col, *new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_pylist()
            for lo, hi in _slices(sizes, SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                ids, said = own.arrays(part.column(text_col).to_pylist(), bool(decoded_col))
                cols = [*(part.column(c) for c in keep), ids]
                if decoded_col:
                    cols.append(said)
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *new])
        own.rest()
        _release()

    given = docs.select(*keep, text_col)
    types = {ids_col: "array<int>", decoded_col: "binary"}
    schema = given.select(*keep, *(F.lit(None).cast(types[c]).alias(c) for c in new)).schema
    return given.mapInArrow(run, schema)


def decode(tokens: DataFrame, ranks: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``tokens`` with ``out_col``: the bytes of its token ids (binary); null ids decode to no bytes."""
    keep = [c for c in tokens.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(ids_col)), 0).to_pylist()
            for lo, hi in _slices(sizes, SLICE_BYTES // 4):
                part = batch.slice(lo, hi - lo)
                ids = [np.asarray(x or [], dtype=np.int32) for x in part.column(ids_col).to_pylist()]
                cols = [*(part.column(c) for c in keep), pa.array(own.decode(own.runs(ids)), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, out_col])

    given = tokens.select(*keep)
    schema = given.select(*keep, F.lit(None).cast("binary").alias(out_col)).schema
    return given.mapInArrow(run, schema)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = encode(docs, ranks, pattern, decoded_col="decoded")
    return both.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
