"""Conversation prefix trie: aggregates of every shared beginning of conversations.

Conversations are sequences of turns.  A prefix of d turns has a 128-bit
key, the xor of position-salted hashes of its turns, so that keys of all
prefixes come from running xors and a long conversation is cut into pieces
of 64 turns that know the key they start from.  Equal pieces with equal
starts are merged first (counts and least ids add up), then the distinct
pieces are range-partitioned in prefix order: every shard holds the
pieces of a stretch of prefixes.  A task packs them into double arrays:
turns get dense ids, a node's children lie at BASE[node] + id, and CHECK
names their parent.  Walking the pieces through the arrays gives the
aggregates of a shard's nodes; nodes that several shards share (the upper
ones) are merged globally by key.

Sums over subtrees need only the nodes that two or more conversations
share: below them each child is a path to one leaf and saves nothing.
They are added up by doubling the distance to the ancestor, so the number
of rounds grows with the logarithm of the deepest shared prefix.

No group is gathered: conversations are numbered by a range-partitioned
sort, ids of equal conversations are hashed as a stream of runs of up to
1024 (a digest is sequential; only its state is kept).

Defined results: null turns come first, turns of equal number by the md5
of role and text; a null role or text is empty; rows without a
conversation id belong to no conversation and aren't read; an empty table
has no nodes; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.llm.common import CRC32, table, written
from tabloom.llm.ordered import block, placed

#: Turns in a piece of a conversation.
PIECE = 64
#: Turns in one double array, unless a piece alone is longer.
SHARD_TURNS = 200_000
#: Tries for a place before the children go to the end of the arrays.
TRIES = 64

EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


class DoubleArray:
    """Trie over rows of dense ids (1 and up, 0 after a row's end), sorted."""

    def __init__(self, rows: np.ndarray):
        self.base = np.zeros(max(64, 2 * rows.shape[0]), np.int64)
        self.check = np.full(len(self.base), -1, np.int64)
        self.check[0] = 0  # the root
        self.free = 1
        self._pack(rows)

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            size = max(size, 2 * len(self.check))
            self.base = np.append(self.base, np.zeros(size - len(self.base), np.int64))
            self.check = np.append(self.check, np.full(size - len(self.check), -1, np.int64))

    def _next_free(self, at: int) -> int:
        while at < len(self.check) and self.check[at] >= 0:
            at += 1
        return at

    def _place(self, state: int, ids: np.ndarray) -> None:
        """Find BASE for the children ``ids`` (ascending) of ``state`` and mark their places."""
        self.free = at = self._next_free(self.free)
        base = at - int(ids[0])
        if len(ids) > 1:
            for _ in range(TRIES):
                spots = base + ids
                inside = spots[spots < len(self.check)]
                if (self.check[inside] < 0).all():
                    break
                at = self._next_free(at + 1)
                base = at - int(ids[0])
            else:
                base = int(np.flatnonzero(self.check >= 0)[-1]) + 1 - int(ids[0])
        self._grow(base + int(ids[-1]) + 1)
        self.base[state] = base
        self.check[base + ids] = state

    def _pack(self, rows: np.ndarray) -> None:
        state = np.zeros(len(rows), np.int64)
        for level in range(rows.shape[1]):
            own = np.flatnonzero(rows[:, level])
            if not len(own):
                break
            s, ids = state[own], rows[own, level]
            new = np.append(True, (s[1:] != s[:-1]) | (ids[1:] != ids[:-1]))  # rows are sorted: equal prefixes are adjacent
            ps, pid = s[new], ids[new]
            cuts = np.flatnonzero(np.append(True, ps[1:] != ps[:-1])).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], len(ps)], strict=True):
                self._place(int(ps[lo]), pid[lo:hi])
            state[own] = self.base[s] + ids

    def step(self, state: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Children of ``state`` by ``ids``, -1 where there is none."""
        to = self.base[state] + ids
        ok = (to > 0) & (to < len(self.check))
        ok[ok] = self.check[to[ok]] == state[ok]
        return np.where(ok, to, -1)


def shard_nodes(start: np.ndarray, depth: np.ndarray, a: list[np.ndarray], b: list[np.ndarray], size: list[np.ndarray], weight: np.ndarray, least: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes of one shard's sorted pieces: key, parent's key, members, least id, bytes of the last turn.

    ``start`` (n x 2) is the key that a piece starts from, ``depth`` its
    depth; ``a`` and ``b`` are the turn hashes, ``size`` the turns' bytes.
    """
    n, width = len(depth), max(map(len, a))
    wide = lambda lists: np.stack([np.pad(x, (0, width - len(x))) for x in lists])
    length = np.array([len(x) for x in a])
    inside = np.arange(width) < length[:, None]
    ha, hb, bytes_ = wide(a), wide(b), wide(size)
    # the start of a piece is its first symbol, so that all tries of a shard share one root
    begins = np.cumsum(np.append(True, (start[1:] != start[:-1]).any(axis=1) | (depth[1:] != depth[:-1])))
    _, turn = np.unique(ha[inside], return_inverse=True)
    rows = np.zeros((n, width + 1), np.int64)
    rows[:, 0] = begins
    rows[:, 1:][inside] = turn + 1
    trie = DoubleArray(rows)
    slots = len(trie.check)
    members, lowest = np.zeros(slots, np.int64), np.full(slots, np.iinfo(np.int64).max)
    key = np.zeros((slots, 2), np.int64)
    above, deep, last = np.zeros((slots, 2), np.int64), np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    state = trie.step(np.zeros(n, np.int64), rows[:, 0])
    now = start.copy()
    for level in range(width):
        own = np.flatnonzero(inside[:, level])
        state = state[own] if level == 0 else state[np.searchsorted(before, own)]
        to = trie.step(state, rows[own, level + 1])
        np.add.at(members, to, weight[own])
        np.minimum.at(lowest, to, least[own])
        above[to] = now[own]
        now[own, 0] ^= ha[own, level]
        now[own, 1] ^= hb[own, level]
        key[to], deep[to], last[to] = now[own], depth[own] + level + 1, bytes_[own, level]
        state, before = to, own
    got = np.flatnonzero(deep)
    return {
        "depth": deep[got], "a": key[got, 0], "b": key[got, 1], "up_a": above[got, 0], "up_b": above[got, 1], "n_convs": members[got],
        "conv_id": lowest[got], "bytes": last[got],
    }


_NODE = "depth long, a long, b long, up_a long, up_b long, n_convs long, conv_id long, bytes long"
KEY = ["depth", "a", "b"]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def packed(rows: list[tuple]) -> pa.RecordBatch:
        depth, sa, sb, a, b, size, weight, least = zip(*rows, strict=True)
        arrays = lambda lists: [np.array(x, np.int64) for x in lists]
        long = lambda x: np.array(x, np.int64)
        got = shard_nodes(np.stack([long(sa), long(sb)], axis=1), long(depth), arrays(a), arrays(b), arrays(size), long(weight), long(least))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in got.values()], names=list(got))

    rows, turns = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append(row)
            turns += len(row[3])
            if turns >= SHARD_TURNS:
                yield packed(rows)
                rows, turns = [], 0
    if rows:
        yield packed(rows)


def pieces(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, start_a, start_b, a, b, size): runs of PIECE turns of ``turns`` (conv_id, d, mark, size)."""
    hashed = turns.select(
        "conv_id", F.floor((F.col("d") - 1) / PIECE).cast("long").alias("w"), "d",
        F.xxhash64("mark", "d").alias("a"), F.xxhash64("d", F.reverse("mark"), F.lit(1)).alias("b"), "size",
    )
    cut = hashed.groupBy("conv_id", "w").agg(
        F.sort_array(F.collect_list(F.struct("d", "a", "b", "size"))).alias("t"), F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb")
    )
    earlier = Window.partitionBy("conv_id").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    return cut.select(
        "conv_id", (F.col("w") * PIECE).alias("depth"), *(F.coalesce(F.bit_xor(f"x{x}").over(earlier), F.lit(0)).alias(f"start_{x}") for x in "ab"),
        "xa", "xb", *(F.col("t")[x].alias(x) for x in ("a", "b", "size")),
    )


def id_digests(groups: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """(keys, ends_sha256): digest of each group's ids, ascending and comma-joined, as a stream of runs."""
    marked = placed(groups, [*keys, id_col], "ends")
    runs = marked.groupBy(*keys, block().alias("run")).agg(
        F.array_join(F.sort_array(F.collect_list(id_col)).cast("array<string>"), ",").alias("ids")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, out = None, None, []

        def packed():
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1])], names=[*keys, "ends_sha256"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, ids = row[:-1], row[-1].encode()
                if key == now:
                    sha.update(b"," + ids)
                    continue
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(ids)
                if len(out) >= 4000:
                    yield packed()
                    out = []
        if now is not None:
            out.append((*now, sha.hexdigest()))
        if out:
            yield packed()

    stream = runs.repartition(*keys).sortWithinPartitions(*keys, "run").select(*keys, "ids")
    return stream.mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", ends_sha256 string")


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``nodes`` (KEY, up_a, up_b, values) with the values summed over each node's subtree, by doubling.

    After round k a node's sums hold its descendants nearer than 2^k and it
    knows its ancestor at that distance; that ancestor takes them over.
    """
    now = written(nodes.select(*KEY, "up_a", "up_b", *values), "subtree")
    deepest, step = now.agg(F.max("depth")).first()[0] or 0, 1
    while step <= deepest:
        far = F.col("depth") - step
        given = now.where(far >= 0).groupBy(far.alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(*(F.sum(v).alias(f"_{v}") for v in values))
        summed = now.join(given, KEY, "left").withColumns({v: F.col(v) + F.coalesce(F.col(f"_{v}"), F.lit(0)) for v in values}).select(now.columns)
        if 2 * step <= deepest:  # the ancestor's ancestor, where there is one
            upper = now.select(
                (F.col("depth") + step).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("up_a").alias("_ua"), F.col("up_b").alias("_ub")
            )
            deep = summed.where(F.col("depth") >= 2 * step).join(upper, ["depth", "up_a", "up_b"]).withColumns({"up_a": F.col("_ua"), "up_b": F.col("_ub")})
            summed = deep.select(now.columns).unionByName(summed.where(F.col("depth") < 2 * step))
        now = written(summed, "subtree")
        step *= 2
    return now.select(*KEY, *values)


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the conversations.

    ``convs`` has every conv_id once (long, no null), ``turns`` the turns of
    those that have some: conv_id, d (1 and up without gaps), mark (string
    that tells turns apart) and size (bytes).  Returns conv_id (least
    member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.
    """
    cut = written(pieces(turns), "pieces")
    whole = cut.groupBy("conv_id").agg(F.bit_xor("xa").alias("a"), F.bit_xor("xb").alias("b"), F.sum(F.size("a")).alias("depth"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    ends = written(convs.select("conv_id").join(whole, "conv_id", "left").select("conv_id", *map(zero, KEY)), "whole")
    same = ends.groupBy(*KEY).agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id"))
    # equal conversations are walked once, equal pieces of different ones as well
    distinct = (
        cut.join(same.select("conv_id", "weight"), "conv_id").groupBy("depth", "start_a", "start_b", "a", "b", "size")
        .agg(F.sum("weight").alias("weight"), F.min("conv_id").alias("least"))
    )
    order = ["depth", "start_a", "start_b", "a"]
    dealt = distinct.select("depth", "start_a", "start_b", "a", "b", "size", "weight", "least").repartitionByRange(*order).sortWithinPartitions(*order)
    parts = dealt.mapInArrow(_shards, _NODE)
    total = ends.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    null, none = F.lit(None).cast("long"), F.lit(0).cast("long")
    root = total.select(none.alias("depth"), none.alias("a"), none.alias("b"), null.alias("up_a"), null.alias("up_b"), "n_convs", "conv_id", none.alias("bytes"))
    merged = parts.groupBy(*KEY).agg(
        F.first("up_a").alias("up_a"), F.first("up_b").alias("up_b"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("bytes").alias("bytes")
    )
    nodes = written(merged.unionByName(root), "nodes")
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(
        F.count("*").alias("n_children"), F.count(F.when(F.col("n_convs") == 1, 1)).alias("single")
    )
    shared = nodes.where("n_convs > 1").join(below, KEY, "left")
    sums = subtree_sums(
        shared.select(
            *KEY, "up_a", "up_b", F.when(F.col("n_children").isNull(), 1).otherwise(F.col("single")).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
        ), ["n_leaves", "saved_tokens"],
    )
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    lone = same.where("weight = 1").select(*KEY, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256).alias("ends_sha256"))
    several = ends.join(same.where("weight > 1").select(*KEY), KEY)
    digests = lone.unionByName(id_digests(several.select(*KEY, "conv_id"), KEY, "conv_id"))
    out = nodes.join(below.select(*KEY, "n_children"), KEY, "left").join(sums, KEY, "left").join(parents, ["depth", "up_a", "up_b"], "left").join(digests, KEY, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", zero("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        zero("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_DIGEST)).alias("ends_sha256"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """(conv_id, j, mark, size): turns numbered from 1 in each conversation."""
    clean = rows.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    mark: Column = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    turns = placed(clean.select("conv_id", "turn", mark.alias("mark"), F.octet_length("text").cast("long").alias("size")), ["conv_id", "turn", "mark"], "turns")
    runs = turns.groupBy("conv_id", block().alias("run")).agg(F.count("*").alias("n"), F.min("at").alias("start"))
    earlier = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "run", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = turns.withColumn("run", block()).join(runs, ["conv_id", "run"])
    return own.select("conv_id", (F.col("before") + F.col("at") - F.col("start") + 1).alias("j"), "mark", "size")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``convs`` and ``turns`` of conversations that begin with turns of conversation c - c % 5."""
    own = written(numbered(rows), "numbered")
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h")
    )
    counts = sizes.select(F.col("conv_id").alias("base"), F.least("n", F.lit(8)).alias("n_base"))
    convs = written(convs.join(counts, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken")), "convs")
    heads = own.where("j <= 8").withColumnRenamed("conv_id", "base").join(convs, "base").where("j <= h").select("conv_id", F.col("j").alias("d"), "mark", "size")
    rest = own.join(convs, "conv_id").where("j > h").select("conv_id", (F.col("taken") + F.col("j") - F.col("h")).alias("d"), "mark", "size")
    return convs.select("conv_id"), heads.unionByName(rest)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs, turns = rebuilt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return prefix_trie(convs, turns)


ORACLE = f"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS j,
         {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t
  FROM conversations WHERE conv_id IS NOT NULL
), lists AS (SELECT conv_id, list(t ORDER BY j) AS own, {CRC32.format('conv_id::VARCHAR')} % 9 AS h FROM own GROUP BY conv_id
), whole AS (
  SELECT l.conv_id, coalesce(b.own[:l.h], []) || l.own[l.h + 1:] AS turns
  FROM lists l LEFT JOIN lists b ON b.conv_id = l.conv_id - l.conv_id % 5
), prefixes AS (
  SELECT conv_id, len(turns) AS n, unnest(range(len(turns) + 1)) AS depth, list_transform(turns, lambda t: md5(length(t.role) || ':' || t.role || t.text)) AS marks, turns
  FROM whole
), keyed AS (
  SELECT conv_id, n, depth, array_to_string(marks[:depth], '') AS key, array_to_string(marks[:depth - 1], '') AS above,
         coalesce(octet_length(encode(turns[depth].text)), 0) AS bytes
  FROM prefixes
), nodes AS (
  SELECT key, depth, any_value(CASE WHEN depth > 0 THEN above END) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends
  FROM keyed GROUP BY key, depth
), kids AS (SELECT above, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above
)
SELECT a.conv_id, a.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, a.n_convs, coalesce(any_value(k.n), 0)::BIGINT AS n_children,
       count(*) FILTER (d.key NOT IN (SELECT above FROM kids))::BIGINT AS n_leaves, sum((d.n_convs - 1) * d.bytes)::BIGINT AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM nodes a JOIN nodes d ON starts_with(d.key, a.key) LEFT JOIN nodes p ON p.key = a.above AND a.depth > 0 LEFT JOIN kids k ON k.above = a.key
GROUP BY a.key, a.conv_id, a.depth, p.conv_id, a.n_convs, a.ends
"""
