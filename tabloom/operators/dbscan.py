"""DBSCAN over all rows (M22): exact, by a join on a space-partitioning tree.

Equal points are merged (weight, least key).  The others are ordered along
a Z-curve and cut into leaves of up to 256; sixteen neighbours make a node
of the next level, with the box of its points.  Starting with the root
paired to itself, a level's pairs of nodes are told apart by their boxes:

* farther apart than ``eps``: dropped;
* nowhere farther apart: answered as a whole.  Each node's weight is added
  to the neighbours of all points of the other, nothing below is looked at;
* else: their children are paired on the next level.

A node within ``eps`` of itself that weighs ``min_samples`` is a unit: all
its points are core points of one cluster, whatever else is near.  Pairs
inside a unit, and pairs of units that are known to be linked, go no
further.  So a dense place with a third of all rows is answered high up in
the tree; leaves that are left are compared point by point, in numpy, and
the pairs are spread over tasks.  Many pairs of leaves, as boxes leave them
in many dimensions, are compared in rounds, near ones on the curve first: a
pair of leaves is not looked into for neighbours once all its points are
known to be core points, nor for links once they are in one cluster.

Core points within ``eps`` are linked; a pair of leaves yields one edge for
a point (to a representative of its part), a whole pair one edge for a
node.  Components over core points are the clusters.  Another point within
``eps`` of core points joins the first of their clusters.  Clusters are
numbered from 0 by the least key of their core points, as a scan of rows
in key order numbers them; noise is -1, and so are rows with a null or NaN
feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import prod
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import q
from ..session import stored
from .components import big as _big
from .components import components
from .ordering import numbered, placed, shifted

LEAF_BITS = 8
FAN_BITS = 4
#: Boxes this near to the limit are left to the comparison of points.
MARGIN = 1e-9
#: Up to so many pairs of leaves are compared in one round.
ROUND_PAIRS = 1 << 12
#: From so many dimensions on, distances come from a matrix product; those near the limit are computed as in fewer.
PRODUCT_DIMS = 8


def _curve(x: Column, lo: list[float], hi: list[float]) -> Column:
    """Z-curve key of 62 bits at most, over the widest dimensions."""
    wide = [i for i in np.argsort([a - b for a, b in zip(lo, hi, strict=True)], kind="stable").tolist() if hi[i] > lo[i]][:62]
    if not wide:
        return F.lit(0).cast("long")
    bits = 62 // len(wide)
    key = F.lit(0).cast("long")
    for place, i in enumerate(wide):
        cell = F.least(F.floor((x[i] - F.lit(lo[i])) / F.lit(hi[i] - lo[i]) * F.lit(float(1 << bits))).cast("long"), F.lit((1 << bits) - 1))
        for j in range(bits):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(cell, j).bitwiseAND(F.lit(1)), j * len(wide) + len(wide) - 1 - place))
    return key


def _apart(a: str, b: str) -> tuple[Column, Column]:
    """Least and greatest squared distance of the boxes of ``a`` and ``b``."""
    minus = lambda u, v: F.zip_with(F.col(u), F.col(v), lambda x, y: x - y)
    zero = F.lit(0.0)
    total = lambda v: F.aggregate(v, zero, lambda s, x: s + x * x)
    gap = F.zip_with(minus(f"{a}_lo", f"{b}_hi"), minus(f"{b}_lo", f"{a}_hi"), lambda u, v: F.greatest(u, v, zero))
    far = F.zip_with(minus(f"{a}_hi", f"{b}_lo"), minus(f"{b}_hi", f"{a}_lo"), lambda u, v: F.greatest(u, v))
    return total(gap), total(far)


def _points(rows: DataFrame, dims: int) -> DataFrame:
    """(pid, leaf, x, w, first): distinct points; leaves are runs of the Z-curve."""
    merged = stored(rows.groupBy("x").agg(F.count(F.lit(1)).alias("w"), F.min("key").alias("first")))
    ends = merged.agg(F.count(F.lit(1)), *[f(F.col("x")[i]) for i in range(dims) for f in (F.min, F.max)]).first()
    if not ends[0]:
        return merged.select(*(F.lit(0).cast("long").alias(c) for c in ("pid", "leaf")), "x", "w", "first")
    curve = _curve(F.col("x"), list(ends[1::2]), list(ends[2::2]))
    ordered, sizes = placed(merged.withColumn("z", curve), [F.col("z"), F.col("x")])
    before, _ = shifted(sizes, 1 << LEAF_BITS)
    leaf = before + F.shiftright("_pos", LEAF_BITS)
    pid = F.shiftleft(leaf, LEAF_BITS).bitwiseOR(F.col("_pos").bitwiseAND(F.lit((1 << LEAF_BITS) - 1)))
    return ordered.select(pid.alias("pid"), leaf.alias("leaf"), "x", "w", "first")


def _tree(points: DataFrame, dims: int) -> list[DataFrame]:
    """(node, lo, hi, w) of each level, leaves first; the last has one node."""
    box = lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(dims)])
    level = stored(points.groupBy(F.col("leaf").alias("node")).agg(box(F.min, "x").alias("lo"), box(F.max, "x").alias("hi"), F.sum("w").alias("w")))
    out, n = [level], level.agg(F.max("node")).first()[0]
    while n is not None and n > 0:
        level = level.groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(box(F.min, "lo").alias("lo"), box(F.max, "hi").alias("hi"), F.sum("w").alias("w"))
        n >>= FAN_BITS
        out.append(stored(level))
    return out


def _descend(tree: list[DataFrame], eps: float, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs answered as a whole (level, a, b), pairs of leaves to compare (a, b), and the leaves' (node, low, unit).

    ``low`` is what the whole pairs add to the neighbours of a node's points.
    """
    spark = tree[0].sparkSession
    up = lambda c: F.shiftright(c, FAN_BITS)
    pairs = state = None
    wholes, linked = [], spark.createDataFrame([], "ua long, ub long")
    for level in reversed(range(len(tree))):
        nodes = tree[level]
        side = lambda s: nodes.select(F.col("node").alias(s), up("node").alias(f"_p{s}"), F.col("lo").alias(f"{s}_lo"), F.col("hi").alias(f"{s}_hi"), F.col("w").alias(f"{s}_w"))  # noqa: B023, E731
        if state is None:
            near = side("a").drop("_pa").join(side("b").drop("_pb"), F.col("a") == F.col("b"))
            known = nodes.select("node", "w", F.lit(0).cast("long").alias("low"), F.lit(None).cast("long").alias("unit"))
        else:
            parents = pairs.select(F.col("a").alias("_pa"), F.col("b").alias("_pb"))
            near = parents.join(_big(side("a")), "_pa").join(_big(side("b")), "_pb").where("a <= b")
            above = state.select(F.col("node").alias("_up"), "low", "unit")
            known = nodes.withColumn("_up", up("node")).join(_big(above), "_up").select("node", "w", "low", "unit")
        gap, far = _apart("a", "b")
        judged = near.select("a", "b", "a_w", "b_w", gap.alias("gap"), far.alias("far")).where(F.sqrt("gap") <= eps * (1 + MARGIN))
        judged = stored(judged.select("a", "b", "a_w", "b_w", (F.sqrt("far") <= eps * (1 - MARGIN)).alias("whole")))
        whole = judged.where("whole")
        wholes.append(whole.select(F.lit(level).alias("level"), "a", "b"))
        gained = whole.select(F.col("a").alias("node"), F.col("b_w").alias("more")).unionByName(
            whole.where("a <> b").select(F.col("b").alias("node"), F.col("a_w").alias("more"))
        ).groupBy("node").agg(F.sum("more").alias("more"))
        dense = whole.where((F.col("a") == F.col("b")) & (F.col("a_w") >= least)).select(F.col("a").alias("node"), (F.col("a") + F.lit(level << 56)).alias("own"))
        state = stored(
            known.join(_big(gained), "node", "left").join(_big(dense), "node", "left")
            .select("node", (F.col("low") + F.coalesce("more", F.lit(0))).alias("low"), F.coalesce("unit", "own").alias("unit"))
        )
        unit = lambda s: state.select(F.col("node").alias(s), F.col("unit").alias(f"u{s}"))  # noqa: B023, E731
        units = judged.join(_big(unit("a")), "a").join(_big(unit("b")), "b").select("a", "b", "whole", F.least("ua", "ub").alias("lo"), F.greatest("ua", "ub").alias("hi"), (F.col("ua").isNotNull() & F.col("ub").isNotNull()).alias("both"))
        units = stored(units)
        new = units.where("whole AND both AND lo <> hi").select(F.col("lo").alias("ua"), F.col("hi").alias("ub"))
        linked = stored(linked.unionByName(new).distinct())
        open_ = units.where("NOT whole")
        settled = open_.where("both").where("lo <> hi").join(_big(linked), (F.col("lo") == F.col("ua")) & (F.col("hi") == F.col("ub")), "left_anti")
        pairs = stored(settled.select("a", "b").unionByName(open_.where("NOT both").select("a", "b")))
    out = wholes[0]
    for w in wholes[1:]:
        out = out.unionByName(w)
    return out, pairs, state


def _members(points: DataFrame, extra: list[str]) -> DataFrame:
    """(leaf, x, extra...): a leaf's points in order, their coordinates in one array."""
    rows = points.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("pid", "x", *extra))).alias("m"))
    return rows.select("leaf", F.flatten(F.col("m")["x"]).alias("x"), *[F.col("m")[c].alias(c) for c in extra])


def _paired(pairs: DataFrame, members: DataFrame) -> DataFrame:
    side = lambda s: members.select(F.col("leaf").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in members.columns if c != "leaf"])
    return pairs.join(_big(side("a")), "a").join(_big(side("b")), "b")


def _near(xa, xb, dims: int, eps: float) -> np.ndarray:
    a, b = np.asarray(xa).reshape(-1, dims), np.asarray(xb).reshape(-1, dims)
    if dims < PRODUCT_DIMS:
        total = np.zeros((len(a), len(b)))
        for k in range(dims):
            total += (a[:, k, None] - b[None, :, k]) ** 2
        return np.sqrt(total) <= eps
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    square = aa[:, None] + bb[None, :] - 2 * (a @ b.T)
    near = square <= eps * eps
    i, j = np.nonzero(~(np.abs(square - eps * eps) > MARGIN * (aa.max(initial=0) + bb.max(initial=0) + eps * eps)))
    for lo in range(0, len(i), 1 << 16):
        u, v = i[lo: lo + (1 << 16)], j[lo: lo + (1 << 16)]
        total = np.zeros(len(u))
        for k in range(dims):
            total += (a[u, k] - b[v, k]) ** 2
        near[u, v] = np.sqrt(total) <= eps
    return near


def _rounds(pairs: DataFrame, n_pairs: int) -> Iterator[DataFrame]:
    """``pairs`` in disjoint parts by the leaves' distance on the curve: 0 to 3, 4 to 15, 16 to 63, ..."""
    if n_pairs <= ROUND_PAIRS:
        yield pairs
        return
    far = pairs.agg(F.max(F.col("b") - F.col("a"))).first()[0]
    lo, hi = 0, 4
    while lo <= far:
        yield pairs.where((F.col("b") - F.col("a") >= lo) & (F.col("b") - F.col("a") < hi))
        lo, hi = hi, hi << 2


def _core_points(pairs: DataFrame, n_pairs: int, points: DataFrame, leaves: DataFrame, dims: int, eps: float, least: int) -> DataFrame:
    """``points`` with ``core``: what whole pairs add to their leaf, and point by point where that doesn't settle it."""
    known = points.join(_big(leaves.select(F.col("node").alias("leaf"), "low")), "leaf").withColumn("n", F.col("low"))
    known = stored(known.select("pid", "leaf", "x", "w", "first", "n"))
    for part in _rounds(pairs, n_pairs):
        unsure = stored(known.where(F.col("n") < least).select("leaf").distinct())
        asked = part.join(_big(unsure.withColumnRenamed("leaf", "a")), "a", "left_semi").select("a", "b").unionByName(
            part.join(_big(unsure.withColumnRenamed("leaf", "b")), "b", "left_semi").select("a", "b")
        )
        asked = stored(asked.distinct())
        if asked.isEmpty():
            continue
        counted = stored(_counts(asked, points, dims, eps).withColumnRenamed("n", "more"))
        known = stored(known.join(_big(counted), "pid", "left").select("pid", "leaf", "x", "w", "first", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
    return stored(known.select("pid", "leaf", "x", "w", "first", (F.col("n") >= least).alias("core")))


def _found_links(pairs: DataFrame, n_pairs: int, points: DataFrame, dims: int, eps: float) -> DataFrame:
    """``_links`` of the pairs, without those of leaves whose points are core points of one cluster already."""
    found = settled = None
    for part in _rounds(pairs, n_pairs):
        if settled is not None:
            one = lambda s: _big(settled.select(F.col("leaf").alias(s), F.col("label").alias(f"l{s}")))  # noqa: B023, E731
            part = part.join(one("a"), "a", "left").join(one("b"), "b", "left").where("la IS NULL OR lb IS NULL OR la <> lb").select("a", "b")
        if n_pairs > ROUND_PAIRS:
            part = stored(part)
            if part.isEmpty():
                continue
        new = stored(_links(part, points, dims, eps))
        found = new if found is None else found.unionByName(new)
        if n_pairs > ROUND_PAIRS:
            label = stored(components(found.where("core").select("a", "b")).withColumnRenamed("node", "pid"))
            of_leaf = points.select("pid", "leaf").join(_big(label), "pid", "left").groupBy("leaf").agg(
                F.count(F.lit(1)).alias("all"), F.count("label").alias("own"), F.min("label").alias("label"), F.max("label").alias("hi")
            )
            # points that aren't core points have no label
            settled = stored(of_leaf.where("all = own AND label = hi").select("leaf", "label"))
    return found if found is not None else stored(_links(pairs, points, dims, eps))


def _counts(pairs: DataFrame, points: DataFrame, dims: int, eps: float) -> DataFrame:
    """(pid, n): weight within ``eps`` that the compared pairs add."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                near = _near(r.a_x, r.b_x, dims, eps)
                sides = [(r.a, near @ np.asarray(r.b_w))] + ([(r.b, near.T @ np.asarray(r.a_w))] if r.a != r.b else [])
                for leaf, n in sides:
                    some = np.flatnonzero(n)
                    yield pd.DataFrame({"pid": (leaf << LEAF_BITS) + some, "n": n[some].astype("int64")})

    return _paired(pairs, _members(points, ["w"])).mapInPandas(run, "pid long, n long").groupBy("pid").agg(F.sum("n").alias("n"))


def _links(pairs: DataFrame, points: DataFrame, dims: int, eps: float) -> DataFrame:
    """(a, b, core): edges of core points to a representative of their part of the pair; other points (core false) to each part that they touch."""
    def parts(near: np.ndarray, core_a: np.ndarray, core_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least number of each core point's part; points of b are numbered after those of a."""
        none = near.shape[0] + near.shape[1]
        la = np.where(core_a, np.arange(near.shape[0]), none)
        lb = np.where(core_b, np.arange(near.shape[1]) + near.shape[0], none)
        both = near & core_a[:, None] & core_b[None, :]
        while True:
            na = np.minimum(la, np.where(both, lb[None, :], none).min(axis=1, initial=none))
            nb = np.minimum(lb, np.where(both, na[:, None], none).min(axis=0, initial=none))
            if (na == la).all() and (nb == lb).all():
                return la, lb
            la, lb = na, nb

    def touched(near: np.ndarray, core: np.ndarray, labels: np.ndarray):
        """(row, label) of the rows that aren't core and each part near them."""
        i, j = np.nonzero(near & ~core[:, None] & (labels < near.shape[0] + near.shape[1])[None, :])
        return np.unique(np.stack([i, labels[j]]), axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                near = _near(r.a_x, r.b_x, dims, eps)
                core_a, core_b = np.asarray(r.a_core, dtype=bool), np.asarray(r.b_core, dtype=bool)
                la, lb = parts(near, core_a, core_b)
                pid = np.concatenate([(r.a << LEAF_BITS) + np.arange(len(la)), (r.b << LEAF_BITS) + np.arange(len(lb))])
                at = np.concatenate([np.flatnonzero(core_a), len(la) + np.flatnonzero(core_b)])
                rep = np.concatenate([la[core_a], lb[core_b]])
                ia, pa = touched(near, core_a, lb)
                ib, pb = touched(near.T, core_b, la)
                yield pd.DataFrame({
                    "a": np.concatenate([pid[at], pid[ia], pid[len(la) + ib]]), "b": np.concatenate([pid[rep], pid[pa], pid[pb]]),
                    "core": np.concatenate([np.ones(len(at), bool), np.zeros(len(ia) + len(ib), bool)]),
                })

    return _paired(pairs, _members(points, ["core"])).mapInPandas(run, "a long, b long, core boolean")


def _vertex(level: Column, node: str) -> Column:
    """A node as a vertex of the cluster graph; points are the numbers from 0 up."""
    return -1 - (F.shiftleft(level.cast("long"), 56) + F.col(node))


def _order_key(df: DataFrame, key: list[str]) -> Column:
    """A column in the order of the ``key`` columns (nulls first): one number if they are whole numbers and it holds them, else a struct.

    Least numbers are found by hashing; for the least struct Spark sorts all rows.
    """
    kinds, cols = dict(df.dtypes), [F.col(q(k)) for k in key]
    if all(kinds[k] in ("tinyint", "smallint", "int", "bigint") for k in key):
        ends = df.agg(*[f(c) for c in cols for f in (F.min, F.max)]).first()
        spans = [(lo, hi - lo + 2) for lo, hi in zip(ends[::2], ends[1::2], strict=True) if lo is not None]
        if len(spans) == len(key) and prod(n for _, n in spans) < 1 << 63 and all(hi < 1 << 62 and lo > -(1 << 62) for lo, hi in zip(ends[::2], ends[1::2], strict=True)):
            packed = F.lit(0).cast("long")
            for c, (lo, n) in zip(cols, spans, strict=True):
                packed = packed * F.lit(n) + F.coalesce(c.cast("long") - F.lit(lo) + F.lit(1), F.lit(0))
            return packed
    return F.struct(*cols)


def dbscan(df: DataFrame, features: list[str], *, key: list[str], eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """``key`` columns and ``cluster`` (long, -1 is noise) of every row of ``df``.

    A feature is a number, or a single one an array of numbers of one
    length.  ``min_samples`` counts the row itself.
    """
    kinds = dict(df.dtypes)
    if len(features) == 1 and kinds[features[0]].startswith("array"):
        x = F.col(q(features[0])).cast("array<double>")
        dims = df.agg(F.max(F.size(x))).first()[0] or 1
        bad = F.coalesce((F.size(x) != dims) | F.exists(x, lambda v: v.isNull() | F.isnan(v)), F.lit(True))
        x = F.transform(x, lambda v: v + F.lit(0.0))
    else:
        values, dims = [F.col(q(f)).cast("double") + F.lit(0.0) for f in features], len(features)
        bad = reduce(or_, [v.isNull() | F.isnan(v) for v in values], F.lit(False))
        x = F.array(*values)
    given = df.select(*[q(k) for k in key], F.when(~bad, x).alias("x"))
    rows = given.where("x IS NOT NULL").select("x", _order_key(df, key).alias("key"))
    points = stored(_points(rows, dims))
    tree = _tree(points, dims)
    wholes, pairs, leaves = _descend(tree, float(eps), int(min_samples))
    wholes = stored(wholes)

    n_pairs = pairs.count()
    points = _core_points(pairs, n_pairs, points, leaves, dims, float(eps), int(min_samples))
    found = _found_links(pairs, n_pairs, points, dims, float(eps))

    # cluster graph: points, and nodes all of whose core points are in one cluster
    spark, top = df.sparkSession, len(tree) - 1
    holds = [points.where("core").select(F.col("leaf").alias("node")).distinct()]
    for _ in range(top):
        holds.append(holds[-1].select(F.shiftright("node", FAN_BITS).alias("node")).distinct())
    cored = spark.createDataFrame([], "level int, node long")
    for level, nodes in enumerate(holds):
        cored = cored.unionByName(nodes.select(F.lit(level).alias("level"), "node"))
    cored = stored(cored)
    joined = wholes.join(_big(cored.withColumnRenamed("node", "a")), ["level", "a"], "left_semi").join(_big(cored.withColumnRenamed("node", "b")), ["level", "b"], "left_semi")
    joined = stored(joined.select("level", "a", "b"))
    edges = found.where("core").select("a", "b").unionByName(joined.select(_vertex(F.col("level"), "a").alias("a"), _vertex(F.col("level"), "b").alias("b")))
    active = None
    for level in reversed(range(top + 1)):
        own = joined.where(F.col("level") == level)
        nodes = own.select(F.col("a").alias("node")).unionByName(own.select(F.col("b").alias("node")))
        if active is not None:
            here = cored.where(F.col("level") == level).select("node", F.shiftright("node", FAN_BITS).alias("up"))
            below = stored(here.join(_big(active.withColumnRenamed("node", "up")), "up"))
            edges = edges.unionByName(below.select(_vertex(F.lit(level), "node").alias("a"), _vertex(F.lit(level + 1), "up").alias("b")))
            nodes = nodes.unionByName(below.select("node"))
        active = stored(nodes.distinct())
    inside = points.where("core").select("pid", F.col("leaf").alias("node")).join(_big(active), "node")
    edges = edges.unionByName(inside.select(F.col("pid").alias("a"), _vertex(F.lit(0), "node").alias("b")))
    label = components(edges)

    # clusters in the order of their first core row
    cores = points.where("core").select("pid", "leaf", "first").join(_big(label), F.col("pid") == F.col("node"), "left")
    cores = stored(cores.select("pid", "leaf", "first", F.coalesce("label", "pid").alias("label")))
    order = numbered(cores.groupBy("label").agg(F.min("first").alias("first")), [F.col("first").asc_nulls_first(), F.col("label")], "cluster")
    cores = stored(cores.join(_big(order.select("label", "cluster")), "label").select("pid", "leaf", "cluster"))

    # other points: the first cluster near them, point by point or as a whole
    touch = found.where("NOT core").select(F.col("a").alias("_p"), F.col("b").alias("pid")).join(_big(cores), "pid").select(F.col("_p").alias("pid"), "cluster")
    first = cores.groupBy(F.col("leaf").alias("node")).agg(F.min("cluster").alias("cluster"))
    best = spark.createDataFrame([], "level int, node long, cluster long")
    for level in range(top + 1):
        best = best.unionByName(first.select(F.lit(level).alias("level"), "node", "cluster"))
        first = first.groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(F.min("cluster").alias("cluster"))
    best = stored(best)
    turned = wholes.unionByName(wholes.where("a <> b").select("level", F.col("b").alias("a"), F.col("a").alias("b")))
    offered = stored(turned.join(_big(best.withColumnRenamed("node", "b")), ["level", "b"]).groupBy("level", F.col("a").alias("node")).agg(F.min("cluster").alias("cluster")))
    down = None
    for level in reversed(range(top + 1)):
        own = offered.where(F.col("level") == level).select("node", "cluster")
        if down is not None:
            kids = tree[level].select("node", F.shiftright("node", FAN_BITS).alias("up")).join(_big(down.withColumnRenamed("node", "up")), "up").select("node", "cluster")
            own = own.unionByName(kids).groupBy("node").agg(F.min("cluster").alias("cluster"))
        down = stored(own)
    edge = points.where("NOT core").select("pid", F.col("leaf").alias("node")).join(_big(down), "node").select("pid", "cluster")
    border = touch.unionByName(edge).groupBy("pid").agg(F.min("cluster").alias("cluster"))
    known = cores.select("pid", "cluster").unionByName(border)
    by_point = points.select("pid", "x").join(_big(known), "pid").select("x", "cluster")
    # the hash comes first, so that a sort seldom compares arrays
    by_point = stored(by_point.select(F.xxhash64("x").alias("h"), "x", "cluster"))
    return given.withColumn("h", F.xxhash64("x")).join(by_point, ["h", "x"], "left").select(*[q(k) for k in key], F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))
