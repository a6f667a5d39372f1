"""Clustering quality (V5–V8) over all rows.

Davies–Bouldin and Calinski–Harabasz are aggregates: sums per cluster give
the centroids (clusters × features, small), one more pass the distances to
them.

The silhouette is Euclidean, and its mean distances have no closed form.
Every row is scored against every row, equal ones once with their number as
weight.  Space is cut into blocks of at most some ``BLOCK_ROWS`` points; a
task takes one block and the blocks near it, and both sides are halved as
trees.  Where two boxes are at least the larger one's width apart the
distance is a smooth function of both ends, and is interpolated between
``ORDER`` Chebyshev points a side (a fast multipole method): the sum over all
points of a box is a sum over its ``ORDER`` ** dimensions points.  All other
pairs are taken one by one, also all of them where a box has more than
``GRID`` such points (many dimensions): the work is near linear in few
dimensions and rows x rows in many.  How the pairs are cut does not depend on
what they add; interpolation moves a distance by less than a millionth of it,
which is no part of ``silhouette_error``.

A caller who names ``reference_bytes`` gets distances to the points of least
seeded hash of each cluster that fit into that size together, and a bound:
with 95 % probability over the choice of references the score is off by no
more than it.  No query does.

Fewer than 11 valid rows or a single cluster give 0 / 999 / 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import q
from ..session import stored
from .knn import SAMPLE_BYTES, SAMPLE_ROWS, _Cells

SCORES = "silhouette double, davies_bouldin double, calinski_harabasz double, n_clusters long, silhouette_references long, silhouette_error double"
#: Points of a block, and the bytes of its coordinates and of its sums.
BLOCK_ROWS = 1 << 14
BLOCK_BYTES = 2 << 20
SUM_BYTES = 32 << 20
#: Bytes of the blocks that a task holds at once, and of all blocks' interpolation points (they are sent to every task).
NEAR_BYTES = 32 << 20
FAR_BYTES = 64 << 20
#: Interpolation points of a box a side, and at most; points of a tree's leaf; clusters summed up at once.
ORDER = 8
GRID = 1000
LEAF = 128
CLUSTERS = 64
#: Rows and references whose distances are taken at once (they stay in a core's cache), and distances of a task.
BLOCK = (64, 1024)
PAIRS = 1 << 30


_ROOTS = np.cos((2 * np.arange(ORDER) + 1) * np.pi / (2 * ORDER))
_BASIS = np.cos(np.outer(np.arange(ORDER), (2 * np.arange(ORDER) + 1) * np.pi / (2 * ORDER))) * np.where(np.arange(ORDER) == 0, 1.0, 2.0)[:, None] / ORDER


def _grid(lo, hi) -> np.ndarray | None:
    """The interpolation points of a box (one in a side without width); none if they are too many."""
    if ORDER ** sum(b > a for a, b in zip(lo, hi, strict=True)) > GRID:
        return None
    sides = [(a + b) / 2 + (b - a) / 2 * _ROOTS if b > a else np.array([a]) for a, b in zip(lo, hi, strict=True)]
    return np.stack(np.meshgrid(*sides, indexing="ij"), axis=-1).reshape(-1, len(sides))


def _shares(x: np.ndarray, lo, hi) -> np.ndarray:
    """The share of each interpolation point of a box in the value at each row of ``x``."""
    out = np.ones((len(x), 1))
    for j, (a, b) in enumerate(zip(lo, hi, strict=True)):
        if b > a:
            u = np.clip((2 * x[:, j] - a - b) / (b - a), -1.0, 1.0)
            one = np.cos(np.arccos(u)[:, None] * np.arange(ORDER)) @ _BASIS
            out = (out[:, :, None] * one[:, None, :]).reshape(len(x), -1)
    return out


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.subtract.outer(x[:, 0], y[:, 0])
    np.multiply(out, out, out=out)
    for j in range(1, x.shape[1]):
        d = np.subtract.outer(x[:, j], y[:, j])
        np.multiply(d, d, out=d)
        out += d
    return np.sqrt(out, out=out)


class _Node:
    """A box of points: ``n`` of them, rows ``at`` to ``to`` of a tree, its halves, and the sums at its interpolation points.

    ``mass`` are the weights of its points as a source, ``field`` the distances to far boxes as a target.
    """

    __slots__ = ("at", "to", "n", "lo", "hi", "wide", "parts", "grid", "mass", "field", "block")

    def __init__(self, lo, hi, n, at=0, to=0, parts=(), block=-1):
        self.lo, self.hi, self.n, self.at, self.to, self.parts, self.block = tuple(map(float, lo)), tuple(map(float, hi)), n, at, to, parts, block
        self.wide = max(b - a for a, b in zip(self.lo, self.hi, strict=True))
        self.grid, self.mass, self.field = None, None, None

    @property
    def size(self) -> int:
        """Interpolation points, 0 if they are too many."""
        m = ORDER ** sum(b > a for a, b in zip(self.lo, self.hi, strict=True))
        return m if m <= GRID else 0

    def points(self) -> np.ndarray:
        if self.grid is None:
            self.grid = _grid(self.lo, self.hi)
        return self.grid

    def far(self, other: "_Node") -> bool:
        """Whether the boxes are so far apart, and have so many points, that the sums go by interpolation."""
        gap = 0.0
        for a, b, c, d in zip(self.lo, self.hi, other.lo, other.hi, strict=True):
            g = c - b if c > b else a - d if a > d else 0.0
            gap += g * g
        width = max(self.wide, other.wide)
        return gap > 0 and gap >= width * width and 0 < self.size * other.size < self.n * other.n


def _tree(x: np.ndarray) -> tuple[np.ndarray, _Node]:
    """Order of the rows of ``x`` in a tree of halves along the widest side, and its root."""
    order = np.arange(len(x))

    def node(at: int, to: int) -> _Node:
        part = x[order[at:to]]
        lo, hi = part.min(axis=0), part.max(axis=0)
        if to - at <= LEAF or not (hi > lo).any():
            return _Node(lo, hi, to - at, at, to)
        half = (to - at) // 2
        order[at:to] = order[at:to][np.argpartition(part[:, int((hi - lo).argmax())], half)]
        return _Node(lo, hi, to - at, at, to, (node(at, at + half), node(at + half, to)))

    return order, node(0, len(x))


def _mass(node: _Node, x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights of a box's points (rows of ``w`` by cluster) at its interpolation points."""
    if node.mass is None:
        if node.parts:
            node.mass = sum(_shares(p.points(), node.lo, node.hi).T @ _mass(p, x, w) for p in node.parts)
        else:
            node.mass = _shares(x[node.at:node.to], node.lo, node.hi).T @ w[node.at:node.to]
    return node.mass


def _reach(node: _Node, distances: np.ndarray) -> None:
    node.field = distances if node.field is None else node.field + distances


def _add(target: _Node, x: np.ndarray, out: np.ndarray, source: _Node, y: np.ndarray, w: np.ndarray) -> None:
    """Adds to ``out`` the weighted distances of the target's rows ``x`` to the source's rows ``y``, or to its boxes' fields."""
    todo = [(target, source)]
    while todo:
        t, s = todo.pop()
        if t.far(s):
            _reach(t, _distances(t.points(), s.points()) @ _mass(s, y, w))
        elif t.n * s.n <= LEAF * LEAF or not (t.parts or s.parts):
            out[t.at:t.to] += _distances(x[t.at:t.to], y[s.at:s.to]) @ w[s.at:s.to]
        elif s.parts and (s.wide >= t.wide or not t.parts):
            todo += [(t, p) for p in s.parts]
        else:
            todo += [(p, s) for p in t.parts]


def _settle(node: _Node, x: np.ndarray, out: np.ndarray) -> None:
    """The fields of all boxes at the rows ``x``, added to ``out``."""
    todo = [node]
    while todo:
        n = todo.pop()
        if n.field is not None:
            for p in n.parts:
                _reach(p, _shares(p.points(), n.lo, n.hi) @ n.field)
            if not n.parts:
                out[n.at:n.to] += _shares(x[n.at:n.to], n.lo, n.hi) @ n.field
        todo += n.parts


def _forest(blocks: list[_Node]) -> _Node:
    """A tree over blocks, halved along the widest side."""
    if len(blocks) == 1:
        return blocks[0]
    lo, hi = np.min([b.lo for b in blocks], axis=0), np.max([b.hi for b in blocks], axis=0)
    j = int((hi - lo).argmax())
    blocks = sorted(blocks, key=lambda b: b.lo[j] + b.hi[j])
    parts = _forest(blocks[: len(blocks) // 2]), _forest(blocks[len(blocks) // 2:])
    top = _Node(lo, hi, parts[0].n + parts[1].n, parts=parts)
    if top.size:
        _mass(top, np.empty((0, len(lo))), np.empty((0, 0)))
    return top


def _parted(block: _Node, forest: _Node) -> tuple[list[_Node], list[int]]:
    """The boxes that are far from a block, and the blocks that are not."""
    far, near, todo = [], [], [forest]
    while todo:
        s = todo.pop()
        if block.far(s):
            far.append(s)
        elif s.parts:
            todo += s.parts
        else:
            near.append(s.block)
    return far, near


def _pack(x: np.ndarray, w: np.ndarray, c: np.ndarray) -> bytes:
    return x.astype("<f8").tobytes() + w.astype("<f8").tobytes() + c.astype("<i4").tobytes()


def _unpack(data: bytes, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) // (8 * dims + 12)
    x = np.frombuffer(data, "<f8", n * dims).reshape(n, dims)
    return x, np.frombuffer(data, "<f8", n, 8 * n * dims), np.frombuffer(data, "<i4", n, 8 * n * (dims + 1))


def _by_cluster(w: np.ndarray, c: np.ndarray, first: int, last: int) -> np.ndarray:
    """Weights as a column for each of the clusters ``first`` to ``last``."""
    out = np.zeros((len(w), last - first))
    mine = np.flatnonzero((c >= first) & (c < last))
    out[mine, c[mine] - first] = w[mine]
    return out


def silhouette(rows: DataFrame, cols: list[str], sizes: dict, *, reference_bytes: int | None = None, seed: int = 42) -> tuple[float, int, float]:
    """Mean silhouette of ``rows`` (c, cols), the number of reference rows (all, unless ``reference_bytes`` is given), and the error bound.

    ``sizes``: rows of each cluster.
    """
    if reference_bytes is not None:
        return _silhouette_by_references(rows, cols, sizes, reference_bytes, seed)
    names, dims = sorted(sizes), len(cols)
    number, size = {c: i for i, c in enumerate(names)}, np.array([sizes[c] for c in names], dtype="float64")
    points = stored(rows.groupBy("c", *cols).agg(F.count(F.lit(1)).alias("w")))
    odd = F.lit(False)
    for c in cols:
        odd = odd | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    n, everything, wrong = points.agg(F.count(F.lit(1)), F.sum("w"), F.max(odd)).first()
    if wrong:
        return float("nan"), int(everything), float("nan")
    block_rows = max(LEAF, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dims), SUM_BYTES // (8 * len(names))))
    share = -(-n // min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dims)))
    sample = points.where(F.pmod(F.xxhash64(*cols), F.lit(share)) == 0).select(*cols).toPandas().to_numpy(dtype="float64").reshape(-1, dims)
    spark = rows.sparkSession
    context = spark.sparkContext
    cells = context.broadcast(_Cells(sample, max(1, block_rows // share)))

    def settle(batches):
        for pdf in batches:
            yield pdf.assign(cell=cells.value.home(pdf[cols].to_numpy(dtype="float64")))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x, w, c = pdf[cols].to_numpy(dtype="float64"), pdf["w"].to_numpy(dtype="float64"), pdf["c"].map(number).to_numpy()
        # a cell may hold more than a block: the sample places the cuts
        order = _tree(x)[0]
        of = [order[lo: lo + block_rows] for lo in range(0, len(x), block_rows)]
        return pd.DataFrame({"cell": [int(pdf["cell"].iloc[0])] * len(of), "n": [len(i) for i in of], "lo": [x[i].min(axis=0).tolist() for i in of],
                             "hi": [x[i].max(axis=0).tolist() for i in of], "data": [_pack(x[i], w[i], c[i]) for i in of]})

    kind = dict(points.dtypes)["c"]
    fields = "".join(f", {c} double" for c in cols)
    placed = points.mapInPandas(settle, f"c {kind}{fields}, w long, cell long")
    blocks = stored(stored(placed.groupBy("cell").applyInPandas(pack, "cell long, n long, lo array<double>, hi array<double>, data binary"))
                    .drop("cell").withColumn("block", F.monotonically_increasing_id()))
    boxes = blocks.select("block", "n", "lo", "hi").collect()  # a row per block
    most = max(_Node(b["lo"], b["hi"], b["n"]).size for b in boxes)
    step = max(1, min(CLUSTERS, FAR_BYTES // (16 * len(boxes) * max(1, most))))
    held = max(1, NEAR_BYTES // (block_rows * (8 * dims + 12)))
    found = None
    for first in range(0, len(names), step):
        part = _sums(blocks, boxes, dims, first, min(first + step, len(names)), held)
        found = part if found is None else found.unionByName(part)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.loc[(pdf["first"] == 0) & (pdf["part"] == 0)].iloc[0]
        w, own = np.frombuffer(head["w"], "<f8"), np.frombuffer(head["c"], "<i4")
        at, a, b = np.arange(len(w)), np.zeros(len(w)), np.full(len(w), np.inf)
        for lo, group in pdf.groupby("first"):
            total = sum(np.frombuffer(v, "<f8") for v in group.sort_values("part")["sums"]).reshape(len(w), -1)
            mean = total / size[lo: lo + total.shape[1]]
            mine = (own >= lo) & (own < lo + total.shape[1])
            # a row is no neighbour of itself; it is at distance 0
            a[mine] = total[at[mine], own[mine] - lo] / np.maximum(1.0, size[own[mine]] - 1)
            mean[at[mine], own[mine] - lo] = np.inf
            b = np.minimum(b, mean.min(axis=1))
        s = np.where(size[own] == 1, 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-300))
        return pd.DataFrame({"s": [float(s @ w)]})

    total = found.groupBy("t").applyInPandas(score, "s double").agg(F.sum("s")).first()[0]
    return total / int(everything), int(everything), 0.0


def _sums(blocks: DataFrame, boxes: list, dims: int, first: int, last: int, held: int) -> DataFrame:
    """Of each block (``t``) its points' weighted distances to all points of the clusters ``first`` to ``last``, in parts to be added up.

    ``held``: near blocks that a task takes.
    """
    spark = blocks.sparkSession

    def expand(batches):
        for pdf in batches:
            for b, lo, hi, data in zip(pdf["block"], pdf["lo"], pdf["hi"], pdf["data"], strict=True):
                x, w, c = _unpack(data, dims)
                q, mass = _by_cluster(w, c, first, last), 0.0
                for at in range(0, len(x), 1024):
                    mass = mass + _shares(x[at: at + 1024], lo, hi).T @ q[at: at + 1024]
                yield pd.DataFrame({"block": [b], "mass": [mass.astype("<f8").tobytes()]})

    small = {b["block"]: _Node(b["lo"], b["hi"], b["n"], block=b["block"]) for b in boxes}
    if all(b.size for b in small.values()):
        for r in blocks.mapInPandas(expand, "block long, mass binary").collect():  # at most FAR_BYTES
            small[r["block"]].mass = np.frombuffer(r["mass"], "<f8").reshape(-1, last - first)
    forest = spark.sparkContext.broadcast((_forest(list(small.values())), small))

    def ask(batches):
        top, own = forest.value
        for pdf in batches:
            for t in pdf["block"]:
                near = sorted(_parted(own[t], top)[1])
                parts = max(1, -(-len(near) // held))
                yield pd.DataFrame({"t": t, "part": [i // held for i in range(len(near))] + list(range(parts)), "s": near + [t] * parts,
                                    "own": [False] * len(near) + [True] * parts})

    asked = stored(blocks.select("block").mapInPandas(ask, "t long, part long, s long, own boolean"))
    tasks = min(1024, asked.where("own").count())

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t, part = key
        top, own = forest.value
        x, w, c = _unpack(pdf.loc[pdf["own"], "data"].iloc[0], dims)
        order, root = _tree(x)
        sorted_x, out = np.ascontiguousarray(x[order]), np.zeros((len(x), last - first))
        if part == 0:
            for s in _parted(own[t], top)[0]:
                _reach(root, _distances(root.points(), s.points()) @ s.mass)
        for data in pdf.loc[~pdf["own"], "data"]:
            y, v, k = _unpack(data, dims)
            q = _by_cluster(v, k, first, last)
            here = q.any(axis=1)
            if here.any():
                y, q = y[here], q[here]
                turn, source = _tree(y)
                _add(root, sorted_x, out, source, np.ascontiguousarray(y[turn]), q[turn])
        _settle(root, sorted_x, out)
        sums = np.empty_like(out)
        sums[order] = out
        head = first == 0 and part == 0
        return pd.DataFrame({"t": [t], "first": [first], "part": [part], "sums": [sums.astype("<f8").tobytes()],
                             "w": [w.tobytes() if head else b""], "c": [c.tobytes() if head else b""]})

    given = asked.join(blocks.select(F.col("block").alias("s"), "data"), "s").select("t", "part", "own", "data")
    # tasks by the work, not by bytes
    return stored(given.repartition(tasks, "t", "part").groupBy("t", "part").applyInPandas(run, "t long, first long, part long, sums binary, w binary, c binary"))


def _silhouette_by_references(rows: DataFrame, cols: list[str], sizes: dict, reference_bytes: int, seed: int) -> tuple[float, int, float]:
    """The silhouette against a sample of each cluster's points, with its error bound."""
    each = max(2, reference_bytes // (8 * len(cols) * len(sizes)))
    points = stored(rows.groupBy("c", *cols).agg(F.count(F.lit(1)).alias("w")))
    counts = {r["c"]: r["n"] for r in points.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per cluster
    marked = points.withColumn("_h", F.xxhash64(F.lit(seed), *cols))
    if any(n > each for n in counts.values()):
        marked = marked.withColumn("_n", F.row_number().over(Window.partitionBy("c").orderBy("_h", *cols))).where(F.col("_n") <= each)
    sample = marked.select("c", "w", *cols).toPandas()  # at most reference_bytes, and the weights
    names = sorted(sizes)
    refs = [np.ascontiguousarray(sample.loc[sample["c"] == c, cols].to_numpy(dtype="float64").T) for c in names]
    weights = [sample.loc[sample["c"] == c, "w"].to_numpy(dtype="float64") for c in names]
    whole = [w.sum() == sizes[c] for w, c in zip(weights, names, strict=True)]
    shared = rows.sparkSession.sparkContext.broadcast((names, refs, weights, whole, [sizes[c] for c in names]))

    def sums(x: np.ndarray, ref: np.ndarray, w: np.ndarray, rest: bool) -> tuple:
        """Of each row's distances to the references: weighted sum, and for the error of a part of them the sums of w² d² and w² d."""
        total, square, plain = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
        d, side = np.empty((len(x), BLOCK[1])), np.empty((len(x), BLOCK[1]))
        for at in range(0, ref.shape[1], BLOCK[1]):
            part, v = ref[:, at: at + BLOCK[1]], w[at: at + BLOCK[1]]
            a, b = d[:, : part.shape[1]], side[:, : part.shape[1]]
            for k in range(len(part)):
                to = b if k else a
                np.subtract(x[:, k, None], part[None, k], out=to)
                np.multiply(to, to, out=to)
                if k:
                    np.add(a, b, out=a)
            if rest:
                square += a @ (v * v)
            np.sqrt(a, out=a)
            total += a @ v
            if rest:
                plain += a @ (v * v)
        return total, square, plain

    def run(batches):
        names, refs, weights, whole, n = shared.value
        at = {c: i for i, c in enumerate(names)}
        for pdf in batches:
            for lo in range(0, len(pdf), BLOCK[0]):
                part = pdf.iloc[lo: lo + BLOCK[0]]
                x, own, count = part[cols].to_numpy(dtype="float64"), np.array([at[c] for c in part["c"]]), part["w"].to_numpy(dtype="float64")
                mean, off = np.empty((len(x), len(refs))), np.zeros((len(x), len(refs)))
                for i, (ref, w) in enumerate(zip(refs, weights, strict=True)):
                    total, square, plain = sums(x, ref, w, not whole[i])
                    # a row is no neighbour of itself; it is at distance 0, if it is among the references at all
                    mean[:, i] = total / w.sum()
                    if whole[i]:
                        mine = own == i
                        mean[mine, i] = total[mine] / max(1, n[i] - 1)
                    else:
                        spread = square - 2 * mean[:, i] * plain + mean[:, i] ** 2 * (w * w).sum()
                        off[:, i] = 1.96 * np.sqrt(np.maximum(spread, 0.0)) / w.sum()
                a, ea = mean[np.arange(len(x)), own], off[np.arange(len(x)), own]
                mean[np.arange(len(x)), own] = np.inf
                near = mean.argmin(axis=1)
                b, eb = mean[np.arange(len(x)), near], off[np.arange(len(x)), near]
                most = np.maximum(np.maximum(a, b), 1e-300)
                alone = np.array(n)[own] == 1
                s = np.where(alone, 0.0, (b - a) / most)
                e = np.where(alone, 0.0, np.minimum(2.0, (ea + eb) / most))
                yield pd.DataFrame({"s": [float(s @ count)], "e": [float(e @ count)], "n": [int(count.sum())]})

    # tasks by the distances to be taken, not by bytes
    tasks = max(1, min(-(-sum(counts.values()) // BLOCK[0]), sum(counts.values()) * len(sample) // PAIRS + 1))
    total = points.repartition(tasks).mapInPandas(run, "s double, e double, n long").agg(F.sum("s"), F.sum("e"), F.sum("n")).first()
    return total[0] / total[2], int(sample["w"].sum()), total[1] / total[2]


def clustering_scores(labelled: DataFrame, features: list[str], cluster: str) -> DataFrame:
    """One row: ``silhouette, davies_bouldin, calinski_harabasz, n_clusters`` and the silhouette's reference rows and error bound; cluster -1 is noise."""
    spark = labelled.sparkSession
    rows = stored(labelled.where(F.col(q(cluster)) != -1).select(
        F.col(q(cluster)).alias("c"), *[F.col(q(f)).cast("double").alias(f"f{i}") for i, f in enumerate(features)]))
    cols = [f"f{i}" for i in range(len(features))]
    centres = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"m_{f}") for f in cols])
    here = {r["c"]: r for r in centres.collect()}  # one row per cluster
    n, k = sum(r["n"] for r in here.values()), len(here)
    if n <= 10 or k < 2:
        return spark.createDataFrame([(0.0, 999.0, 0.0, k, 0, 0.0)], SCORES)
    square = sum(((F.col(f) - F.col(f"m_{f}")) ** 2 for f in cols), F.lit(0.0))
    spread = rows.join(F.broadcast(centres.drop("n")), "c").groupBy("c").agg(F.avg(F.sqrt(square)).alias("s"), F.sum(square).alias("w"))
    spread = {r["c"]: r for r in spread.collect()}

    def apart(a, b) -> float:
        return sum((a[f"m_{f}"] - b[f"m_{f}"]) ** 2 for f in cols)

    def ratio(a, b) -> float:
        d = apart(here[a], here[b]) ** 0.5
        s = spread[a]["s"] + spread[b]["s"]
        return s / d if d > 0 else float("inf") if s > 0 else 0.0

    db = sum(max(ratio(a, b) for b in here if b != a) for a in here) / k
    mean = {f"m_{f}": sum(r["n"] * r[f"m_{f}"] for r in here.values()) / n for f in cols}
    between = sum(r["n"] * apart(r, mean) for r in here.values())
    within = sum(r["w"] for r in spread.values())
    ch = between * (n - k) / (within * (k - 1)) if within > 0 else 1.0
    score, references, error = silhouette(rows, cols, {c: r["n"] for c, r in here.items()})
    return spark.createDataFrame([(round(score, 4), round(db, 4), round(ch, 2), k, references, round(error, 4))], SCORES)
