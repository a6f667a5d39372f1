"""k-nearest-neighbour regression and classification.

``knn_join`` uses every training row, however many: space is cut into cells
of some thousand training rows, at medians of a sample (the sample places
the cuts only).  A test row meets the rows of its own cell, and with the
distance of its k-th nearest there the rows of each other cell whose box is
no farther; the partial lists are merged by a bounded top-k.  In few
dimensions these are a handful of cells; in many it may be all of them.
Nearest means by distance, then by the text of the key.  A task holds one
cell, one block of test rows and ``DISTANCES`` distances.

``knn_predict`` takes all training rows too; only a caller that names
``max_rows`` gets the reference's seeded sample of that size.  Inverse-distance
weights; a zero distance wins outright.  No pair of rows is materialised as a
DataFrame row beyond the k nearest of a cell.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.kinds import q
from ..session import stored
from .split import rank_below, seeded_order

#: Bytes of coordinates in a block of training and of test rows.
TRAIN_BLOCK_BYTES = 8 << 20
TEST_BLOCK_BYTES = 2 << 20
#: Training rows of a cell in no dimensions, doubled for each up to the fifth; the cuts come from a sample of at most so many rows and bytes.
CELL_ROWS = 512
SAMPLE_ROWS = 1 << 18
SAMPLE_BYTES = 64 << 20
#: Distances that a task holds at once.
DISTANCES = 1 << 21


def sample_train(train: DataFrame, key: list[str], *, max_rows: int, seed: int = P.RANDOM_SEED) -> DataFrame:
    """Exactly ``min(n, max_rows)`` rows, chosen by a seeded md5 order of ``key``."""
    n = train.count()
    if n <= max_rows:
        return train
    order = seeded_order(key, seed)
    cut = rank_below(train, F.lit("all"), order, [F.col(q(k)).cast("string") for k in key], {"all": [max_rows]})
    return cut.where("_below_0").drop("_below_0")


def positive_class(classes: list[str]) -> int | None:
    """Index of the positive class: the larger of two labels (numbers by value), else "1" if there is one."""
    def rank(c: str):
        try:
            return (0, float(c), c)
        except ValueError:
            return (1, 0.0, c)

    if len(classes) == 2:
        return max(range(2), key=lambda i: rank(classes[i]))
    return classes.index("1") if "1" in classes else None


def knn_predict(train: DataFrame, test: DataFrame, features: list[str], label: str, *, key: list[str],
                task: str = "classification", k: int = P.KNN_NEIGHBOURS, keep: list[str] | None = None,
                seed: int = P.RANDOM_SEED, max_rows: int | None = None) -> DataFrame:
    """Predictions for every test row: ``keep… , prediction`` (+ ``score`` =
    weighted share of the positive class for classification).

    All training rows count, a class without a name as "None"; equal distances go by the keys' values.  ``max_rows``,
    if given, asks for a seeded training sample of that size.  The positive class is the larger of two labels, else "1".
    """
    rows = train.select(*[q(c) for c in dict.fromkeys([*key, *features, label])])
    if max_rows is not None:
        rows = stored(sample_train(rows, key, max_rows=max_rows, seed=seed))
    if task == "classification":
        rows = rows.withColumn(label, F.coalesce(F.col(q(label)).cast("string"), F.lit("None")))
    return knn_join(rows, test, features, label, key=key, task=task, k=k, keep=keep, by_value=True)


def _coordinates(df: DataFrame, features: list[str]) -> Column:
    if len(features) == 1 and dict(df.dtypes)[features[0]].startswith("array"):
        return F.transform(F.col(q(features[0])), lambda v: v.cast("double"))
    return F.array(*[F.col(q(f)).cast("double") for f in features])


class _Cells:
    """A cut of space into cells of about ``rows`` training rows, by medians of a sample along its widest side.

    ``dim`` and ``cut`` of each node (x <= cut goes left), ``left`` and ``right`` (-1: a leaf, whose cell is ``cell``),
    and the box ``lo``, ``hi`` that its cuts leave.
    """

    def __init__(self, sample: np.ndarray, rows: int):
        dims = sample.shape[1]
        self.dim, self.cut, self.left, self.right, self.cell, lo, hi, self.n = [], [], [], [], [], [], [], 0
        todo = [(sample, np.full(dims, -np.inf), np.full(dims, np.inf), None)]
        while todo:
            x, a, b, under = todo.pop()
            me = len(self.dim)
            if under is not None:
                under[0][under[1]] = me
            for of, v in ((self.dim, 0), (self.cut, np.inf), (self.left, -1), (self.right, -1), (self.cell, -1), (lo, a), (hi, b)):
                of.append(v)
            spread = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(dims)
            if len(x) <= max(1, rows) or not spread.any():
                self.cell[me], self.n = self.n, self.n + 1
                continue
            d = int(spread.argmax())
            v = x[:, d]
            at = np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2]
            if at == v.max():  # more than half of them have the greatest value
                at = v[v < at].max()
            self.dim[me], self.cut[me] = d, at
            below, above = b.copy(), a.copy()
            below[d] = above[d] = at
            todo += [(x[v > at], above, b, (self.right, me)), (x[v <= at], a, below, (self.left, me))]
        self.dim, self.left, self.right, self.cell = (np.array(v, dtype="int64") for v in (self.dim, self.left, self.right, self.cell))
        self.cut, self.lo, self.hi = np.array(self.cut), np.array(lo), np.array(hi)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row of ``x``."""
        at = np.zeros(len(x), dtype="int64")
        while (inner := np.flatnonzero(self.left[at] >= 0)).size:
            node = at[inner]
            at[inner] = np.where(x[inner, self.dim[node]] <= self.cut[node], self.left[node], self.right[node])
        return self.cell[at]

    def within(self, x: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells whose box is no farther from a row than its ``far``."""
        rows, nodes, out = np.arange(len(x)), np.zeros(len(x), dtype="int64"), []
        while len(rows):
            gap = np.maximum(np.maximum(self.lo[nodes] - x[rows], x[rows] - self.hi[nodes]), 0.0)
            near = np.sqrt((gap * gap).sum(axis=1)) <= far[rows] * (1 + 1e-9)
            rows, nodes = rows[near], nodes[near]
            leaf = self.left[nodes] < 0
            out.append((rows[leaf], self.cell[nodes[leaf]]))
            rows, nodes = rows[~leaf], nodes[~leaf]
            rows, nodes = np.concatenate([rows, rows]), np.concatenate([self.left[nodes], self.right[nodes]])
        return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (rows, nodes)


def _points(column: pd.Series, dims: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64") if len(column) else np.zeros((0, dims))


def _key_text(df: DataFrame, c: str, by_value: bool) -> Column:
    """The text by which a key is ordered; with ``by_value`` whole numbers get texts in the order of their values."""
    x = F.col(q(c))
    if by_value and dict(df.dtypes)[c] in ("tinyint", "smallint", "int", "bigint"):
        x = F.lpad((x.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.coalesce(x.cast("string"), F.lit("~"))


def nearest_rows(train: DataFrame, test: DataFrame, features: list[str], *, key: list[str], carry: list[str], k: int, by_value: bool = False) -> DataFrame:
    """The ``k`` nearest training rows of each test row: ``_rid, d, t`` (key text) and the ``carry`` columns of the training row.

    ``test`` has ``_rid``.  Rows with a null coordinate have no neighbours and are none.  Equal distances go by the
    keys' texts, or with ``by_value`` by their numbers.
    """
    whole = lambda x: ~F.exists(x, lambda v: v.isNull() | F.isnan(v))
    text = F.concat_ws("|", *[_key_text(train, c, by_value) for c in key])
    right = train.select(_coordinates(train, features).alias("x"), text.alias("t"), *[F.col(q(c)) for c in carry]).where(whole(F.col("x")))
    left = test.select("_rid", _coordinates(test, features).alias("x")).where(whole(F.col("x")))
    # of rows at one place only the first k can be among the nearest
    right = stored(right.withColumn("_n", F.row_number().over(Window.partitionBy("x").orderBy("t", *[q(c) for c in carry]))).where(F.col("_n") <= k).drop("_n"))
    n, dims = right.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(1))).first()
    cell_rows = max(1, min(TRAIN_BLOCK_BYTES // (8 * dims), CELL_ROWS << min(dims, 5)))
    block_rows = max(1, TEST_BLOCK_BYTES // (8 * dims))
    share = max(1, math.ceil(n / min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dims))))
    sample = right.where(F.pmod(F.xxhash64("t", "x"), F.lit(share)) == 0).select("x").toPandas()["x"]
    shared = train.sparkSession.sparkContext.broadcast(_Cells(_points(sample, dims), max(1, cell_rows // share)))

    def settle(batches):
        for pdf in batches:
            yield pdf.assign(_cell=shared.value.home(_points(pdf["x"], dims)))

    def reach(batches):
        cells = shared.value
        step = max(1, (1 << 22) // (cells.n * dims))
        for pdf in batches:
            x, far, home = _points(pdf["x"], dims), pdf["far"].to_numpy(dtype="float64"), pdf["_cell"].to_numpy()
            for lo in range(0, len(x), step):
                i, c = cells.within(x[lo: lo + step], far[lo: lo + step])
                other = c != home[lo + i]
                yield pdf.iloc[lo + i[other]][["_rid", "x", "far"]].assign(_cell=c[other])

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in ["_rid", "d", "t", *carry]})
        xa, xb, far = _points(a["x"], dims), _points(b["x"], dims), a["far"].to_numpy(dtype="float64")
        b = b.reset_index(drop=True)
        place = np.empty(len(b), dtype="int64")
        place[np.argsort(b["t"].to_numpy(dtype=object), kind="stable")] = np.arange(len(b))
        nb, kk = (xb * xb).sum(axis=1), min(k, len(b))
        rid, dist, row = [], [], []
        step = max(1, DISTANCES // len(b))
        for lo in range(0, len(a), step):
            x = xa[lo: lo + step]
            rough = (x * x).sum(axis=1)[:, None] + nb[None, :] - 2.0 * x @ xb.T
            limit = np.partition(rough, kk - 1, axis=1)[:, kk - 1]
            # rounding of the rough distances is small against the squares that they come from
            i, j = np.nonzero(rough <= (limit + 1e-9 * ((x * x).sum(axis=1) + nb.max()))[:, None])
            d = np.sqrt(((x[i] - xb[j]) ** 2).sum(axis=1))
            order = np.lexsort((place[j], d, i))
            i, j, d = i[order], j[order], d[order]
            first = np.searchsorted(i, np.arange(len(x)))
            keep = (np.arange(len(i)) - first[i] < kk) & (d <= far[lo + i])
            rid.append(a["_rid"].to_numpy()[lo + i[keep]])
            dist.append(d[keep])
            row.append(j[keep])
        got = b.loc[np.concatenate(row), ["t", *carry]].reset_index(drop=True)
        got.insert(0, "d", np.concatenate(dist))
        got.insert(0, "_rid", np.concatenate(rid))
        return got

    kinds = {f.name: f.dataType.simpleString() for f in train.schema.fields}
    carried = "".join(f", {q(c)} {kinds[c]}" for c in carry)
    cells = stored(right.mapInPandas(settle, f"x array<double>, t string{carried}, _cell long"))

    def meet(asked: DataFrame) -> DataFrame:
        """The nearest of the asked cell for each row of (_rid, x, far, _cell); a cell that many ask meets them in blocks."""
        blocks = F.ceil(F.count(F.lit(1)) / block_rows).cast("long")
        many = stored(asked.groupBy("_cell").agg(blocks.alias("_m")))  # a row per cell
        a = asked.join(F.broadcast(many), "_cell").withColumn("_block", F.pmod(F.xxhash64("_rid"), F.col("_m"))).drop("_m")
        b = cells.join(F.broadcast(many), "_cell").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1))).drop("_m")
        return a.groupBy("_cell", "_block").cogroup(b.groupBy("_cell", "_block")).applyInPandas(near, f"_rid long, d double, t string{carried}")

    def first(found: DataFrame) -> DataFrame:
        best = F.row_number().over(Window.partitionBy("_rid").orderBy("d", "t", *[q(c) for c in carry]))
        return found.withColumn("_n", best).where(F.col("_n") <= k).drop("_n")

    # each row's own cell bounds the distance at which others can matter
    left = left if n else left.limit(0)
    asked = stored(left.withColumn("far", F.lit(float("inf"))).mapInPandas(settle, "_rid long, x array<double>, far double, _cell long"))
    own = stored(meet(asked))
    if shared.value.n == 1:
        return first(own)
    far = own.groupBy("_rid").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).otherwise(float("inf")).alias("far"))
    reached = asked.drop("far").join(far, "_rid", "left").withColumn("far", F.coalesce("far", F.lit(float("inf"))))
    other = stored(reached.select("_rid", "x", "far", "_cell").mapInPandas(reach, "_rid long, x array<double>, far double, _cell long"))
    return first(own.unionByName(meet(other)))


def knn_join(train: DataFrame, test: DataFrame, features: list[str], label: str, *, key: list[str], task: str = "regression",
             k: int = P.KNN_NEIGHBOURS, keep: list[str] | None = None, by_value: bool = False) -> DataFrame:
    """Predictions for every test row from its ``k`` nearest of all training rows: ``keep… , prediction`` (+ ``score``).

    Rows without a whole set of coordinates have a null prediction.
    """
    keep = keep or []
    rows = stored(test.withColumn("_rid", F.monotonically_increasing_id()))
    given = train.where(F.col(q(label)).isNotNull()).withColumn("_y", F.col(q(label)).cast("double" if task == "regression" else "string"))
    found = nearest_rows(given, rows, features, key=key, carry=["_y"], k=k, by_value=by_value)
    near = found.groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("d", "t", "_y"))).alias("_near"))  # k of a row
    # a zero distance wins outright
    hit = F.col("_near")[0]["d"] == 0
    near = near.withColumn("_near", F.transform("_near", lambda x: F.struct(F.when(hit, (x["d"] == 0).cast("double")).otherwise(1.0 / x["d"]).alias("w"), x["_y"].alias("y"))))

    def total(of) -> Column:
        return F.aggregate(of, F.lit(0.0), lambda a, v: a + v)

    whole = total(F.transform("_near", lambda x: x["w"]))
    if task == "regression":
        out = near.select("_rid", (total(F.transform("_near", lambda x: x["w"] * x["y"])) / whole).alias("prediction"))
    else:
        classes = sorted(r[0] for r in given.select("_y").distinct().collect())  # one row per class
        one = positive_class(classes)

        def votes(c) -> Column:
            return total(F.transform("_near", lambda x: F.when(x["y"] == c, x["w"]).otherwise(0.0)))

        ranked = F.transform(F.array_distinct(F.transform("_near", lambda x: x["y"])), lambda c: F.struct((-votes(c)).alias("w"), c.alias("y")))
        share = votes(F.lit(classes[one])) / whole if one is not None else F.lit(0.0)
        out = near.select("_rid", F.array_min(ranked)["y"].alias("prediction"), share.alias("score"))
    return rows.select("_rid", *[q(c) for c in keep]).join(out, "_rid", "left").drop("_rid")


class KnnModel:
    """Training rows kept for prediction: all of them, or a seeded sample of ``max_rows`` that the caller asked for."""

    def __init__(self, task: str, features: list[str], label: str, key: list[str], rows: DataFrame, *, k: int = P.KNN_NEIGHBOURS, max_rows: int | None = None):
        self.task, self.features, self.label, self.key, self.rows, self.k, self.max_rows = task, features, label, key, rows, k, max_rows

    def predict(self, df: DataFrame, keep: list[str]) -> DataFrame:
        how = dict(key=self.key, task=self.task, k=self.k, keep=keep)
        if self.max_rows is None and self.task == "regression":
            return knn_join(self.rows, df, self.features, self.label, **how)
        return knn_predict(self.rows, df, self.features, self.label, max_rows=self.max_rows, **how)

    def save(self, spark, path: str) -> None:
        import json

        self.rows.select(*[q(c) for c in dict.fromkeys([*self.key, *self.features, self.label])]).write.mode("overwrite").parquet(f"{path}/rows")
        facts = {x: getattr(self, x) for x in ("task", "features", "label", "key", "k", "max_rows")}
        spark.createDataFrame([("knn", json.dumps(facts))], "kind string, model string").coalesce(1).write.mode("overwrite").json(f"{path}/model")

    @staticmethod
    def load(spark, path: str, text: str) -> "KnnModel":
        import json

        return KnnModel(rows=spark.read.parquet(f"{path}/rows"), **json.loads(text))
