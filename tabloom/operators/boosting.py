"""AdaBoost as a loop of weighted Spark ML trees.

Classification is SAMME with depth-1 trees; regression is AdaBoost.R2 with
linear loss and depth-3 trees.  Each round fits a tree with the current
sample weights (``weightCol`` instead of the reference's weighted
resampling), scores the training rows, and updates the weight column with
one aggregate.  The weighted table is written to the shared checkpoint
folder every few rounds so lineage stays short and a lost executor
recomputes at most those rounds.

A fitted model is its trees as plain numbers: prediction is one projection
of comparisons (no stage per tree), and saving writes one JSON row.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import q
from ..session import cut_lineage
from .knn import positive_class

ROUNDS = 60
CHECKPOINT_EVERY = 5


def tree_rule(node) -> list | float:
    """A Spark tree as ``[feature, threshold, left, right]`` or a leaf's prediction."""
    if node.getClass().getSimpleName() == "LeafNode":
        return node.prediction()
    return [node.split().featureIndex(), node.split().threshold(), tree_rule(node.leftChild()), tree_rule(node.rightChild())]


def _outcome(rule, xs: list[Column], leaf) -> Column:
    if not isinstance(rule, list):
        return leaf(rule)
    feature, threshold, left, right = rule
    return F.when(xs[feature] <= F.lit(float(threshold)), _outcome(left, xs, leaf)).otherwise(_outcome(right, xs, leaf))


@dataclass
class AdaBoostModel:
    task: str
    features: list[str]
    rules: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)

    def predict(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` columns and ``prediction``; for classes with a positive one also ``score``, its probability.

        A null or NaN feature goes to the right of every threshold, as in the fitted trees.
        """
        kept = [F.col(q(k)) for k in keep]
        xs = [F.coalesce(F.col(q(c)).cast("double"), F.lit(float("nan"))) for c in self.features]
        if self.task == "classification":
            vote = lambda w: lambda c: F.array(*[F.lit(float(w) if i == int(c) else 0.0) for i in range(len(self.classes))])
            votes = F.array(*[_outcome(r, xs, vote(w)) for r, w in zip(self.rules, self.weights, strict=True)])
            total = F.aggregate(votes, F.array(*[F.lit(0.0)] * len(self.classes)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
            d = df.select(*kept, total.alias("_votes"))
            names = F.array(*[F.lit(c) for c in self.classes])
            # the first maximum: the smallest class on ties
            out = [F.element_at(names, F.array_position(F.col("_votes"), F.array_max("_votes")).cast("int")).alias("prediction")]
            one = positive_class(self.classes)
            if one is not None:
                # softmax of the weighted votes, each class against the others
                k, share = len(self.classes), lambda i: F.col("_votes")[i] / F.lit(sum(self.weights))
                margin = lambda i: share(i) - (F.lit(1.0) - share(i)) / (k - 1)
                parts = [F.exp(margin(i) if k == 2 else margin(i) / (k - 1)) for i in range(k)]
                out.append((parts[one] / sum(parts[1:], parts[0])).alias("score"))
            return d.select(*kept, *out)
        value = lambda w: lambda v: F.struct(F.lit(float(v)).alias("p"), F.lit(float(w)).alias("w"))
        ordered = F.array_sort(F.array(*[_outcome(r, xs, value(w)) for r, w in zip(self.rules, self.weights, strict=True)]))
        half = F.lit(0.5 * sum(self.weights) * (1 - 1e-12))
        start = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("p"))
        step = lambda a, x: F.struct((a["w"] + x["w"]).alias("w"), F.coalesce(a["p"], F.when(a["w"] + x["w"] >= half, x["p"])).alias("p"))
        return df.select(*kept, F.aggregate(ordered, start, step, lambda a: a["p"]).alias("prediction"))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([("adaboost", json.dumps(asdict(self)))], "kind string, model string").coalesce(1).write.mode("overwrite").json(f"{path}/model")

    @staticmethod
    def from_json(text: str) -> "AdaBoostModel":
        return AdaBoostModel(**json.loads(text))


def fit_adaboost(train: DataFrame, features: list[str], label: str, *, task: str, seed: int, rounds: int | None = None,
                 learning_rate: float = 1.0, max_depth: int | None = None) -> AdaBoostModel:
    rounds = ROUNDS if rounds is None else rounds
    model = AdaBoostModel(task=task, features=features)
    va = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    base = train.select(*[F.col(q(c)).cast("double").alias(c) for c in features], F.col(q(label)).alias("_y")).where(F.col("_y").isNotNull())
    if task == "classification":
        model.classes = sorted(r_[0] for r_ in base.select(F.col("_y").cast("string")).distinct().collect())
        mp = F.create_map(*[x for i, c in enumerate(model.classes) for x in (F.lit(c), F.lit(float(i)))])
        base = base.withColumn("label", mp[F.col("_y").cast("string")])
    else:
        base = base.withColumn("label", F.col("_y").cast("double"))
    n = base.count()
    data = cut_lineage(va.transform(base).select("features", "label", F.lit(1.0 / n).alias("w")))
    k = len(model.classes)
    for m in range(rounds):
        if task == "classification":
            est = DecisionTreeClassifier(featuresCol="features", labelCol="label", weightCol="w", maxDepth=1 if max_depth is None else max_depth, seed=seed)
        else:
            est = DecisionTreeRegressor(featuresCol="features", labelCol="label", weightCol="w", maxDepth=3 if max_depth is None else max_depth, seed=seed)
        tree = est.fit(data)
        scored = tree.transform(data).select("features", "label", "w", F.col("prediction").alias("_p"))
        if task == "classification":
            miss = (F.col("_p") != F.col("label")).cast("double")
            sums = scored.agg(F.sum(F.col("w") * miss).alias("wm"), F.sum("w").alias("ws")).first()
            err = sums["wm"] / sums["ws"]
            if err <= 0:
                model.rules.append(tree_rule(tree._java_obj.rootNode()))
                model.weights.append(1.0)
                break
            if err >= 1.0 - 1.0 / k:
                if not model.rules:
                    raise ValueError("BaseClassifier in AdaBoostClassifier ensemble is worse than random")
                break
            alpha = learning_rate * (math.log((1 - err) / err) + math.log(k - 1))
            model.rules.append(tree_rule(tree._java_obj.rootNode()))
            model.weights.append(alpha)
            new_w = F.col("w") * F.exp(F.lit(alpha) * miss)
            total = (sums["ws"] - sums["wm"]) + math.exp(alpha) * sums["wm"]  # Σ new weights, from the same pass
        else:
            e = F.abs(F.col("_p") - F.col("label"))
            mx = scored.agg(F.max(e)).first()[0]
            loss = e / F.lit(mx) if mx and mx > 0 else F.lit(0.0)
            avg = scored.agg((F.sum(F.col("w") * loss) / F.sum("w")).alias("a")).first()["a"]
            if avg <= 0:
                model.rules.append(tree_rule(tree._java_obj.rootNode()))
                model.weights.append(1.0)
                break
            if avg >= 0.5:
                if not model.rules:
                    model.rules.append(tree_rule(tree._java_obj.rootNode()))
                    model.weights.append(1.0)
                break
            beta = avg / (1 - avg)
            model.rules.append(tree_rule(tree._java_obj.rootNode()))
            model.weights.append(learning_rate * math.log(1 / beta))
            new_w = F.col("w") * F.pow(F.lit(beta), (1 - loss) * learning_rate)
            total = scored.agg(F.sum(new_w)).first()[0]
        prev = data
        data = scored.select("features", "label", (new_w / F.lit(total)).alias("w"))
        if (m + 1) % CHECKPOINT_EVERY == 0:
            data = cut_lineage(data)
        else:
            data = data.cache()
            data.count()  # filled from the previous round's rows before those are released
        prev.unpersist()
    return model
