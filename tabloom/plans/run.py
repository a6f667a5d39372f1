"""End-to-end run (X1): profile → quality → exploratory statistics → clean →
split → leakage → features → encode → train and rank → evaluate → write.

Each stage is a DataFrame job of the operators package; between stages the
working tables are checkpointed to the shared checkpoint folder, so a lost
executor recomputes from the last stage only.  Validation rows rank the
models; test rows are used only for the final evaluation (or for ranking
when there are no validation rows).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.kinds import q
from ..operators import clean as C
from ..operators import eda as E
from ..operators import encode as R
from ..operators import features as FE
from ..operators import leakage as G
from ..operators import metrics as V
from ..operators import models as M
from ..operators import profile as PR
from ..operators import quality as Q
from ..operators import split as S
from ..operators.scan import materialize_small
from ..session import cut_lineage
from ..sources import sinks
from ..sources.hashing import file_hashes, row_text
from ..sources.ledger import Ledger

DEFAULT_MODELS = {M.REGRESSION: M.REGRESSORS, M.CLASSIFICATION: M.CLASSIFIERS, M.CLUSTERING: M.CLUSTERERS}


@dataclass
class RunResult:
    profile: DataFrame
    quality: Q.QualityReport
    clean_model: C.CleanModel | None
    leakage: DataFrame | None
    feature_plan: FE.FeaturePlan | None
    encoder: R.EncoderModel | None
    leaderboard: DataFrame
    evaluation: DataFrame | None
    decision: DataFrame | None
    artifacts: dict = field(default_factory=dict)


def autorun(spark: SparkSession, df: DataFrame, *, target: str | None, task: str, time_column: str | None = None,
            models: list[str] | None = None, seed: int = P.RANDOM_SEED, test_size: float = P.TEST_SIZE,
            val_size: float = P.VAL_SIZE, top_k: int = P.TOP_MODELS, out_root: str | None = None,
            run_id: str | None = None, approx: bool = False, params: dict[str, dict] | None = None,
            source_path: str | None = None) -> RunResult:
    """Run all stages; with ``out_root`` write every stage's outputs under ``<out_root>/<run_id>``.

    ``params`` maps model names to parameters; ``source_path`` names the raw
    input, which is then copied and hashed.
    """
    if task in ("anomaly", "forecasting"):
        raise ValueError(f"task '{task}' has no algorithm in this library")
    run_id = run_id or uuid.uuid4().hex[:12]
    out = _Outputs(spark, out_root, run_id)
    if out and source_path:
        out.raw(source_path)
    goal = target if task != M.CLUSTERING else None
    profile = materialize_small(PR.profile_columns(df, approx=approx))
    out.reports("profile", profile=profile)
    quality = Q.audit(df, goal, approx=approx)
    out.reports("quality", issues=quality.issues, score=quality.score)
    if out:
        explored = {"summary": E.eda_summary(df), "histogram": E.histogram(df), "categories": E.category_frequencies(df),
                    "correlations": E.correlations(df), "collinear": E.collinear_pairs(df), "skew": E.skew_insights(df)}
        if goal:
            explored["target_correlations"] = E.target_correlations(df, goal)
        out.reports("eda", **explored)
    if task == "descriptive":
        return RunResult(profile, quality, None, None, None, None, spark.createDataFrame([], "model_name string"), None, None, out.paths)

    cm = C.fit_clean(df, goal, approx=approx)
    # the time column survives cleaning beside its parts; the key is a hash of the row's content, the same in every run
    source = df.withColumn("_time", F.col(q(time_column))) if time_column else df
    cleaned = cm.transform(source)
    cleaned = cut_lineage(cleaned.withColumn("_row_id", F.xxhash64(row_text(cleaned, cleaned.columns))))
    key = ["_row_id"]
    models = models or DEFAULT_MODELS[task]
    params = params or {}
    if out:
        sinks.write_table(cleaned.drop("_row_id", "_time"), f"{out.paths['clean']}/table")
        out.reports("clean", log=cm.log(spark))

    if task == M.CLUSTERING:
        enc = R.fit_encoder(cleaned.drop("_row_id"))
        encoded = cut_lineage(enc.transform(cleaned, keep=key))
        feats = enc.feature_names
        results = {m: M.train_and_evaluate(m, task, encoded, encoded, feats, None, key=key, seed=seed, params=params.get(m)) for m in models}
        board = _rank([M.leaderboard_row(r, task) for r in results.values()], task, top_k)
        out.models(results, board, enc, encoded)
        return RunResult(profile, quality, cm, None, None, enc, board, None, None, out.paths)

    if time_column:
        parts = S.temporal_split(cleaned, target, "_time", test_size=test_size, val_size=val_size, tiebreak=key)
    else:
        parts = S.random_split(cleaned, target, keys=key, test_size=test_size, val_size=val_size,
                               stratify=task == M.CLASSIFICATION, seed=seed)
    parts = cut_lineage(parts.drop("_time"))
    cleaned = cleaned.drop("_time")
    feats_in = [c for c in cleaned.columns if c not in (target, "_row_id")]
    train = parts.where(F.col("split") == "train")
    test = parts.where(F.col("split") == "test")
    leak = G.audit_leakage(train.select(*[q(c) for c in feats_in]), test.select(*[q(c) for c in feats_in]),
                           train.select(*[q(c) for c in feats_in], q(target)), target)

    plan = FE.fit_features(train.select(*[q(c) for c in feats_in]))
    widened = plan.transform(parts)
    x_cols = [c for c in widened.columns if c not in (target, "split", "_row_id")]
    enc = R.fit_encoder(widened.where(F.col("split") == "train").select(*[q(c) for c in x_cols]))
    encoded = cut_lineage(enc.transform(widened, keep=[*key, target, "split"]))
    feats = enc.feature_names

    tr = encoded.where(F.col("split") == "train")
    va = encoded.where(F.col("split") == "val")
    te = encoded.where(F.col("split") == "test")
    rank_on = va if va.limit(1).count() > 0 else te
    results = {m: M.train_and_evaluate(m, task, tr, rank_on, feats, target, key=key, seed=seed, params=params.get(m)) for m in models}
    board = _rank([M.leaderboard_row(r, task) for r in results.values()], task, top_k)
    best = board.where(F.col("rank") == 1).first()["model_name"]
    final = M.evaluate(results[best], task, te)
    if task == M.REGRESSION:
        evaluation = V.holdout_regression(final.predictions)
    else:
        evaluation = final.metrics
    decision = V.stop_rule(evaluation, task)
    if out:
        sinks.write_splits(parts, target, out.paths["splits"])
        sinks.write_table(widened.drop("_row_id"), f"{out.paths['features']}/table", formats=("parquet",))
        out.reports("features", plan=plan.log(spark))
        out.models(results, board, enc, encoded)
        out.reports("reports", leakage=leak, leakage_summary=G.leakage_summary(leak, len(feats_in)))
        out.reports("evaluation", evaluation=evaluation, decision=decision)
    return RunResult(profile, quality, cm, leak, plan, enc, board, evaluation, decision, out.paths)


class _Outputs:
    """Writers of one run and its ledger; false and silent without a folder."""

    def __init__(self, spark: SparkSession, root: str | None, run_id: str):
        self.spark, self.root = spark, root
        self.paths = sinks.init_run(spark, root, run_id) if root else {}
        self.ledger = Ledger(spark, root, run_id) if root else None

    def __bool__(self) -> bool:
        return self.ledger is not None

    def raw(self, path: str) -> None:
        copied = sinks.copy_raw(self.spark, path, self.paths["raw"])
        self.ledger.add_artifact("raw", copied, "copy of the input")
        self.reports("raw", hashes=file_hashes(self.spark, path))

    def reports(self, stage: str, **tables: DataFrame) -> None:
        if not self:
            return
        for name, rows in tables.items():
            sinks.write_report(self.spark, name, rows, self.paths[stage])
            self.ledger.add_artifact("report", f"{self.paths[stage]}/{name}", stage)
        self.ledger.mark_phase_complete(stage)

    def models(self, results: dict, board: DataFrame, encoder, encoded: DataFrame) -> None:
        if not self:
            return
        where = self.paths["models"]
        sinks.write_table(encoded.drop("_row_id"), f"{where}/ml_ready", formats=("parquet",))
        encoder.save(f"{where}/encoder")
        sinks.write_experiments(board, f"{where}/experiments")
        for name, path in M.save_top_models(results, board, where).items():
            self.ledger.add_artifact("model", path, name)
        for row in board.collect():  # one row per model
            values = {k: v for k, v in row.asDict().items() if isinstance(v, float)}
            self.ledger.add_experiment(row["model_name"], row["model_name"], values, row["training_time"], row["rank"] == 1)
        self.ledger.mark_phase_complete("models")


def _rank(rows: list[DataFrame], task: str, top_k: int) -> DataFrame:
    out = None
    for r_ in rows:
        r_ = materialize_small(r_)
        out = r_ if out is None else out.unionByName(r_, allowMissingColumns=True)
    return materialize_small(V.rank_models(out, task, top_k))
