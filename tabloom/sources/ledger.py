"""Append-only run ledger (S18): decisions, experiments, artifacts, phases.

Each record kind is a table under ``<root>/ledger/<kind>`` written with
``mode("append")`` and keyed by ``run_id``; reading a run back is a filter.
A phase is recorded once per run (duplicates are dropped on read).
"""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import _fs

KINDS = {
    "decisions": "run_id string, at timestamp, phase string, decision string, detail string",
    "experiments": "run_id string, at timestamp, experiment_id string, model_name string, metrics string, training_time double, is_best boolean",
    "artifacts": "run_id string, at timestamp, artifact_type string, path string, description string",
    "phases": "run_id string, at timestamp, phase string",
}


class Ledger:
    def __init__(self, spark: SparkSession, root: str, run_id: str):
        self.spark, self.root, self.run_id = spark, root, run_id

    def _now(self):
        return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)

    def _append(self, kind: str, row: tuple) -> None:
        self.spark.createDataFrame([(self.run_id, self._now(), *row)], KINDS[kind]).write.mode("append").parquet(f"{self.root}/ledger/{kind}")

    def add_decision(self, phase: str, decision: str, detail: dict | str = "") -> None:
        self._append("decisions", (phase, decision, detail if isinstance(detail, str) else json.dumps(detail, default=str)))

    def add_experiment(self, experiment_id: str, model_name: str, metrics: dict, training_time: float, is_best: bool = False) -> None:
        self._append("experiments", (experiment_id, model_name, json.dumps(metrics, default=str), float(training_time), bool(is_best)))

    def add_artifact(self, artifact_type: str, path: str, description: str = "") -> None:
        self._append("artifacts", (artifact_type, path, description))

    def mark_phase_complete(self, phase: str) -> None:
        if phase not in self.completed_phases():
            self._append("phases", (phase,))

    def read(self, kind: str) -> DataFrame:
        fs, path = _fs(self.spark, f"{self.root}/ledger/{kind}")
        if not fs.exists(path):  # nothing written yet; any other failure is an error
            return self.spark.createDataFrame([], KINDS[kind])
        df = self.spark.read.schema(KINDS[kind]).parquet(f"{self.root}/ledger/{kind}")
        df = df.where(F.col("run_id") == self.run_id)
        return df.dropDuplicates(["run_id", "phase"]) if kind == "phases" else df

    def completed_phases(self) -> list[str]:
        return [r["phase"] for r in self.read("phases").orderBy("at").collect()]

    def best_experiment(self) -> DataFrame:
        return self.read("experiments").where("is_best").orderBy(F.col("at").desc()).limit(1)

    def artifacts_by_type(self, artifact_type: str) -> DataFrame:
        return self.read("artifacts").where(F.col("artifact_type") == artifact_type)
