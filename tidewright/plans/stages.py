"""Stages with resume: an ordered list of functions DataFrame -> DataFrame, a table for each output, a state log.

A stage's output is a table of commits (`sources.commits`): readers see the last whole one, also while a stage runs again. The state log is
appended once the output is committed. A run begins after the last stage that is complete under the same configuration
hash, and refuses to go on under another one. A stage without a function is pending, and the run ends before it.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.sources.commits import CommitLog

STATE = "stage string, status string, config_hash string, time_unix double, detail string"


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


class StageRunner:
    def __init__(self, spark: SparkSession, folder: str, config: dict, stages: Sequence[tuple[str, Callable[[SparkSession, dict[str, DataFrame], dict], DataFrame] | None]]):
        self.spark, self.folder, self.config, self.stages = spark, folder.rstrip("/"), config, list(stages)
        self.hash = config_hash(config)

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def log(self) -> DataFrame:
        """All state rows, in the order of their times."""
        path = f"{self.folder}/_state"
        return self.spark.read.schema(STATE).json(path) if self._exists(path) else self.spark.createDataFrame([], STATE)

    def note(self, stage: str, status: str, detail: str = "") -> None:
        row = [(stage, status, self.hash, time.time(), detail)]
        self.spark.createDataFrame(row, STATE).coalesce(1).write.mode("append").json(f"{self.folder}/_state")

    def status(self) -> dict[str, str]:
        """The last status of each stage."""
        rows = self.log().groupBy("stage").agg(F.max_by("status", "time_unix").alias("status")).collect()  # a row a stage
        return {r["stage"]: r["status"] for r in rows}

    def output(self, stage: str) -> DataFrame:
        found = CommitLog(self.spark, f"{self.folder}/{stage}").read()
        if found is None:
            raise ValueError(f"no output of stage: {stage}")
        return found

    def run(self, resume: bool = True, from_stage: str | None = None, to_stage: str | None = None) -> list[str]:
        """Runs what isn't complete; the names of the stages that ran."""
        names = [n for n, _ in self.stages]
        for name in (from_stage, to_stage):
            if name is not None and name not in names:
                raise ValueError(f"unknown stage: {name}")
        if from_stage and to_stage and names.index(from_stage) > names.index(to_stage):
            raise ValueError("from_stage must not come after to_stage")
        known = {r["config_hash"] for r in self.log().select("config_hash").distinct().limit(2).collect()}
        if resume and known - {self.hash}:
            raise ValueError("the run folder belongs to another configuration")
        done = {k for k, v in self.status().items() if v == "complete"} if resume else set()
        first = names.index(from_stage) if from_stage else 0
        last = names.index(to_stage) if to_stage else len(names) - 1
        ran = []
        for i, (name, stage) in enumerate(self.stages[: last + 1]):
            if i < first or (name in done and not (from_stage and i >= first)):
                continue
            if stage is None:
                self.note(name, "pending", "no function")
                break
            self.note(name, "running")
            try:
                before = {n: self.output(n) for n in names[:i]}
                CommitLog(self.spark, f"{self.folder}/{name}").overwrite(stage(self.spark, before, self.config))
            except Exception as error:
                self.note(name, "failed", str(error)[:500])
                raise
            self.note(name, "complete")
            ran.append(name)
        return ran


def append_once(rows: DataFrame, path: str, key: str) -> int:
    """Appends rows whose key the table at `path` lacks, so that a repeated batch adds nothing, also with other writers at work."""
    return CommitLog(rows.sparkSession, path).append_once(rows, key)
