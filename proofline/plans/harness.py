"""Evaluation runs: stages that read metrics from JSON artifacts and pass or fail by gates."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.operators.metrics import GATES, gates


@dataclass(frozen=True)
class Stage:
    """A stage: where its artifact is, (id, dotted path, direction) of its metrics and (metric, operator, value) of its gates."""

    id: str
    artifact: str
    metrics: tuple[tuple[str, str, str], ...]
    gates: tuple[tuple[str, str, float], ...] = field(default=())


def load_config(path: str) -> list[Stage]:
    """The stages of a configuration file; ValueError if ids repeat, or a gate names an unknown metric or operator."""
    with open(path, encoding="utf-8") as file:
        payload = json.load(file)
    stages = []
    for s in payload["stages"]:
        found = Stage(
            s["id"], s["source"]["path"], tuple((m["id"], m["path"], m.get("direction", "neutral")) for m in s["metrics"]),
            tuple((g["metric"], g["operator"], float(g["value"])) for g in s.get("gates", [])),
        )
        names = [m for m, _, _ in found.metrics]
        if len(set(names)) != len(names) or any(m not in names or op not in GATES for m, op, _ in found.gates):
            raise ValueError(f"stage {found.id}")
        stages.append(found)
    if not stages or len({s.id for s in stages}) != len(stages):
        raise ValueError("stages")
    return stages


def json_path(dotted: str) -> str:
    """``a.0.b`` as a path into JSON."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in dotted.split("."))


def stage_metrics(spark: SparkSession, stage: Stage) -> DataFrame:
    """(stage_id, metric_id, value, direction) of a stage's artifact; null where the path leads nowhere."""
    whole = spark.read.text(stage.artifact, wholetext=True)
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric_id"), F.get_json_object("value", json_path(p)).cast("double").alias("value"), F.lit(d).alias("direction"))
        for m, p, d in stage.metrics
    ])
    return whole.select(F.lit(stage.id).alias("stage_id"), F.inline(rows))


def run(spark: SparkSession, stages: list[Stage]) -> tuple[DataFrame, DataFrame]:
    """(metrics, gates with stage_id and passed) of all stages."""
    measured = judged = None
    for stage in stages:
        mine = stage_metrics(spark, stage)
        measured = mine if measured is None else measured.unionByName(mine)
        limits = spark.createDataFrame([*stage.gates], "metric string, operator string, value double")
        mine = gates(mine.select(F.col("metric_id").alias("metric"), F.col("value").alias("actual")), limits).withColumn("stage_id", F.lit(stage.id))
        judged = mine if judged is None else judged.unionByName(mine)
    return measured, judged


def status(metrics: DataFrame, judged: DataFrame) -> str:
    """ERROR if a metric is missing, else FAIL if a gate is, else PASS."""
    if metrics.where("value is null").limit(1).count():
        return "ERROR"
    return "FAIL" if judged.where("not passed").limit(1).count() else "PASS"


def report(metrics: DataFrame, judged: DataFrame) -> str:
    """A Markdown report; runs are small, a row for each metric and gate."""
    lines = [f"# {status(metrics, judged)}", "", "| stage | metric | value |", "| --- | --- | --- |"]
    lines += [f"| {r['stage_id']} | {r['metric_id']} | {r['value']} |" for r in metrics.orderBy("stage_id", "metric_id").collect()]
    lines += ["", "| stage | gate | passed |", "| --- | --- | --- |"]
    lines += [f"| {r['stage_id']} | {r['metric']} {r['operator']} {r['value']} | {r['passed']} |" for r in judged.orderBy("stage_id", "metric").collect()]
    return "\n".join(lines)
