"""A store of one model per security: the models of a run are written beside the others, then
one manifest row per security names the run. A reader follows the manifest alone, so it
sees a run whole or not at all, and a security whose new model was not saved keeps its last one."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def save_models(fitted: DataFrame, verdict: DataFrame, path: str, key: str) -> str:
    """Store the models of the securities whose ``verdict`` (key, status, and what led to it) is saved."""
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    saved = verdict.where("status = 'saved'").select(key)
    fitted.join(saved, key, "left_semi").write.parquet(f"{path}/models/{run}")
    verdict.withColumn("run_id", F.lit(run)).write.mode("append").parquet(f"{path}/manifest")
    return run


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def load_models(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest saved model of every security, with the ``run_id`` it is from."""
    newest = load_manifest(spark, path).where("status = 'saved'").groupBy(key).agg(F.max("run_id").alias("run_id"))
    runs = [row.run_id for row in newest.select("run_id").distinct().collect()]  # one per call of save_models
    if not runs:
        raise ValueError(f"no model is saved in {path}")
    parts = [spark.read.parquet(f"{path}/models/{run}").withColumn("run_id", F.lit(run)) for run in runs]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.join(newest, [key, "run_id"], "left_semi")
