"""Sinks: metrics JSON, scored items, fold results and CV summaries."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import metric_name


def write_metrics(report: DataFrame, path: str) -> None:
    """One-row metric report as JSON (a single small file), keyed by the reported names (``recall@3``)."""
    named = report.select([F.col(c).alias(metric_name(c)) for c in report.columns])
    named.coalesce(1).write.mode("overwrite").json(path)


def write_scored_items(scored: DataFrame, path: str, fmt: str = "csv", record_id: str = "record_id") -> DataFrame:
    """Input rows with their ``pair_score`` (-1.0 when unscored); the id is dropped."""
    out = scored.withColumn("pair_score", F.coalesce(F.col("pair_score"), F.lit(-1.0))).drop(record_id)
    writer = out.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)
    return out


def run_group_name(trainer_type: str, model_name: str, cv: int) -> str:
    """``<TYPE>_CV`` or ``<TYPE>_Train``, the model base name, 8 hex digits."""
    prefix = f"{trainer_type.upper()}_CV" if cv > 1 else f"{trainer_type.upper()}_Train"
    return f"{prefix}_{os.path.basename(model_name)}_{uuid.uuid4().hex[:8]}"


def commit_run(rows: DataFrame, path: str, run_group: str) -> None:
    """Write a run's rows so that readers see them once, or not at all.

    Every attempt writes to a folder of its own under ``path/rows``; one line
    under ``path/commits`` then names the attempt. A failure before that line
    leaves nothing that ``read_runs`` would show, and a repeated write
    replaces the run as a whole.
    """
    attempt = uuid.uuid4().hex
    (rows.withColumn("run_group", F.lit(run_group)).withColumn("attempt", F.lit(attempt))
     .write.mode("append").partitionBy("run_group", "attempt").parquet(f"{path}/rows"))
    line = rows.sparkSession.range(1).select(F.lit(run_group).alias("run_group"), F.lit(attempt).alias("attempt"),
                                             F.current_timestamp().alias("committed_at"))
    line.coalesce(1).write.mode("append").parquet(f"{path}/commits")


def read_runs(spark: SparkSession, path: str, run_group: str | None = None) -> DataFrame:
    """The rows of committed runs: of each run its last committed attempt. Fails where nothing was committed."""
    commits = spark.read.parquet(f"{path}/commits")
    rows = spark.read.parquet(f"{path}/rows")
    if run_group is not None:
        commits, rows = (x.where(F.col("run_group") == run_group) for x in (commits, rows))
    last = commits.groupBy("run_group").agg(F.max(F.struct("committed_at", "attempt"))["attempt"].alias("attempt"))
    return rows.join(last, ["run_group", "attempt"]).drop("attempt")


def write_fold_results(fold_results: DataFrame, path: str, run_group: str, config: dict) -> None:
    """Commit ``(run_group, job_type, fold, metric, value, status, config)`` (see ``commit_run``)."""
    commit_run(fold_results.withColumn("job_type", F.lit("train_fold"))
               .withColumn("config", F.lit(json.dumps(config, sort_keys=True, default=str))), path, run_group)


def write_cv_summary(summary: DataFrame, path: str, run_group: str, config: dict) -> None:
    """Commit the summary rows; the config drops ``fold`` and ``output_dir_fold``."""
    cfg = {k: v for k, v in config.items() if k not in ("fold", "output_dir_fold")}
    commit_run(summary.withColumn("job_type", F.lit("cv_summary"))
               .withColumn("config", F.lit(json.dumps(cfg, sort_keys=True, default=str))), path, run_group)
