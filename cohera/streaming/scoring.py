"""Streaming use of the same operators.

Sentence splitting, shuffles and lexical scoring are row-wise, so they run
unchanged on a streaming DataFrame of records (the permutation table is a
static broadcast side). Two sinks are offered:

* ``item_scores_stream``: per-item ``pair_score`` rows, append mode (no
  state): each micro-batch is scored and written.
* ``report_stream``: the global ranking report, maintained by Spark's
  streaming aggregation in complete mode (state is one partial row).

Checkpoints go under the session's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import item_pair_score, ranking_report
from ..plans.evaluation import K_MAX, SEED, lexical_items
from ..session import ensure_checkpoint_dir
from ..sources.records import filter_nonempty


def _checkpoint(df: DataFrame, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(df.sparkSession), "streams", name)


def stream_items(records: DataFrame, k_max: int = K_MAX, seed: int = SEED) -> DataFrame:
    """Per-item ranking values of a stream of records."""
    return lexical_items(records, k_max, seed)


def item_scores_stream(records: DataFrame, path: str, fmt: str = "parquet", name: str = "item_scores",
                       k_max: int = K_MAX, seed: int = SEED, trigger_once: bool = False):
    """Start a query writing ``(record_id, pair_score)`` rows as they arrive."""
    out = item_pair_score(stream_items(records, k_max, seed))
    w = (out.writeStream.format(fmt).outputMode("append").option("path", path)
         .option("checkpointLocation", _checkpoint(records, name)))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


def report_stream(records: DataFrame, name: str = "ranking_report", k_max: int = K_MAX, seed: int = SEED,
                  sink: str = "memory", trigger_once: bool = False):
    """Start a query keeping the running ranking report (complete mode)."""
    rep = ranking_report(stream_items(records, k_max, seed))
    w = (rep.writeStream.format(sink).outputMode("complete").queryName(name)
         .option("checkpointLocation", _checkpoint(records, name)))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


def read_record_stream(spark, directory: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Stream of records from parquet files shaped like ``documents``."""
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
    raw = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(directory))
    return filter_nonempty(raw, "text").select(
        F.col("doc_id").alias("record_id"), F.col("text").alias("summary"), "source")
