"""Readers for text records.

* JSONL summaries: ``text_raw``, ``summary``, ``metadata.source``; a line is
  kept only when ``summary`` is present, not null and not ``""``; kept lines
  must carry ``text_raw`` and ``metadata`` (with an explicit schema a missing
  key and a null look alike, both fail).
* An evaluation CSV with a ``text`` column.
* Any table as records (the driver's ``documents`` stands in for JSONL).

Every reader adds ``record_id BIGINT``: rows have no list position in Spark
and every later step keys on the id, never on the text (copies exist). The
id is a hash of the file's name and the row's content, with a counter for
equal rows, so it does not depend on split sizes, cores or retries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .csv_blocks import read_csv

RECORD_SCHEMA = "text_raw STRING, summary STRING, metadata STRUCT<source: STRING>"


def filter_nonempty(df: DataFrame, column: str = "summary") -> DataFrame:
    """Keep rows whose text exists, is not null and is not empty.

    Whitespace-only text is kept; it simply has no sentences.
    """
    return df.where(F.col(column).isNotNull() & (F.col(column) != ""))


def flatten_record(df: DataFrame) -> DataFrame:
    """Project a raw JSONL row and lift ``metadata.source``."""
    return df.select("*", F.col("metadata.source").alias("source"))


def require_fields(df: DataFrame, fields=("text_raw", "metadata")) -> DataFrame:
    """Fail the job when a kept row lacks a required field."""
    bad = None
    for f in fields:
        cond = F.col(f).isNull()
        bad = cond if bad is None else (bad | cond)
    check = F.when(bad, F.raise_error(F.lit("record without required field: " + ", ".join(fields))))
    # raise_error yields null, never true: the filter keeps every good row.
    return df.where(F.coalesce(check.cast("boolean"), F.lit(True)))


def group_key(df: DataFrame, key: str):
    """Column chosen by name; an unknown name raises at once."""
    if key not in df.columns:
        raise KeyError(f"unknown split key {key!r}; columns are {df.columns}")
    return F.col(key)


FILE = "_file_name"


#: surplus copies whose numbers are sent to the tasks (24 bytes each)
MAX_BROADCAST_ROWS = 2_000_000


def with_record_id(df: DataFrame) -> DataFrame:
    """Stable id per row: ``xxhash64(file, content, k)``, ``k`` numbering equal rows.

    Equal rows of one file are interchangeable, so which of them gets which
    ``k`` changes nothing. One pass over the hashes runs at once and counts
    the surplus copies. Without any, an id is a function of its row. Else the
    copies' positions (hash and position, no contents) are numbered within
    each task and then offset by task, so a line that fills a third of a file
    is not gathered in one place; the rows look their number up. Contents
    move only beyond ``MAX_BROADCAST_ROWS`` surplus copies. ``FILE`` (the
    file's name), where present, is dropped.
    """
    content = [c for c in df.columns]
    x = df.withColumn("_h", F.xxhash64(*content))
    surplus = x.groupBy("_h").count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).first()["n"]
    if not surplus:
        return x.withColumn("record_id", F.col("_h")).drop("_h", FILE)
    x = x.withColumn("_pos", F.monotonically_increasing_id())
    # both sides of the join below read this one exchange
    dealt = x.select("_h", "_pos", F.shiftright("_pos", 33).alias("_task")).repartition("_h", "_task")
    by_hash = Window.partitionBy("_h")
    before = by_hash.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy("_h", "_task").agg(F.count(F.lit(1)).alias("_n"))
               .select("_h", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                       F.sum("_n").over(by_hash).alias("_all")).where("_all > 1"))
    local = F.row_number().over(Window.partitionBy("_h", "_task").orderBy("_pos"))
    numbers = (dealt.withColumn("_k", local).join(offsets, ["_h", "_task"])
               .select("_h", "_pos", (F.col("_k") + F.col("_off")).cast("bigint").alias("_k")).where("_k > 1"))
    x = x.join(F.broadcast(numbers) if surplus <= MAX_BROADCAST_ROWS else numbers, ["_h", "_pos"], "left")
    record_id = F.when(F.col("_k").isNull(), F.col("_h")).otherwise(F.xxhash64("_h", "_k"))
    return x.withColumn("record_id", record_id).drop("_h", "_pos", "_k", FILE)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSONL records -> ``(record_id, text_raw, summary, source)``.

    Broken JSON fails the job (``FAILFAST``); a missing path fails at once.
    The non-empty filter reaches the JSON scan and unused fields are pruned.
    """
    raw = spark.read.schema(RECORD_SCHEMA).option("mode", "FAILFAST").json(path)
    kept = require_fields(filter_nonempty(raw.withColumn(FILE, F.col("_metadata.file_name"))))
    return with_record_id(flatten_record(kept).drop("metadata")).select("record_id", "text_raw", "summary", "source")


def records_from_table(df: DataFrame, record_id: str = "doc_id", summary: str = "text",
                       source: str | None = "source") -> DataFrame:
    """Any table as records: ``(record_id, summary, source)``."""
    src = F.col(source) if source else F.lit(None).cast("string")
    return filter_nonempty(
        df.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(summary).alias("summary"),
                  src.alias("source")))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's ``documents`` table as records."""
    return records_from_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def read_eval_csv(spark: SparkSession, path: str, text: str = "text", multi_line: bool = True) -> DataFrame:
    """Evaluation CSV (header row) with a text column.

    All columns are kept as strings and carried to the scored output; a
    ``record_id`` is added. A missing file or column raises.

    ``multi_line`` allows line breaks inside quoted fields; files are split
    all the same (see ``csv_blocks``). Without it a line is a record, which
    saves the pass over the quotes.
    """
    if multi_line:
        df = read_csv(spark, path, FILE)
    else:
        df = (spark.read.option("header", True).option("escape", '"').option("mode", "FAILFAST").csv(path)
              .withColumn(FILE, F.col("_metadata.file_name")))
    if text not in df.columns:
        raise KeyError(f"evaluation table needs a {text!r} column; found {[c for c in df.columns if c != FILE]}")
    return with_record_id(df)


def require_nonempty(df: DataFrame, what: str = "records") -> DataFrame:
    """Stop when nothing was loaded (one cheap job: reads until one row)."""
    if df.isEmpty():
        raise ValueError(f"no data: no {what} loaded")
    return df
