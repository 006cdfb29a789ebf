"""Spark session and cluster-facing helpers.

Nothing here sets a machine-local folder on a cluster: the checkpoint
directory is read from ``spark.checkpoint.dir`` and only filled in when the
session leaves it unset (local tests and the bench).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows that ``with_batches`` works on together
BATCH_ROWS = 1000


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "cohera") -> SparkSession:
    """A session tuned for the operators in this package.

    AQE stays on so that shuffle partitions are coalesced at run time and
    skewed aggregations are split; the UI stays off (no server, no port).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            builder = builder.config("spark.driver.memory", os.environ.get("COHERA_DRIVER_MEMORY", "12g"))
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is
    used as is; unset there, this raises. Only in local mode (tests, bench)
    is a scratch folder made when it is unset.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            # a machine-local folder would not survive a lost executor
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        conf_dir = tempfile.mkdtemp(prefix="cohera-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def spread(df: DataFrame, key: str, partitions: int | None) -> DataFrame:
    """Hash-partition by ``key`` into ``partitions``; None leaves the layout as it is.

    Per-text work (sentence splitting, shuffles, scoring) is CPU heavy and
    row-local: a text costs milliseconds of CPU but microseconds to move. A
    caller whose input comes in fewer useful splits than the cluster has
    cores (a file with one row group is one busy task) names a number here,
    about three per core; others leave it out and nothing is shuffled.
    Hashing on the record key keeps placement deterministic under retries.
    """
    return df if partitions is None else df.repartition(partitions, key)


def fenced_where(df: DataFrame, condition) -> DataFrame:
    """Filter rows on derived columns without duplicating their expressions.

    The optimizer pushes a filter below projections by inlining the aliased
    expressions into the condition; on a heavy derived column (scores of
    every shuffle of a text) that computes the expression twice. A
    non-deterministic column (the task's partition id) that the condition
    references keeps the filter above the projection that makes the column.
    """
    fence = "_fence"
    return (df.withColumn(fence, F.spark_partition_id())
            .where(condition & (F.col(fence) >= 0))
            .drop(fence))


def with_batches(df: DataFrame, column, kind, compute, inputs, drop=()) -> DataFrame:
    """Add ``column``, which ``compute`` makes of the ``inputs`` of an Arrow batch; no row moves.

    ``compute`` takes and returns Arrow arrays; with several names in
    ``column``, and as many in ``kind``, it returns a list of them. Columns
    named in ``drop`` end here. Plans treat the step as a whole: nothing is
    computed twice or pushed through it, so columns not read later cost less
    if they end here.
    """
    import pyarrow as pa

    several = not isinstance(column, str)
    added = dict(zip(column, kind)) if several else {column: kind}
    kept = [c for c in df.columns if c not in drop]

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(a, BATCH_ROWS)
                made = compute(*[part.column(part.schema.get_field_index(c)) for c in inputs])
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept),
                                                  *(made if several else [made])], [*kept, *added])

    # the types only: which of the kept columns may be null stays as it was
    schema = df.select(*kept, *(F.lit(None).cast(k).alias(c) for c, k in added.items())).schema
    return df.mapInArrow(run, schema)
