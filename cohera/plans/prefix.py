"""Order statistics without a single-task global sort.

``Window.orderBy`` without ``partitionBy`` pulls every row into one task.
Two replacements:

* ``nth_smallest``: the exact m-th row of a uniform 60-bit key order.
  Rows are counted per key-prefix bucket (a partial aggregate, at most
  ``2**bits`` rows reach the driver), the bucket holding the m-th row is
  narrowed again, and only the last, small bucket is sorted. The result is
  a constant, so the split that uses it is a map-only filter.
* ``running_sums``: inclusive running sums over a distinct ordering key.
  Rows are range partitioned into buckets whose number grows with the rows
  and written once; the running sum is a window *within* each bucket plus
  the bucket's offset, from a running sum over one row per bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import KEY_BITS
from ..session import ensure_checkpoint_dir

BUCKET_BITS = 10
FINAL_ROWS = 200_000
BUCKET_ROWS = 50_000


def any_of(conditions: list[Column]) -> Column:
    """Disjunction as a balanced tree, so many terms do not nest deeply."""
    if not conditions:
        return F.lit(False)
    while len(conditions) > 1:
        conditions = [reduce(lambda a, b: a | b, conditions[i:i + 2]) for i in range(0, len(conditions), 2)]
    return conditions[0]


def nth_smallest_by_group(df: DataFrame, group: str, key: str, tie: str, m: dict, bits: int = BUCKET_BITS,
                          final_rows: int = FINAL_ROWS) -> dict:
    """For every group ``g`` the ``(key, tie)`` of its ``m[g]``-th smallest row.

    ``key`` must be uniform on ``[0, 2**60)`` (an md5-derived key), so each
    prefix bucket holds about ``n / 2**bits`` rows whatever the data; a hot
    group of equal records does not matter because ids differ. One pass per
    level serves all groups (at most ``groups * 2**bits`` counts reach the
    driver); the last, small buckets are ranked by a window partitioned by
    group. Groups with ``m[g] <= 0`` get None.
    """
    want = {g: v for g, v in m.items() if v > 0}
    out = {g: None for g in m}
    if not want:
        return out
    base = df.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(tie).alias("t"))
    base = base.where(F.col("g").isin(list(want)))
    remaining, prefix = dict(want), {}
    shift = KEY_BITS
    cond = F.lit(True)
    while True:
        shift = max(shift - bits, 0)
        counts: dict = {}
        for r in (base.where(cond).groupBy("g", F.shiftright("k", shift).alias("b"))
                  .agg(F.count(F.lit(1)).alias("c")).collect()):
            counts.setdefault(r["g"], []).append((r["b"], r["c"]))
        sizes = {}
        for g, need in remaining.items():
            seen = 0
            for b, c in sorted(counts.get(g, [])):
                if seen + c >= need:
                    prefix[g], sizes[g] = b, c
                    break
                seen += c
            else:
                raise ValueError(f"group {g}: only {seen} rows; cannot take row {need}")
            remaining[g] = need - seen
        cond = any_of([(F.col("g") == F.lit(g)) & (F.shiftright("k", shift) == F.lit(prefix[g])) for g in remaining])
        if max(sizes.values()) <= final_rows or shift == 0:
            break
    rn = F.row_number().over(Window.partitionBy("g").orderBy("k", "t"))
    picked = base.where(cond).withColumn("_rn", rn)
    hit = any_of([(F.col("g") == F.lit(g)) & (F.col("_rn") == F.lit(r)) for g, r in remaining.items()])
    for row in picked.where(hit).collect():
        out[row["g"]] = (int(row["k"]), int(row["t"]))
    return out


def nth_smallest(df: DataFrame, key: str, tie: str, m: int, bits: int = BUCKET_BITS,
                 final_rows: int = FINAL_ROWS) -> tuple[int, int] | None:
    """``(key, tie)`` of the m-th smallest row (1-based) in ``(key, tie)`` order."""
    one = df.select(F.lit(0).alias("_g"), F.col(key).alias(key), F.col(tie).alias(tie))
    return nth_smallest_by_group(one, "_g", key, tie, {0: m}, bits, final_rows)[0]


def running_sums(df: DataFrame, order: str, columns: list[str], n_buckets: int | None = None) -> DataFrame:
    """Add ``cum_<c>`` = sum of ``c`` over rows with ``order`` <= this row's.

    ``order`` must be distinct per row (aggregate first). The rows are range
    partitioned into buckets of about ``BUCKET_ROWS`` and written once with
    their bucket number, so a recomputed task cannot see other bounds. Bucket
    totals stay a table: their own running sum (one row per bucket) gives the
    offsets, which are joined back.
    """
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint(eager=True)
    b = n_buckets or max(1, -(-df.count() // BUCKET_ROWS))
    ranged = df.repartitionByRange(b, order).withColumn("_bucket", F.spark_partition_id()).checkpoint(eager=True)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    totals = ranged.groupBy("_bucket").agg(*[F.sum(c).alias(f"_sum_{c}") for c in columns])
    offsets = totals.select("_bucket", *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_off_{c}")
                                         for c in columns])
    w = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.select("*", *[F.sum(c).over(w).alias(f"_in_{c}") for c in columns]).join(offsets, "_bucket")
    return out.select(*df.columns, *[(F.col(f"_in_{c}") + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in columns])
