"""K-d tree partitioning into shards of near-equal bytes (native).

The rows are points: each metadata dimension is quantised to 20 bits of its
global range, followed by 32 bits of the text's crc32, so that equal texts
are one point and different texts hardly ever are. A node that must hold
``k`` shards is split along its widest dimension at the weighted median that
gives ``k // 2`` shards to the left, until every leaf is one shard (or, with
a byte target, as many shards as the target asks for).

The median is found by radix narrowing: all nodes of a level are served by
one grouped sum per digit, of which at most ``2**DIGIT`` rows per node reach
the driver. A cut never parts equal texts unless leaving them whole would
put a side off by more than ``GROUP_SLACK`` of a shard; then the point is
split by a hash of the id, so a hot group cannot outgrow its shards.

The tree has a node per shard, so shard assignment is a map-only expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_hash, materialized

DIGIT = 10
KEY_BITS = 52
ID_BITS = 20
#: shares of a shard's bytes: a cut this near its aim is taken at once / without parting equal texts
STOP_SLACK = 0.002
GROUP_SLACK = 0.02
#: rows per task when slots are numbered
SLOT_ROWS = 100_000


def text_dimensions(text: Column) -> dict[str, Column]:
    """Metadata dimensions of a text: log size, share of non-ASCII bytes, log length of the first line."""
    t = F.coalesce(text, F.lit(""))
    bytes_, chars = F.octet_length(t), F.length(t)
    line = F.locate("\n", t)
    return {"size": F.log2(bytes_ + F.lit(1.0)),
            "wide": (bytes_ - chars) / F.greatest(bytes_, F.lit(1)),
            "line": F.log2(F.when(line > 0, line).otherwise(chars + 1).cast("double"))}


def _side(cut: tuple) -> Column:
    """True for rows left of a cut (dimension, key, inside share of the id hash or None)."""
    dim, key, inner = cut
    left = F.col(dim) < F.lit(key)
    if inner is not None:
        left = left | ((F.col(dim) == F.lit(key)) & (F.col("_h") < F.lit(inner)))
    return left


def _node_column(tree: dict) -> Column:
    """The leaf of every row as one expression over the key columns."""
    def walk(n: int) -> Column:
        if n not in tree:
            return F.lit(n)
        return F.when(_side(tree[n]), walk(2 * n)).otherwise(walk(2 * n + 1))
    return walk(1)


def _select_cuts(rows: DataFrame, aims: dict[int, tuple[str, float, float]]) -> dict[int, tuple]:
    """For each node (dimension, left bytes wanted, shard bytes) its cut, by radix narrowing."""
    state = {n: {"dim": d, "aim": a, "unit": u, "col": d, "bits": KEY_BITS, "prefix": 0, "base": 0} for n, (d, a, u) in aims.items()}
    cuts: dict[int, tuple] = {}
    while state:
        cond, digit = F.lit(False), F.lit(None).cast("bigint")
        for n, s in state.items():
            shift = max(s["bits"] - DIGIT, 0)
            here = (F.col("_node") == n)
            if s["col"] == "_h":
                here = here & (F.col(s["dim"]) == F.lit(s["key"]))
            here = here & (F.shiftright(F.col(s["col"]), s["bits"]) == F.lit(s["prefix"]))
            cond = cond | here
            digit = F.when(F.col("_node") == n, F.shiftright(F.col(s["col"]), shift)).otherwise(digit)
            s["shift"] = shift
        sums: dict[int, list] = {n: [] for n in state}
        for r in (rows.where(cond).groupBy("_node", digit.alias("digit"))
                  .agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("c")).collect()):
            sums[r["_node"]].append((r["digit"], r["w"], r["c"]))
        for n, s in list(state.items()):
            before = s["base"]
            for value, w, c in sorted(sums[n]):
                if before + w >= s["aim"] or (value, w, c) == max(sums[n]):
                    break
                before += w
            below, above = abs(s["aim"] - before), abs(before + w - s["aim"])
            cut_at = value if below <= above else value + 1
            error = min(below, above)
            if s["col"] == "_h":
                if error <= STOP_SLACK * s["unit"] or s["shift"] == 0:
                    cuts[n] = (s["dim"], s["key"], cut_at << s["shift"])
                    del state[n]
                    continue
            elif error <= STOP_SLACK * s["unit"] or (s["shift"] == 0 and (error <= GROUP_SLACK * s["unit"] or c == 1)):
                cuts[n] = (s["dim"], cut_at << s["shift"], None)
                del state[n]
                continue
            elif s["shift"] == 0:  # one point too heavy for either side: part it by id
                s.update(key=value, col="_h", bits=ID_BITS, prefix=0, base=before)
                continue
            s.update(bits=s["shift"], prefix=value, base=before)
    return cuts


def kd_shards(docs: DataFrame, n_shards: int | None = 24, target_bytes: int | None = None,
              id_col: str = "doc_id", text_col: str = "text", dims: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot.

    ``size`` is the text's UTF-8 bytes (null: none) plus 8. Give the number
    of shards, or the bytes a leaf should reach. ``dims`` maps names to
    numeric columns; the default derives them from the text. Null dimension
    values count as the smallest. Slots are gapless from 0 in each shard. An
    empty table gives no rows; fewer distinct rows than shards leave shards
    empty. Repeated rows are points like any other.
    """
    text = F.col(text_col)
    dims = dims or text_dimensions(text)
    names = list(dims)
    t = F.coalesce(text, F.lit("")).cast("binary")
    meta = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(t) + 8).cast("bigint").alias("size"),
                       F.crc32(t).alias("text_crc32"),
                       *[c.cast("double").alias(f"_d{i}") for i, c in enumerate(dims.values())])
    meta = materialized(meta)
    ends = meta.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"),
                    *[f(f"_d{i}").alias(f"{k}{i}") for i in range(len(names)) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    total = ends["bytes"] or 0
    if target_bytes:
        n_shards = max(1, math.ceil(total / target_bytes))
    keys = []
    for i in range(len(names)):
        lo, hi = ends[f"lo{i}"] or 0.0, ends[f"hi{i}"] or 0.0
        scaled = (F.coalesce(F.col(f"_d{i}"), F.lit(lo)) - F.lit(lo)) / F.lit(max(hi - lo, 1e-12)) * F.lit(2 ** 20 - 1)
        keys.append((F.shiftleft(scaled.cast("bigint"), 32) + F.col("text_crc32")).alias(f"_k{i}"))
    rows = meta.select("doc_id", "size", "text_crc32", *keys,
                       F.pmod(F.xxhash64(id_hash("doc_id"), "doc_id"), F.lit(1 << ID_BITS)).alias("_h"))
    tree: dict[int, tuple] = {}
    want = {1: n_shards}
    while any(k > 1 for k in want.values()) and total:
        at = rows.withColumn("_node", _node_column(tree))
        open_ = [n for n, k in want.items() if k > 1]
        stats = {r["_node"]: r for r in at.where(F.col("_node").isin(open_)).groupBy("_node").agg(
            F.sum("size").alias("bytes"),
            *[f(f"_k{i}").alias(f"{k}{i}") for i in range(len(names)) for k, f in (("lo", F.min), ("hi", F.max))]).collect()}
        aims = {}
        for n in open_:
            if n not in stats:  # an empty node: its shards stay empty
                tree[n] = ("_k0", 0, None)
                continue
            s = stats[n]
            widest = max(range(len(names)), key=lambda i: ((s[f"hi{i}"] >> 32) - (s[f"lo{i}"] >> 32), -i))
            left = want[n] // 2
            aims[n] = (f"_k{widest}", s["bytes"] * left / want[n], s["bytes"] / want[n])
        tree.update(_select_cuts(at, aims))
        for n in open_:
            k = want.pop(n)
            want.update({2 * n: k // 2, 2 * n + 1: k - k // 2})
    leaf = {n: i for i, n in enumerate(sorted(want, key=lambda n: n / 2 ** n.bit_length()))}
    order = F.create_map(*[F.lit(x) for pair in leaf.items() for x in pair])
    placed = rows.withColumn("shard", order[_node_column(tree)].cast("int")).select("doc_id", "size", "text_crc32", "shard", "_h")
    return _slots(placed, ends["rows"], max(len(leaf), 1))


def _slots(placed: DataFrame, n_rows: int, n_shards: int) -> DataFrame:
    """Number each shard's rows from 0: a window within small hash buckets plus the bucket's offset."""
    buckets = max(1, math.ceil(n_rows / n_shards / SLOT_ROWS))
    placed = placed.withColumn("_b", F.pmod(F.xxhash64("_h", "doc_id", "text_crc32"), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("shard").orderBy("_b")  # a row per bucket, not per row
    offsets = counts.select("shard", "_b", (F.sum("n").over(w) - F.col("n")).alias("_off"))
    inside = Window.partitionBy("shard", "_b").orderBy("_h", "doc_id", "text_crc32", "size")
    x = placed.withColumn("_i", F.row_number().over(inside)).join(offsets, ["shard", "_b"])
    return x.select("doc_id", "size", "text_crc32", "shard", (F.col("_i") - 1 + F.col("_off")).cast("bigint").alias("slot"))
