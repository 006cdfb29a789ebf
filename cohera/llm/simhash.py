"""SimHash near-dedup over a Gray-order hierarchical index.

A text's fingerprint holds, bit by bit, the majority of the hashes of its
shingles. Fingerprints that differ in at most ``MAX_BITS`` bits are linked;
a document's class is the component of its fingerprint.

Equal fingerprints are folded first. Of two fingerprints within ``d`` bits
one of any ``d + 1`` disjoint bit groups is equal, so each is filed under the
masked patterns of its four quarters: these are the upper nodes of the index.
A pattern with more than ``BUCKET`` fingerprints is filed further, under the
quarters of its remaining bits, until none is left; the rule holds again
within it, so nothing is lost and no task gets an unbounded group.

Below a pattern, fingerprints are sorted by their rank in the Gray order,
where neighbours differ in few bits. ``FAN`` neighbours make a node; a node
keeps the bits that all below it agree on, without those its parent holds
already. A search goes down from the pattern and adds up the differences per
node; where they pass ``MAX_BITS`` the whole group is dropped. A task gives a
spanning forest of the links it found, never all pairs; the components are
those of all links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialized, text_batches
from .ngram_join import components

WORDS = 3
MAX_BITS = 3
BITS = 64
SEED = 42
#: fingerprints under one masked pattern; beyond, it is filed further
BUCKET = 32_768
#: children of a node, fingerprints searched together, and node pairs looked at in one step
FAN, SEARCHED, STEP = 8, 65_536, 1 << 18
#: shingles whose bits are counted together
COUNTED = 1 << 16

ALL = (1 << BITS) - 1


def signed(x: int) -> int:
    """An unsigned 64-bit number as Spark's bigint."""
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprint(text: bytes, size: int = WORDS) -> int:
    """SimHash of a text: A-Z lower-cased, words between white space, shingles of ``size`` words."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lens + 1) - lens - 1
    n = max(len(words) - size + 1, 1)
    ends = (starts + lens)[-n:]
    counts = np.zeros(BITS, np.int64)
    for a in range(0, n, COUNTED):
        part = zip(starts[a:min(a + COUNTED, n)].tolist(), ends[a:a + COUNTED].tolist())
        h = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in part], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS) -> DataFrame:
    """(doc_id, fp): every document's fingerprint as a bigint."""
    def run(batches):
        for part, buf, offs in text_batches(batches, "text"):
            fp = [fingerprint(buf[a:b].tobytes(), size) for a, b in zip(offs[:-1], offs[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("doc_id")), pa.array(np.array(fp, np.uint64).view(np.int64))],
                ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, fp bigint")


def gray_rank(fp: Column) -> Column:
    """The position of a bit pattern in the Gray order, sortable as a signed number."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(signed(1 << (BITS - 1))))


def quarters(mask: int, groups: int) -> list[int]:
    """``mask`` joined with each of ``groups`` near-equal groups of the bits it leaves open."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [len(free) * i // groups for i in range(groups + 1)]
    return [mask | sum(1 << b for b in free[a:b_]) for a, b_ in zip(cuts[:-1], cuts[1:])]


def filed(prints: DataFrame, max_bits: int = MAX_BITS, bucket: int | None = None) -> DataFrame:
    """(mask, value, fp): every distinct fingerprint under the masked patterns it is searched in."""
    bucket = BUCKET if bucket is None else bucket
    masks = quarters(0, max_bits + 1)
    every = F.array(*[F.lit(signed(m)) for m in masks])
    rows = prints.select("fp", F.explode(every).alias("mask"))
    rows = rows.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp")
    done = None
    while True:
        # a pattern that leaves max_bits open holds 2 ** max_bits fingerprints at most
        open_ = [m for m in masks if BITS - m.bit_count() > max_bits]
        full = rows.where(F.col("mask").isin([signed(m) for m in open_])).groupBy("mask", "value").agg(
            F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("mask", "value")
        full = materialized(full)
        if not open_ or full.isEmpty():
            return rows if done is None else done.unionByName(rows)
        kept = rows.join(full, ["mask", "value"], "left_anti")
        done = kept if done is None else done.unionByName(kept)
        finer = {m: quarters(m, max_bits + 1) for m in open_}
        children = F.create_map(*[x for m, c in finer.items() for x in (
            F.lit(signed(m)), F.array(*[F.lit(signed(y)) for y in c]))])
        rows = rows.join(full, ["mask", "value"], "left_semi").select("fp", F.explode(children[F.col("mask")]).alias("mask"))
        rows = rows.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp")
        masks = sorted({y for c in finer.values() for y in c})


class GrayIndex:
    """The hierarchy over fingerprints that lie in buckets, each in Gray order.

    ``levels[0]`` are the fingerprints; a node has ``ones`` (bits set in all
    below it), ``own`` (bits that all agree on and its parent does not hold),
    ``last`` (its last fingerprint) and its children's range.
    """

    def __init__(self, fp: np.ndarray, new: np.ndarray):
        self.fp, self.bucket = fp, np.cumsum(new) - 1
        ones, some, bucket, last = fp, fp, self.bucket, np.arange(len(fp))
        first = np.flatnonzero(new)
        levels = [{"ones": ones, "common": np.full(len(fp), ALL, np.uint64), "last": last}]
        while len(ones) > len(first):
            at = np.arange(len(ones)) - np.searchsorted(bucket, bucket)
            starts = np.flatnonzero(at % FAN == 0)
            ends = np.append(starts[1:], len(ones))
            parent = np.repeat(np.arange(len(starts)), ends - starts)
            ones, some = np.bitwise_and.reduceat(ones, starts), np.bitwise_or.reduceat(some, starts)
            bucket, last = bucket[starts], last[ends - 1]
            common = ~(ones ^ some)
            levels[-1]["own"] = levels[-1]["common"] & ~common[parent]
            levels.append({"ones": ones, "common": common, "last": last, "starts": starts, "ends": ends})
        levels[-1]["own"] = levels[-1]["common"]
        self.levels = levels

    def pairs(self, max_bits: int):
        """Arrays (q, r) with q < r in one bucket, at most ``max_bits`` apart, a bounded number at a time."""
        n, top = len(self.fp), len(self.levels) - 1
        stack = [(top, np.arange(a, min(a + STEP, n)), self.bucket[a:a + STEP], np.zeros(min(STEP, n - a), np.uint8))
                 for a in range(0, n, STEP)]
        while stack:
            at, q, node, so_far = stack.pop()
            level = self.levels[at]
            so_far = so_far + np.bitwise_count((self.fp[q] ^ level["ones"][node]) & level["own"][node])
            keep = (so_far <= max_bits) & (level["last"][node] > q)
            q, node, so_far = q[keep], node[keep], so_far[keep]
            if not len(q):
                continue
            if at == 0:
                yield q, node
                continue
            starts = level["starts"][node]
            times = level["ends"][node] - starts
            for cut in np.array_split(np.arange(len(q)), -(-len(q) * FAN // STEP)):
                t = times[cut]
                child = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t) + np.repeat(starts[cut], t)
                stack.append((at - 1, np.repeat(q[cut], t), child, np.repeat(so_far[cut], t)))


def _roots(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def forest(fp: np.ndarray, new: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): links that join all linked fingerprints of each bucket, one fewer than it has members."""
    label = np.arange(len(fp))
    for q, r in GrayIndex(fp, new).pairs(max_bits):
        while True:
            label = _roots(label)
            a, b = label[q], label[r]
            apart = a != b
            if not apart.any():
                break
            np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
    label = _roots(label)
    child = np.flatnonzero(label != np.arange(len(fp)))
    return fp[label[child]], fp[child]


def _search(max_bits: int):
    def links(mask, value, fp):
        new = np.ones(len(fp), bool)
        new[1:] = (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])
        a, b = forest(fp.view(np.uint64), new, max_bits)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(i).to_numpy() for i in range(3)])
            size += batch.num_rows
            if size < SEARCHED:
                continue
            mask, value, fp = (np.concatenate(c) for c in zip(*held))
            ends = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))
            cut = int(ends[-1]) + 1 if len(ends) else 0  # the last bucket may go on in the next batch
            if cut:
                yield links(mask[:cut], value[:cut], fp[:cut])
            held, size = [[mask[cut:], value[cut:], fp[cut:]]], len(fp) - cut
        if size:
            yield links(*(np.concatenate(c) for c in zip(*held)))

    return run


def linked(prints: DataFrame, max_bits: int = MAX_BITS, bucket: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect every component."""
    rows = filed(prints, max_bits, bucket).withColumn("rank", gray_rank(F.col("fp")))
    dealt = rows.repartition("mask", "value").sortWithinPartitions("mask", "value", "rank")
    return dealt.select("mask", "value", "fp").mapInArrow(_search(max_bits), "a bigint, b bigint")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, component_size.

    ``component_id`` is the smallest doc_id that can be reached over links.
    Null, empty and white-space texts have fingerprint zero, which is linked
    like any other; rows that repeat are rows of one component. A null id
    sorts after all others. A text of any length is one fingerprint. Other
    columns of the input, whatever their names, are not read. An empty table
    gives no rows.
    """
    prints = materialized(fingerprints(docs, id_col, text_col, size))
    distinct = materialized(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    links = linked(distinct.select("fp"), max_bits).distinct()
    found = components(links).withColumnRenamed("sid", "fp")
    known = distinct.join(found, "fp", "left").select("fp", "first", "n", F.coalesce("class", "fp").alias("class"))
    classes = known.groupBy("class").agg(F.min("first").alias("component_id"), F.sum("n").alias("component_size"))
    names = known.select("fp", "class").join(classes, "class").select("fp", "component_id", "component_size")
    return prints.join(names, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")
