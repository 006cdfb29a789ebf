"""Unique sentence shuffles of each text, as negatives.

Contract (per text of ``n`` sentences, limit ``k_max``):

* ``want = min(n! - 1, k_max)``; fewer than two sentences or ``want <= 0``
  gives no shuffle.
* *enumerate* when ``n < 10`` and (``n! < 2 k_max`` or ``n! < 1000``): all
  distinct orders except the original, then a seeded sample of ``want`` of
  them.
* otherwise *sample*: seeded random orders, attempt by attempt; the original
  order is skipped, duplicates are skipped, stop at ``want`` unique orders
  or after ``5 want + 10`` attempts.

Orders are kept as 0-based *canonical* positions (position of the first
equal sentence), so equal sentence orders are equal arrays. Two different
orders can still join to the same text when the last sentence lacks an end
mark (``d A. A. d``): for those texts, and only those, uniqueness is decided
on the joined strings (``distinct_texts``). As a list of orders is sampled
first and equal texts dropped after, such a text may get fewer than
``want``; attempts instead go on until ``want`` texts differ. Nothing here
leaves the row: no exchange. Attempts are sorted in Arrow batches, as a sort
in lambda expressions costs tens of times as much.
"""

from __future__ import annotations

import math
from functools import lru_cache
from hashlib import md5
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import MAX_PREFIX, digest_keys, numbered
from ..functions.keys import md5_key
from ..functions.sentences import canonical_positions, join_sentences, let
from ..session import with_batches

# Fixed value: texts of this many sentences are never enumerated.
ENUMERATE_BELOW = 10
#: sentences of the texts whose orders are drawn together
DRAWN = 1 << 16
# Spare attempts in the first sampling pass (a cost knob; results are equal).
FIRST_PASS_SPARE = 2


def enumerable_sizes(k_max: int) -> list[int]:
    """Sentence counts for which all orders are listed (the size heuristic)."""
    return [n for n in range(2, ENUMERATE_BELOW)
            if math.factorial(n) < 2 * k_max or math.factorial(n) < 1000]


def shuffle_plan(n: Column, k_max: int) -> tuple[Column, Column]:
    """``(want, method)`` columns for a sentence-count column."""
    k = F.lit(int(k_max))
    want = (
        F.when(n < 2, F.lit(0))
        .when(n <= 12, F.least(F.factorial(n) - 1, k.cast("bigint")).cast("int"))
        .otherwise(k)
    )
    sizes = enumerable_sizes(k_max) if k_max > 0 else []
    method = (
        F.when(want <= 0, F.lit("none"))
        .when(n.isin(sizes) if sizes else F.lit(False), F.lit("enumerate"))
        .otherwise(F.lit("sample"))
    )
    return want, method


def _all_orders(n: int) -> Column:
    """Every order of ``0..n-1``: each next number goes to every place of every shorter order."""
    def places(p: Column, m: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(m)),
                           lambda i: F.concat(F.slice(p, 1, i), F.array(F.lit(m)), F.slice(p, i + 1, F.lit(m) - i)))

    orders = F.array(F.array(F.lit(0)))
    for m in range(1, n):
        orders = F.flatten(F.transform(orders, lambda p: places(p, m)))
    return orders


def permutation_table(spark, sizes: list[int]) -> DataFrame:
    """``(perm_n INT, perms ARRAY<ARRAY<INT>>)``: every order of ``0..n-1``.

    Made by Spark from the rule, one row per size. Sizes stay below
    ``ENUMERATE_BELOW``, so the table has a fixed bound (409,113 orders, about
    15 MB; 873 orders for the default ``k_max``) and may be broadcast.
    """
    rows = [F.struct(F.lit(n).alias("perm_n"), _all_orders(n).alias("perms")) for n in sizes]
    table = spark.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("perm_n"), F.array(F.array(F.lit(0))).alias("perms")),
                                                    *rows)).alias("r"))
    return table.select("r.perm_n", "r.perms").where("perm_n > 0")


def distinct_permutations(perms: Column, canon: Column) -> Column:
    """All distinct orders as texts see them, without the original.

    Where all sentences differ the orders are distinct as they are; else
    they are told apart as strings (hashed, not compared pair by pair).
    """
    def by_text(p):
        return F.array_join(F.transform(p, lambda i: F.element_at(canon, i + 1)), ",")

    repeated = F.transform(F.array_distinct(F.transform(perms, by_text)),
                           lambda s: F.split(s, ",").cast("array<int>"))
    plain = F.size(F.array_distinct(canon)) == F.size(canon)
    return F.filter(F.when(plain, perms).otherwise(repeated), lambda t: t != canon)


def _open_end(sentences: Column) -> Column:
    """Whether the last sentence lacks an end mark."""
    return ~F.try_element_at(sentences, F.lit(-1)).rlike("[.!?]$")


def distinct_texts(orders: Column, sentences: Column) -> Column:
    """The orders without those that join to the text of an earlier one.

    Only a last sentence without an end mark allows that, so other texts are
    left as they are.
    """
    def first_of_each(texts):
        return F.filter(orders, lambda t, i: F.array_position(texts, F.element_at(texts, i + 1)) == i + 1)

    return F.when(_open_end(sentences), let(F.transform(orders, lambda t: join_sentences(sentences, t)), first_of_each)).otherwise(orders)


def sample_permutations(orders: Column, want: Column, record_id: Column, seed: int) -> Column:
    """Seeded sample without replacement of ``min(len, want)`` orders."""
    keyed = F.transform(
        orders,
        lambda t: F.struct(md5_key(F.lit(seed), record_id, F.lit("p"), F.array_join(t, ",")).alias("k"),
                           t.alias("t")),
    )
    return F.slice(F.transform(F.sort_array(keyed), lambda z: z["t"]), 1, want)


def _attempt_keys(n: Column, record_id: Column, seed: int, last: Column) -> Column:
    """The keys of attempts ``1..last``, one after the other, as hex digits.

    A digest ``md5(seed|id|j|b)`` holds the 8-digit keys of positions
    ``4b..4b+3`` in attempt ``j``.
    """
    row_prefix = F.concat(F.lit(f"{seed}|"), record_id.cast("string"), F.lit("|"))
    blocks = F.transform(F.sequence(F.lit(0), F.shiftright(n - 1, 2)), lambda b: b.cast("string"))

    def one(j):
        return let(F.concat(row_prefix, j.cast("string"), F.lit("|")),
                   lambda prefix: F.array_join(F.transform(blocks, lambda b: F.md5(F.concat(prefix, b))), ""))

    return F.array_join(F.transform(F.sequence(F.lit(1), last), one), "")


def _first_orders(keys: str, canon: np.ndarray, want: int, sentences: list[str] | None) -> list[np.ndarray]:
    """The first ``want`` different orders of one text's attempts, the original left out.

    An attempt sorts the positions by its keys, equal keys by position. With
    ``sentences`` the orders must differ as joined texts too.
    """
    n, width = len(canon), len(canon) + -len(canon) % 4
    if n == 0:  # no text
        return []
    drawn = np.frombuffer(bytes.fromhex(keys), ">u4").reshape(-1, width)[:, :n].astype(np.uint32)
    orders = canon[drawn.argsort(axis=1, kind="stable")]
    seen, texts, out = {canon.tobytes()}, set(), []
    for order in orders:
        if len(out) == want:
            break
        own = order.tobytes()
        if own in seen:
            continue
        seen.add(own)
        if sentences is not None:
            text = " ".join([sentences[i] for i in order])
            if text in texts:
                continue
            texts.add(text)
        out.append(order)
    return out


def _drawn_orders(keys: pa.Array, canon: pa.Array, want: pa.Array, open_end: pa.Array, sentences: pa.Array) -> pa.Array:
    """``_first_orders`` of a batch; null where ``keys`` is null."""
    flat = canon.flatten().to_numpy(zero_copy_only=False)
    end = np.cumsum(pc.fill_null(pc.list_value_length(canon), 0).to_numpy(zero_copy_only=False))
    wanted = pc.fill_null(want, 0).to_numpy(zero_copy_only=False)
    open_end = pc.fill_null(open_end, False).to_numpy(zero_copy_only=False)
    found, sizes = [], [0]
    for i, k in enumerate(keys):
        if k.is_valid:
            text = sentences[i].as_py() if open_end[i] else None
            found += _first_orders(k.as_py(), flat[end[i - 1] if i else 0:end[i]], int(wanted[i]), text)
        sizes.append(len(found))
    inner = pa.ListArray.from_arrays(
        pa.array(np.cumsum([0, *map(len, found)]), pa.int32()),
        pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32()))
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), inner, mask=pc.is_null(keys))


def _orders_by(keys: np.ndarray, canon: np.ndarray) -> np.ndarray:
    """The positions sorted by each row of keys, equal keys by position."""
    n = len(canon)
    keyed = (keys[:, :n].astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    keyed.sort(axis=1)
    return canon[(keyed & np.uint64(0xFFFFFFFF)).astype(np.int64)]


def _attempt_orders(row_prefix: bytes, canon: np.ndarray, attempt: int) -> np.ndarray:
    """One attempt of a text, as ``_attempts`` draws it."""
    prefix = b"%s%d|" % (row_prefix, attempt)
    drawn = b"".join([md5(b"%s%d" % (prefix, b)).digest() for b in range((len(canon) + 3) // 4)])
    return _orders_by(np.frombuffer(drawn, ">u4").reshape(1, -1), canon)


def _text_orders(row_prefix: bytes, canon: np.ndarray, want: int, sentences: list[str] | None, first: np.ndarray) -> np.ndarray:
    """The first ``want`` different orders of one text, the original left out, a row each.

    ``first`` holds its first attempts; the others follow one by one, as far as the contract allows.
    """
    original = canon.tobytes()
    if sentences is None and len(first) == want:
        unique = {o.tobytes() for o in first}
        if len(unique) == want and original not in unique:
            return first
    seen, texts, out = {original}, set(), []
    for j in range(1, 5 * want + 11):
        if len(out) == want:
            break
        order = first[j - 1] if j <= len(first) else _attempt_orders(row_prefix, canon, j)[0]
        own = order.tobytes()
        if own in seen:
            continue
        seen.add(own)
        if sentences is not None:
            text = " ".join([sentences[i] for i in order])
            if text in texts:
                continue
            texts.add(text)
        out.append(order)
    return np.array(out, canon.dtype).reshape(len(out), len(canon))


def _first_attempts(texts: list[tuple[bytes, np.ndarray, int]]) -> list[np.ndarray]:
    """Attempts ``1..want`` of many texts ``(prefix, canon, want)``, digested together.

    Texts with a very long id, and those too large for it, get none here.
    """
    def blocks(prefix, canon):
        fits = len(canon) <= DRAWN and len(prefix) <= MAX_PREFIX - 12
        return (len(canon) + 3) // 4 if fits else 0

    sizes = [blocks(p, c) for p, c, _ in texts]
    messages = np.zeros((sum(b * w for b, (_, _, w) in zip(sizes, texts)), 64), np.uint8)
    at = 0
    for b, (prefix, _, want) in zip(sizes, texts):
        if b:
            numbered(messages[at:at + b * want].reshape(want, b, 64), prefix)
            at += b * want
    keys = digest_keys(messages)
    out, at = [], 0
    for b, (_, canon, want) in zip(sizes, texts):
        if b:
            out.append(_orders_by(keys[at:at + b * want].reshape(want, -1), canon))
            at += b * want
        else:
            out.append(np.zeros((0, len(canon)), canon.dtype))
    return out


@lru_cache(maxsize=8)
def _orders_but(canon: tuple[int, ...]) -> tuple[list[tuple[int, ...]], list[bytes]]:
    """``distinct_permutations`` of one text, and each as its numbers joined by commas."""
    orders = sorted(set(permutations(canon)) - {canon})
    return orders, [",".join(map(str, o)).encode() for o in orders]


def _listed_orders(row_prefix: bytes, canon: tuple[int, ...], want: int, sentences: list[str] | None) -> list[tuple[int, ...]]:
    """``sample_permutations`` of one text's orders; with ``sentences`` those that join to an earlier one's text are left out."""
    orders, names = _orders_but(canon)
    keys = [md5(row_prefix + x).digest() for x in names]
    sample = [orders[i] for i in sorted(range(len(keys)), key=keys.__getitem__)[:want]]
    if sentences is None:
        return sample
    texts: dict[str, tuple[int, ...]] = {}
    for order in sample:
        texts.setdefault(" ".join([sentences[i] for i in order]), order)
    return list(texts.values())


def batch_listed(seed: int, rid: pa.Array, canon: pa.Array, want: pa.Array, enum: pa.Array, text: pa.Array, lists: pa.Array) -> pa.Array:
    """``enum`` of an Arrow batch, with the shuffles of the texts whose orders are listed (``lists``) where it is null."""
    ready = pc.and_(pc.and_(pc.fill_null(lists, False), pc.is_null(enum)), pc.and_(pc.is_valid(rid), pc.is_valid(canon)))
    made = {i: _listed_orders(f"{seed}|{rid[i].as_py()}|p|".encode(), tuple(canon[i].as_py()), want[i].as_py(), text[i].as_py())
            for i in np.flatnonzero(ready.to_numpy(zero_copy_only=False)).tolist()}
    return pc.coalesce(enum, pa.array([made.get(i) for i in range(len(rid))], enum.type)) if made else enum


def batch_orders(seed: int, rid: pa.Array, canon: pa.Array, want: pa.Array, enum: pa.Array, text: pa.Array) -> pa.Array:
    """Original (canonical positions) first, then the shuffles, of an Arrow batch.

    ``enum`` holds the shuffles of the texts whose orders are listed, ``text``
    the sentences of those that need them (``drawn_inputs``). Null for rows
    without an id or a text.
    """
    flat = canon.flatten().to_numpy(zero_copy_only=False)
    size = pc.fill_null(pc.list_value_length(canon), 0).to_numpy(zero_copy_only=False)
    end = np.cumsum(np.concatenate([[0], size]))
    wanted = pc.fill_null(want, 0).to_pylist()
    known = pc.and_(pc.is_valid(rid), pc.is_valid(canon)).to_numpy(zero_copy_only=False)
    listed = pc.is_valid(enum).to_numpy(zero_copy_only=False)
    drawn = [i for i in np.flatnonzero(known & ~listed).tolist() if wanted[i] > 0]
    texts = [(f"{seed}|{rid[i].as_py()}|".encode(), flat[end[i]:end[i + 1]], wanted[i]) for i in drawn]
    negs = {i: _text_orders(*t, text[i].as_py(), first) for i, t, first in zip(drawn, texts, _first_attempts(texts))}
    values, counts = [], np.zeros(len(rid), np.int64)
    for i in np.flatnonzero(known).tolist():
        own = negs[i] if i in negs else np.array(enum[i].as_py() if listed[i] else [], np.int32)
        values += [flat[end[i]:end[i + 1]], own.ravel()]
        counts[i] = 1 + len(own)
    inner = pa.ListArray.from_arrays(
        pa.array(np.cumsum(np.concatenate([[0], np.repeat(size, counts)])), pa.int32()),
        pa.array(np.concatenate(values) if values else np.zeros(0, np.int32), pa.int32()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), inner, mask=pa.array(~known))


def drawn_parts(canon: pa.Array) -> list[tuple[int, int]]:
    """Start and length of runs of rows with about ``DRAWN`` sentences each: 21 orders of them fit in memory."""
    upto = np.cumsum(pc.fill_null(pc.list_value_length(canon), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cut = np.flatnonzero(np.diff(upto // DRAWN)) + 1
    at = [0, *cut.tolist(), len(canon)]
    return [(a, z - a) for a, z in zip(at, at[1:])]


def _attempts(canon: Column, n: Column, record_id: Column, seed: int, first: Column, last: Column) -> Column:
    """Random orders ``first..last``: sort positions by seeded keys.

    A digest ``md5(seed|id|j|b)`` holds the 8-digit keys of positions
    ``4b..4b+3``; equal keys are ordered by position. The digests are made
    once per attempt (bound to a lambda variable).
    """
    row_prefix = F.concat(F.lit(f"{seed}|"), record_id.cast("string"), F.lit("|"))

    def one(j):
        def digests(prefix):
            return F.transform(F.sequence(F.lit(0), F.shiftright(n - 1, 2)),
                               lambda b: F.md5(F.concat(prefix, b.cast("string"))))

        def keyed(hexes):
            return F.transform(
                F.sequence(F.lit(0), n - 1),
                lambda i: F.struct(F.substring(F.element_at(hexes, F.shiftright(i, 2) + 1),
                                               i.bitwiseAND(F.lit(3)) * 8 + 1, F.lit(8)).alias("k"), i.alias("i")),
            )
        pairs = let(let(F.concat(row_prefix, j.cast("string"), F.lit("|")), digests), keyed)
        return F.transform(F.sort_array(pairs), lambda z: F.element_at(canon, z["i"] + 1))

    return F.filter(F.transform(F.sequence(first, last), one), lambda t: t != canon)


def sample_shuffles(df: DataFrame, seed: int, canon: str = "canon", n: str = "n_sentences",
                    want: str = "want", record_id: str = "record_id", out: str = "negs",
                    only_when: Column | None = None, sentences: str = "sentences") -> DataFrame:
    """Random-order branch; adds ``out`` (``ARRAY<ARRAY<INT>>``).

    Attempts are ordered, so the first ``want`` distinct ones equal the stop
    rule of the attempt loop. A first pass draws the keys of ``want + 2``
    attempts in the row and sorts them in Arrow batches, which
    suffices unless sentences repeat (with 7 distinct sentences two misses
    in 22 draws are rare); only rows left short draw the rest up to
    ``5 want + 10`` (``CASE`` evaluates that branch for them alone). The
    result does not depend on the split point.
    """
    c, nn, w, rid = F.col(canon), F.col(n), F.col(want), F.col(record_id)
    cond = only_when if only_when is not None else F.lit(True)
    head = F.least(w + FIRST_PASS_SPARE, w * 5 + 10)
    s = F.col(sentences)
    df = df.withColumn("_keys", F.when(cond, _attempt_keys(nn, rid, seed, head))).withColumn("_open", _open_end(s))
    df = with_batches(df, "_first", "array<array<int>>", _drawn_orders, ("_keys", canon, want, "_open", sentences), drop=("_keys", "_open"))
    more = F.array_distinct(F.concat(F.col("_first"), _attempts(c, nn, rid, seed, head + 1, w * 5 + 10)))
    rest = let(more, lambda orders: distinct_texts(orders, s))
    negs = F.when(F.size("_first") < w, F.slice(rest, 1, w)).otherwise(F.col("_first"))
    return df.withColumn(out, negs).drop("_first")


def planned_shuffles(df: DataFrame, k_max: int = 20, seed: int = 42, sentences: str = "sentences",
                     record_id: str = "record_id", only_when: Column | None = None) -> DataFrame:
    """Add ``n_sentences, canon, want, method`` and ``_enum``, the shuffles of texts whose orders are listed.

    With ``only_when``, ``_enum`` is null in other rows (``batch_listed`` makes theirs).
    """
    spark = df.sparkSession
    s = F.col(sentences)
    df = df.withColumn("n_sentences", F.size(s)).withColumn("canon", canonical_positions(s))
    want, method = shuffle_plan(F.col("n_sentences"), k_max)
    df = df.withColumn("want", want).withColumn("method", method)

    sizes = enumerable_sizes(k_max) if k_max > 0 else []
    if not sizes:
        return df.withColumn("_enum", F.lit(None).cast("array<array<int>>"))
    table = F.broadcast(permutation_table(spark, sizes))
    listed = F.col("method") == "enumerate"
    if only_when is not None:
        listed = listed & only_when
    df = df.join(table, (F.col("n_sentences") == table["perm_n"]) & listed, "left")
    enum_negs = sample_permutations(
        distinct_permutations(F.col("perms"), F.col("canon")), F.col("want"), F.col(record_id), seed)
    df = df.withColumn("_sampled", F.when(listed, enum_negs)).drop("perm_n", "perms")
    return df.withColumn("_enum", distinct_texts(F.col("_sampled"), s)).drop("_sampled")


def generate_shuffles(df: DataFrame, k_max: int = 20, seed: int = 42, sentences: str = "sentences",
                      record_id: str = "record_id") -> DataFrame:
    """Add ``n_sentences, canon, want, method, negs, n_neg`` to a sentence table.

    ``negs`` holds up to ``k_max`` unique orders (canonical positions), the
    original excluded. Row-wise only: the one join is a broadcast of the
    fixed permutation table, so the plan has no shuffle exchange.
    """
    df = planned_shuffles(df, k_max, seed, sentences, record_id)
    df = sample_shuffles(df, seed, record_id=record_id, out="_sample",
                         only_when=F.col("method") == "sample", sentences=sentences)
    negs = F.coalesce(F.col("_enum"), F.col("_sample"), F.array().cast("array<array<int>>"))
    return df.withColumn("negs", negs).drop("_enum", "_sample").withColumn("n_neg", F.size("negs"))


#: columns that ``batch_listed`` reads, ``batch_orders`` and ``row_orders`` all but the last (``drawn_inputs``)
DRAWN_INPUTS = ("_rid", "canon", "want", "_enum", "_text", "_lists")


def drawn_inputs(sentences: str = "sentences", record_id: str = "record_id") -> list[Column]:
    """``DRAWN_INPUTS`` of planned shuffles; sentences only of texts whose orders may join to one text."""
    s = F.col(sentences)
    return [F.col(record_id).cast("string").alias("_rid"), F.col("canon"), F.col("want"), F.col("_enum"),
            F.when((F.col("method") != "none") & _open_end(s), s).alias("_text"), (F.col("method") == "enumerate").alias("_lists")]


def row_orders(seed: int) -> Column:
    """``batch_orders`` as an expression, for the rows that the batches leave out."""
    c, w, s = F.col("canon"), F.col("want"), F.col("_text")
    n, rid, head = F.size(c), F.col("_rid"), w + FIRST_PASS_SPARE

    def different(orders):
        unique = F.array_distinct(orders)
        return F.when(s.isNull(), unique).otherwise(distinct_texts(unique, s))

    def enough(first):
        more = let(F.concat(first, _attempts(c, n, rid, seed, head + 1, w * 5 + 10)), different)
        return F.slice(F.when(F.size(first) < w, more).otherwise(first), 1, w)

    drawn = F.when(w > 0, let(let(_attempts(c, n, rid, seed, F.lit(1), head), different), enough))
    return F.concat(F.array(c), F.coalesce(F.col("_enum"), drawn, F.array().cast("array<array<int>>")))


def shuffle_texts(sentences: str = "sentences", negs: str = "negs") -> Column:
    """Shuffled candidates as strings (sentences joined by one space)."""
    return F.transform(F.col(negs), lambda o: join_sentences(sentences, o))
