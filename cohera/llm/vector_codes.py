"""Vector code compression by dual-tree Lloyd rounds on integers.

A vector of integers is cut into equal parts; each part position has a
codebook, and a part's code is its nearest entry. A Lloyd round assigns every
part and moves each entry to the mean of its parts.

Blocks of vectors become trees once: per part position a balanced k-d tree
(median splits along the widest component) whose nodes keep box, sum and
count. They are written to the shared folder and read in every round. The
entries of a position form a small tree too. Both are walked down together:
for a pair of nodes the integer distance of their boxes bounds every
distance, so an entry node farther than another's farthest point is dropped
for the whole part node. Where one entry is left, the node is assigned whole
and its kept sum is added; leaves that stay uncertain compare their points by
integer distances. Nothing is rounded, so neither blocks nor tasks nor
retries change the result.

A round gives one row per part position, entry and component and task; the
driver holds the codebooks, whose size does not depend on the data.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialized

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
#: components from here on (|x|) count as non-finite: squares of their differences would not fit
MAX_ABS = 65_536.0
#: vectors of a tree, and parts of a leaf
BLOCK, LEAF = 4096, 16


# ------------------------------------------------------------------ trees
def _bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin, and the end."""
    return (n * np.arange((1 << level) + 1)) >> level


class Tree:
    """Trees over the parts of some vectors, one per part position.

    ``points`` is (parts, vectors, components) in tree order, ``order`` the
    vector of each point. Level ``l`` has ``2**l`` nodes; node arrays hold all
    levels, the root first.
    """

    def __init__(self, order, points, lo, hi, sums):
        self.order, self.points, self.lo, self.hi, self.sums = order, points, lo, hi, sums
        self.depth = (lo.shape[1] + 1).bit_length() - 2

    @classmethod
    def grown(cls, vectors: np.ndarray, parts: int) -> "Tree":
        n, dims = vectors.shape
        points = np.ascontiguousarray(vectors.reshape(n, parts, dims // parts).transpose(1, 0, 2))
        depth = max(0, int(np.ceil(np.log2(n / LEAF)))) if n else 0
        order = np.tile(np.arange(n), (parts, 1))
        stats = []
        for level in range(depth + 1):
            b = _bounds(n, level)
            at = (b[:-1][None, :] + n * np.arange(parts)[:, None]).ravel()
            flat = points.reshape(parts * n, -1)
            lo, hi = np.minimum.reduceat(flat, at), np.maximum.reduceat(flat, at)
            sums = np.add.reduceat(flat.astype(np.int64), at)
            stats.append([x.reshape(parts, 1 << level, -1) for x in (lo, hi, sums)])
            if level < depth:
                node = np.repeat(np.arange(len(at)), np.tile(np.diff(b), parts))
                wide = (hi - lo).argmax(1)
                turn = np.lexsort((flat[np.arange(parts * n), wide[node]], node)).reshape(parts, n)
                order = np.take_along_axis(order, turn - n * np.arange(parts)[:, None], 1)
                points = flat[turn.ravel()].reshape(points.shape)
        return cls(order, points, *(np.concatenate(x, 1) for x in zip(*stats)))

    FIELDS = (("order", np.int32), ("points", np.int32), ("lo", np.int32), ("hi", np.int32), ("sums", np.int64))

    def packed(self) -> list[bytes]:
        return [getattr(self, f).astype(t).tobytes() for f, t in self.FIELDS]

    @classmethod
    def unpacked(cls, fields: list[bytes], n: int, parts: int) -> "Tree":
        order, points, lo, hi, sums = (np.frombuffer(x, t) for x, (_, t) in zip(fields, cls.FIELDS))
        width = len(points) // (n * parts)
        return cls(order.reshape(parts, n), points.reshape(parts, n, width),
                   *(x.reshape(parts, -1, width) for x in (lo, hi, sums)))


class EntryTree:
    """The entries of every part position as a binary tree; leaves are single entries."""

    def __init__(self, books: np.ndarray):
        self.books = books
        parts, k, width = books.shape
        rows: list[list[tuple]] = []
        for p in range(parts):
            nodes: list[list] = []
            todo = [np.arange(k)]
            for own in todo:  # grows while it is read
                part = books[p, own]
                lo, hi = part.min(0), part.max(0)
                left = -1
                if len(own) > 1:
                    by = own[np.argsort(part[:, (hi - lo).argmax()], kind="stable")]
                    left = len(todo)
                    todo += [by[:len(by) // 2], by[len(by) // 2:]]
                nodes.append((lo, hi, left, own[0] if left < 0 else -1))
            rows.append(nodes)
        self.size = 2 * k - 1
        self.lo = np.array([r[0] for nodes in rows for r in nodes], np.int64)
        self.hi = np.array([r[1] for nodes in rows for r in nodes], np.int64)
        left = np.array([r[2] for nodes in rows for r in nodes], np.int64)
        base = np.repeat(np.arange(parts) * self.size, self.size)
        self.left = np.where(left < 0, -1, left + base)
        self.entry = np.array([r[3] for nodes in rows for r in nodes], np.int64)


def _pruned(tree: Tree, near: EntryTree, d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The node pairs (sorted by ``d``) whose entries can be nearest to some point of the part node."""
    lo, hi = tree.lo.reshape(-1, tree.lo.shape[2])[d].astype(np.int64), tree.hi.reshape(-1, tree.hi.shape[2])[d].astype(np.int64)
    below, above = near.lo[e] - hi, lo - near.hi[e]
    gap = np.maximum(np.maximum(below, above), 0)
    reach = np.maximum(near.hi[e] - lo, hi - near.lo[e])
    least, most = (gap * gap).sum(1), (reach * reach).sum(1)
    first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
    limit = np.repeat(np.minimum.reduceat(most, first), np.diff(np.append(first, len(d))))
    keep = least <= limit  # ties stay, for the lower index
    return d[keep], e[keep]


def _split_entries(near: EntryTree, d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry nodes replaced by their children; single entries stay."""
    inner = near.left[e] >= 0
    times = np.where(inner, 2, 1)
    at = np.repeat(np.arange(len(d)), times)
    second = np.concatenate([[False], at[1:] == at[:-1]])
    return d[at], np.where(inner[at], near.left[e[at]] + second, e[at])


def assign(tree: Tree, near: EntryTree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, sums, counts): each point's entry in tree order, and the sums per part position and entry."""
    parts, n, width = tree.points.shape
    nodes = tree.lo.shape[1]
    codes = np.zeros((parts, n), np.int64)
    total = np.zeros((parts * near.books.shape[1], width), np.int64)
    count = np.zeros(len(total), np.int64)
    k = near.books.shape[1]
    flat_sums = tree.sums.reshape(parts * nodes, width)

    def settle(d, e, level):
        """Assign the nodes with one entry left; the others go on."""
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        size = np.diff(np.append(first, len(d)))
        sure = first[(size == 1) & (near.left[e[first]] < 0)]
        b = _bounds(n, level)
        p, at, entry = d[sure] // nodes, d[sure] % nodes - ((1 << level) - 1), near.entry[e[sure]]
        np.add.at(total, p * k + entry, flat_sums[d[sure]])
        np.add.at(count, p * k + entry, b[at + 1] - b[at])
        for i, s, t, x in zip(p.tolist(), b[at].tolist(), b[at + 1].tolist(), entry.tolist()):
            codes[i, s:t] = x
        rest = np.ones(len(d), bool)
        rest[sure] = False
        return d[rest], e[rest]

    d, e = np.arange(parts) * nodes, np.arange(parts) * near.size
    for level in range(tree.depth + 1):
        while True:
            d, e = _split_entries(near, d, e)
            d, e = _pruned(tree, near, d, e) if len(d) else (d, e)
            if level < tree.depth or not (near.left[e] >= 0).any():
                break
        d, e = settle(d, e, level) if len(d) else (d, e)
        if level < tree.depth and len(d):  # each child of a part node takes the entries that are left
            p, at = d // nodes, d % nodes
            d = np.concatenate([p * nodes + 2 * at + 1, p * nodes + 2 * at + 2])
            e = np.concatenate([e, e])
            turn = np.argsort(d, kind="stable")
            d, e = d[turn], e[turn]
    if len(d):  # uncertain leaves: integer distances of their points
        b = _bounds(n, tree.depth)
        p, at = d // nodes, d % nodes - ((1 << tree.depth) - 1)
        size = b[at + 1] - b[at]
        pair = np.repeat(np.arange(len(d)), size)
        point = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + b[at][pair]
        entry = near.entry[e[pair]]
        row = p[pair] * n + point
        apart = tree.points.reshape(parts * n, width)[row] - near.books.reshape(-1, width)[p[pair] * k + entry]
        dist = (apart * apart).sum(1)
        turn = np.lexsort((entry, dist, row))
        best = turn[np.concatenate([[True], row[turn][1:] != row[turn][:-1]])]
        row, entry = row[best], entry[best]
        codes.reshape(-1)[row] = entry
        np.add.at(total, row // n * k + entry, tree.points.reshape(parts * n, width)[row])
        np.add.at(count, row // n * k + entry, 1)
    return codes, total.reshape(parts, k, width), count.reshape(parts, k)


# ------------------------------------------------------------------- jobs
def kept_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, v): the rows whose vector is whole, with integer components ``floor(256 x)``."""
    x = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("x"))
    whole = F.forall("x", lambda c: F.coalesce(F.abs(c.cast("double")) < MAX_ABS, F.lit(False)))  # NaN is not below
    x = x.where(F.col("x").isNotNull() & (F.size("x") > 0) & whole)
    return x.select("vec_id", "label", F.transform("x", lambda c: F.floor(c.cast("double") * SCALE).cast("int")).alias("v"))


def _grow(parts: int):
    def rows(held):
        t = pa.Table.from_batches(held).combine_chunks()
        n = t.num_rows
        v = t["v"].combine_chunks()
        flat = v.flatten().to_numpy().reshape(n, -1)
        lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), t[c].combine_chunks()) for c in ("vec_id", "label")]
        return pa.RecordBatch.from_arrays([*lists, *[pa.array([x], pa.binary()) for x in Tree.grown(flat, parts).packed()]],
                                          ["ids", "labels", *[f for f, _ in Tree.FIELDS]])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            while batch.num_rows:
                take = batch.slice(0, BLOCK - size)
                batch = batch.slice(take.num_rows)
                held.append(take)
                size += take.num_rows
                if size == BLOCK:
                    yield rows(held)
                    held, size = [], 0
        if size:
            yield rows(held)

    return run


def _trees(batches, parts: int):
    """(row, tree) of every block of some batches."""
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            n = len(row.column(names.index("ids")).flatten())
            yield row, Tree.unpacked([row.column(names.index(f))[0].as_buffer() for f, _ in Tree.FIELDS], n, parts)


def _round(books: np.ndarray):
    def run(batches):
        parts, k, width = books.shape
        near, total, count = EntryTree(books), np.zeros(books.shape, np.int64), np.zeros((parts, k), np.int64)
        for _, tree in _trees(batches, parts):
            _, s, c = assign(tree, near)
            total += s
            count += c
        p, e = np.nonzero(count)
        at = [np.repeat(x, width) for x in (p, e)] + [np.tile(np.arange(width), len(p))]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(x.astype(np.int32)) for x in at], pa.array(total[p, e].ravel()), pa.array(np.repeat(count[p, e], width))],
            ["part", "entry", "at", "s", "n"])

    return run


def _coded(books: np.ndarray):
    def run(batches):
        parts, k, width = books.shape
        near = EntryTree(books)
        for row, tree in _trees(batches, parts):
            codes, _, _ = assign(tree, near)
            apart = tree.points - np.take_along_axis(books, codes[:, :, None], 1)
            dist = (apart * apart).sum(2)
            own, error = np.empty(codes.T.shape, np.uint8), np.zeros(codes.shape[1], np.int64)
            for p in range(parts):
                own[tree.order[p], p] = codes[p]
                error[tree.order[p]] += dist[p]
            hexes = own.tobytes().hex()
            text = [hexes[i:i + 2 * parts] for i in range(0, len(hexes), 2 * parts)]
            names = row.schema.names
            yield pa.RecordBatch.from_arrays(
                [row.column(names.index("ids")).flatten(), row.column(names.index("labels")).flatten(),
                 pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def first_entries(kept: DataFrame, entries: int = ENTRIES) -> list[list[int]]:
    """The vectors of the smallest ids (null ids last, repeated ids by their vectors)."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    return [r["v"] for r in kept.orderBy(*order).limit(entries).select("v").collect()]


def codebooks(trees: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after some rounds, each one aggregate over the trees."""
    for _ in range(rounds):
        sums = trees.mapInArrow(_round(books), "part int, entry int, at int, s bigint, n bigint")
        sums = sums.groupBy("part", "entry", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        books = books.copy()
        for r in sums.collect():  # one row per component of an entry at most
            books[r["part"], r["entry"], r["at"]] = r["s"] // r["n"]
    return books


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: vec_id, label, code, error, label_error, codebooks_sha256.

    Dropped are null vectors, empty ones, those with a null or non-finite
    component (or one of 65,536 and more) and those whose length differs from
    that of the smallest kept id. The length must be a multiple of ``parts``,
    else ``ValueError``. With fewer kept vectors than ``entries`` the codebooks
    have as many entries as there are vectors. Ties go to the lower entry.
    Rows that repeat each give a row; null labels are one label. Other columns
    of the input, whatever their names, are not read. An empty table gives no
    rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code of two hex digits needs 1 to 256 entries")
    kept = kept_vectors(df, id_col, vector_col, label_col)
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    out = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"
    least = first_entries(kept, 1)
    if not least:
        empty = df.sparkSession.createDataFrame([], out)
        return empty.select("*", F.lit(None).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    dims = len(least[0])
    if dims % parts:
        raise ValueError(f"vectors of {dims} components do not make {parts} equal parts")
    kept = kept.where(F.size("v") == dims)
    start = np.array(first_entries(kept, entries), np.int64)
    books = np.ascontiguousarray(start.reshape(len(start), parts, dims // parts).transpose(1, 0, 2))
    blobs = ", ".join(f"{f} binary" for f, _ in Tree.FIELDS)
    trees = materialized(kept.mapInArrow(_grow(parts), f"ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, {blobs}"))
    books = codebooks(trees, books, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = materialized(trees.mapInArrow(_coded(books), out))
    per_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(per_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    def nearest(name: str, book: str) -> str:
        return f"""{name} AS MATERIALIZED (
  SELECT rid, part, any_value(c) AS c, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (
    SELECT x.rid, x.part, x.c, b.entry,
           list_sum(list_transform(range(1, len(x.c) + 1), lambda i: (x.c[i] - b.c[i]) * (x.c[i] - b.c[i])))::BIGINT AS d
    FROM p x JOIN {book} b USING (part)) GROUP BY rid, part)"""

    def moved(name: str, book: str, by: str) -> str:
        return f"""{name}_s AS (
  SELECT part, entry, i, sum(y)::BIGINT AS s, count(*) AS n FROM (
    SELECT part, entry, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS y FROM {by}) GROUP BY part, entry, i),
{name}_m AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM {name}_s GROUP BY part, entry),
{name} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c FROM {book} b LEFT JOIN {name}_m m USING (part, entry))"""

    return f"""WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rid,
         list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT rid, part, v[(part * len(v) // {PARTS} + 1)::BIGINT : ((part + 1) * len(v) // {PARTS})::BIGINT] AS c
  FROM (SELECT rid, v, unnest(range(0, {PARTS})) AS part FROM kept)),
b0 AS (SELECT part, rid - 1 AS entry, c FROM p WHERE rid <= {ENTRIES}),
{nearest("a0", "b0")},
{moved("b1", "b0", "a0")},
{nearest("a1", "b1")},
{moved("b2", "b1", "a1")},
{nearest("a2", "b2")},
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM b2),
done AS (
  SELECT rid, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY rid)
SELECT k.vec_id, k.label, d.code, d.error, (sum(d.error) OVER (PARTITION BY k.label))::BIGINT AS label_error,
       (SELECT h FROM book) AS codebooks_sha256
FROM kept k JOIN done d USING (rid)"""


SQL = _sql()
