"""N-gram Jaccard join with Bayesian candidate pruning.

A text is its set of hashed shingles of ``WORDS`` words. Texts with the same
set are one *text class member* and are compared once. Candidates share a
band of MinHash values. For every candidate pair the MinHash values are
compared a few at a time; a pair is dropped when the posterior probability
that its similarity reaches the threshold falls below ``TOLERANCE``. All
other pairs are verified exactly on the shingle sets.

Large buckets. In a bucket of up to ``BLOCK`` texts all pairs are candidates.
In a larger one every text is paired with the bucket's hub and with its
neighbour in the order of the set names, so the pairs grow with the texts
and not with their square. The hub is the text whose buckets are largest in
sum: of many variants of one text, the one they have most in common with.
What that leaves open is settled exactly afterwards: texts of such a bucket
that did not end up in the class of its hub are compared with all of its
texts in other classes. Classes are therefore those of all pairs that share
a band.

``n_links`` counts all links of a set. Linked sets are of one class, so a
class that has a text in a large bucket is compared whole, all its sets with
all, in tiles inside the tasks: each gives a count per set and never pairs.
The links of other classes are the verified candidate pairs.

Where sets are compared, pairs are dealt into groups by the smallest text of
their buckets, and a group into tiles of bounded total size, so no task gets
an unbounded group.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialized, mix64, range_hashes, text_batches, word_spans

WORDS = 5
THRESHOLD = 0.8
#: MinHash values, values per band (a pair at 0.8 shares no band with probability 1e-5), values compared and at a time
HASHES, ROWS = 512, 8
COMPARED, STEP = 512, 16
TOLERANCE = 1e-6
BLOCK = 32
#: texts of a large bucket that are put in order together
CHAIN = 100_000
#: shingles of the texts of one tile
TILE = 500_000
#: texts of one tile where links are counted
TILE_TEXTS = 2048
#: keys of the texts to compare are broadcast up to this size, else shuffled
MAX_BROADCAST = 64 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_RNG = np.random.default_rng(7)
_MUL = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingles(buf: np.ndarray, offs: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles, sorted by both; a text of fewer words is one shingle."""
    low = _LOWER[buf]
    starts, ends, doc = word_spans(low, offs, _IS_WORD)
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = range_hashes(low, starts, ends)
    at = np.flatnonzero(doc[:-size + 1] == doc[size - 1:]) if len(doc) >= size else np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    n = np.diff(np.append(first, len(doc)))
    short = first[n < size]
    begin = np.concatenate([at, short])
    h = range_hashes(words, begin, np.concatenate([at + size, short + n[n < size]]))
    d = doc[begin]
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])
    return d[new], h[new]


def minhash(h: np.ndarray, first: np.ndarray, count: int = HASHES) -> np.ndarray:
    """MinHash values (a row per set) of sets that lie one after another in ``h``."""
    out = np.empty((len(first), count), np.uint32)
    for k in range(count):
        out[:, k] = np.minimum.reduceat(((h * _MUL[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), first)
    return out


def _sketch(batches):
    """(doc_id, key, sid, n, bands) per document; sid names the set, null without words."""
    for part, buf, offs in text_batches(batches, "text"):
        rows = part.num_rows
        doc, h = shingles(buf, offs)
        col = [part.column(part.schema.get_field_index(c)) for c in ("doc_id", "key")]
        sid, n, bands = np.zeros(rows, np.int64), np.zeros(rows, np.int64), [None] * rows
        has = np.zeros(rows, bool)
        if len(doc):
            first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            own, last = doc[first], np.append(first[1:], len(doc))
            has[own], n[own] = True, last - first
            sid[own] = range_hashes(h, first, last).view(np.int64)
            sig = minhash(h, first).astype(np.uint64)
            key = np.zeros((len(own), HASHES // ROWS), np.uint64)
            for r in range(ROWS):
                key = mix64(key * np.uint64(31) + sig[:, r::ROWS] + np.uint64(1))
            key = mix64(key + np.arange(HASHES // ROWS, dtype=np.uint64)).view(np.int64)
            for i, d in enumerate(own.tolist()):
                bands[d] = key[i]
        yield pa.RecordBatch.from_arrays(
            [*col, pa.array(sid, pa.int64(), mask=~has), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "key", "sid", "n", "bands"])


def _sets(batches):
    """(sid, shingle set) of each text."""
    for part, buf, offs in text_batches(batches, "text"):
        doc, h = shingles(buf, offs)
        cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
        packed = [h[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("sid")), pa.array(packed, pa.binary())],
                                         ["sid", "shingles"])


@lru_cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each count of compared values, the matches below which a pair is dropped.

    With a uniform prior, the similarity's posterior after ``m`` of ``n``
    matches is Beta(m + 1, n - m + 1); its mass from the threshold up is
    integrated numerically.
    """
    x = (np.arange(4_000) + 0.5) / 4_000
    log_x, log_y, above = np.log(x), np.log1p(-x), x >= threshold

    def likely(m: int, n: int) -> bool:
        log = m * log_x + (n - m) * log_y
        mass = np.exp(log - log.max())
        return mass[above].sum() >= tolerance * mass.sum()

    return tuple(bisect_left(range(n), True, key=lambda m: likely(m, n)) for n in range(STEP, COMPARED + 1, STEP))


class Sets:
    """Shingle sets of some texts, with the MinHash values to compare."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(x) for x in sets])
        self.sets, self.sig = sets, minhash(np.concatenate(sets), np.cumsum(sizes) - sizes, COMPARED)

    def similar(self, a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs (numbers of two sets) reach the threshold, and their similarities.

        MinHash values are compared ``STEP`` at a time; a pair is dropped as
        soon as its posterior chance is below the tolerance. The rest is
        verified on the sets.
        """
        alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
        for at, least in zip(range(0, COMPARED, STEP), least_matches(threshold, tolerance)):
            matches += (self.sig[a[alive], at:at + STEP] == self.sig[b[alive], at:at + STEP]).sum(1, dtype=np.int32)
            keep = matches >= least
            alive, matches = alive[keep], matches[keep]
        found, value = [], []
        for i in alive.tolist():
            x, y = self.sets[a[i]], self.sets[b[i]]
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            j = common / (len(x) + len(y) - common)
            if j >= threshold:
                found.append(i)
                value.append(j)
        return np.array(found, np.int64), np.array(value, np.float64)


def _loaded(texts: pa.Table) -> tuple[np.ndarray, Sets]:
    """Distinct set names in order, and their sets."""
    sid, first = np.unique(texts["sid"].to_numpy(), return_index=True)
    packed = texts["shingles"].combine_chunks()
    return sid, Sets([np.frombuffer(packed[int(i)].as_buffer(), np.uint64) for i in first])


def _links(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(value, pa.float64())})


LINKS = "a bigint, b bigint, similarity double"


def _verify(pairs: pa.Table, texts: pa.Table, threshold: float, tolerance: float) -> pa.Table:
    if not pairs.num_rows or not texts.num_rows:
        return _links([], [], [])
    sid, sets = _loaded(texts)
    a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
    hit, value = sets.similar(np.searchsorted(sid, a), np.searchsorted(sid, b), threshold, tolerance)
    return _links(a[hit], b[hit], value)


def _compare_all(members: pa.Table, strays: pa.Table, threshold: float, tolerance: float) -> pa.Table:
    """Links between strays and members of other classes, a few strays at a time."""
    if not members.num_rows or not strays.num_rows:
        return _links([], [], [])
    sid, sets = _loaded(pa.concat_tables([t.select(["sid", "shingles"]) for t in (members, strays.rename_columns(members.column_names))]))
    own, of = np.unique(members["sid"].to_numpy(), return_index=True)
    own_class, own_at = members["class"].to_numpy()[of], np.searchsorted(sid, own)
    out = []
    names, classes = strays[0].to_numpy(), strays[1].to_numpy()
    for start in range(0, len(names), 64):
        x, y = np.nonzero(classes[start:start + 64, None] != own_class[None, :])
        x += start
        hit, value = sets.similar(np.searchsorted(sid, names[x]), own_at[y], threshold, tolerance)
        u, v = names[x[hit]], own[y[hit]]
        out.append((np.minimum(u, v), np.maximum(u, v), value))
    return _links(*(np.concatenate(c) for c in zip(*out)))


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``.

    Elements that many sets hold are multiplied as matrices, the others are
    added one by one.
    """
    na, nb = len(a), len(b)
    size_a, size_b = (np.array([len(x) for x in s]) for s in (a, b))
    _, col = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    n = int(col.max()) + 1
    col_a, col_b = col[:size_a.sum()], col[size_a.sum():]
    row_a, row_b = np.repeat(np.arange(na), size_a), np.repeat(np.arange(nb), size_b)
    seen_a, seen_b = np.bincount(col_a, minlength=n), np.bincount(col_b, minlength=n)
    weight = seen_a * seen_b
    dense = weight * 64 >= na * nb
    out = np.zeros((na, nb), np.float32)
    number = np.cumsum(dense) - 1
    for start in range(0, int(dense.sum()), 1024):
        both = []
        for rows, row, c in ((na, row_a, col_a), (nb, row_b, col_b)):
            own = dense[c] & (number[c] >= start) & (number[c] < start + 1024)
            m = np.zeros((rows, 1024), np.float32)
            m[row[own], number[c[own]] - start] = 1
            both.append(m)
        out += both[0] @ both[1].T
    rare = np.flatnonzero(~dense[col_a] & (weight[col_a] > 0))
    order = np.argsort(col_b, kind="stable")
    first, times = np.cumsum(seen_b) - seen_b, seen_b[col_a[rare]]
    piece = (np.cumsum(times) - times) >> 20
    flat = out.ravel()
    for part in np.split(np.arange(len(rare)), np.flatnonzero(np.diff(piece)) + 1) if len(rare) else []:
        t, c = times[part], col_a[rare[part]]
        step = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        np.add.at(flat, np.repeat(row_a[rare[part]], t) * nb + row_b[order[np.repeat(first[c], t) + step]], np.float32(1))
    return out


def _count_links(tile: pa.Table, threshold: float) -> pa.Table:
    """(sid, n_links) of the texts of two tiles of a class, or of one compared with itself."""
    packed, right = tile["shingles"].combine_chunks(), tile["right"].to_numpy()
    sid = tile["sid"].to_numpy()
    sets = [np.frombuffer(packed[i].as_buffer(), np.uint64) for i in range(len(sid))]
    x = np.flatnonzero(~right)
    alone = tile["i"][0].as_py() == tile["j"][0].as_py()
    y = x if alone else np.flatnonzero(right)
    if not len(x) or not len(y):
        return pa.table({"sid": pa.array([], pa.int64()), "n_links": pa.array([], pa.int64())})
    common = common_counts([sets[i] for i in x], [sets[i] for i in y]).astype(np.float64)
    size = np.array([len(s) for s in sets], np.float64)
    hit = common / (size[x][:, None] + size[y][None, :] - common) >= threshold
    if alone:
        np.fill_diagonal(hit, False)
        return pa.table({"sid": pa.array(sid[x]), "n_links": pa.array(hit.sum(1), pa.int64())})
    return pa.table({"sid": pa.array(np.concatenate([sid[x], sid[y]])),
                     "n_links": pa.array(np.concatenate([hit.sum(1), hit.sum(0)]), pa.int64())})


def buckets(texts: DataFrame) -> DataFrame:
    """(band, sid, n, hub): the texts of every bucket of at least two, its size and its hub."""
    rows = texts.select("sid", F.explode("bands").alias("band"))
    size = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialized(rows.join(size, "band"))
    weighed = shared.join(shared.groupBy("sid").agg(F.sum("n").alias("mass")), "sid")
    hubs = weighed.groupBy("band").agg(F.max(F.struct("mass", "sid"))["sid"].alias("hub"))
    return shared.join(hubs, "band")


def candidates(bucketed: DataFrame) -> DataFrame:
    """(a, b, g): distinct candidate pairs, a < b, and the smallest hub of their buckets."""
    small, large = bucketed.where(F.col("n") <= BLOCK), bucketed.where(F.col("n") > BLOCK)
    whole = small.groupBy("band", "hub").agg(F.sort_array(F.collect_list("sid")).alias("m"))  # at most BLOCK texts
    pairs = whole.select("hub", "m", F.posexplode(F.expr("slice(m, 1, size(m) - 1)")).alias("i", "a"))
    pairs = pairs.select("a", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("b"), "hub")
    part = F.pmod(F.shiftright("sid", 32), F.ceil(F.col("n") / CHAIN).cast("bigint"))
    order = Window.partitionBy("band", "part").orderBy("sid")
    chain = large.withColumn("part", part).withColumn("before", F.lag("sid").over(order)).where("before IS NOT NULL")
    chain = chain.select(F.col("before").alias("a"), F.col("sid").alias("b"), "hub")
    star = large.where(F.col("sid") != F.col("hub")).select(
        F.least("hub", "sid").alias("a"), F.greatest("hub", "sid").alias("b"), "hub")
    return pairs.unionByName(chain).unionByName(star).groupBy("a", "b").agg(F.min("hub").alias("g"))


def _shingle_sets(need: DataFrame, texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(sid, shingles) of the texts named in ``need``, from one row of each."""
    wanted = materialized(need.select("sid").distinct().join(texts.select("sid", "key"), "sid"))
    if wanted.count() * 24 <= MAX_BROADCAST:
        wanted = F.broadcast(wanted)
    return rows.join(wanted, "key").select("sid", "text").mapInArrow(_sets, "sid bigint, shingles binary")


def verified(pairs: DataFrame, texts: DataFrame, rows: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(a, b, similarity): the pairs that reach the threshold, compared on their sets."""
    both = pairs.select("g", F.col("a").alias("sid")).union(pairs.select("g", "b")).distinct()
    sized = both.join(texts.select("sid", "n"), "sid")
    tiles = sized.groupBy("g").agg(F.ceil(F.sum("n") / TILE).cast("bigint").alias("t"))
    def tile(c: str) -> Column:
        return F.pmod(F.xxhash64(c, F.lit("tile")), F.col("t"))
    dealt = pairs.join(tiles, "g").select("a", "b", "g", F.least(tile("a"), tile("b")).alias("i"),
                                          F.greatest(tile("a"), tile("b")).alias("j"))
    dealt = materialized(dealt)  # read for the pairs and for the texts they need
    need = dealt.select("g", "i", "j", F.col("a").alias("sid")).union(dealt.select("g", "i", "j", "b")).distinct()
    shipped = need.join(_shingle_sets(need, texts, rows), "sid")
    shipped = shipped.toDF("sid", "to_g", "to_i", "to_j", "shingles")  # other names: both sides descend from the pairs
    return (dealt.groupBy("g", "i", "j").cogroup(shipped.groupBy("to_g", "to_i", "to_j"))
            .applyInArrow(lambda p, t: _verify(p, t, threshold, tolerance), LINKS))


def components(edges: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """(sid, class): each vertex's smallest connected vertex, by alternating large and small stars.

    Every round is a pair of grouped minima over the edges, written to the
    shared folder; rounds grow with the logarithm of the longest path.
    """
    e = materialized(edges.select(F.greatest(u, v).alias("x"), F.least(u, v).alias("y")).distinct())

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y")), F.bit_xor(F.xxhash64("y", "x"))).first())

    now = mark(e)
    while True:
        near = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = near.groupBy("x").agg(F.least(F.min("y"), F.min("x")).alias("m"))
        large = near.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        large = large.distinct()
        down = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(down, "x")
        small = small.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(
            down.select("x", F.col("m").alias("y"))).where("x <> y").distinct()
        after = materialized(small)
        was, e = now, after
        now = mark(e)
        if now == was:
            return e.select(F.col("x").alias("sid"), F.col("y").alias("class")).unionByName(
                e.select(F.col("y").alias("sid"), F.col("y").alias("class")).distinct())


def _left_open(bucketed: DataFrame, classes: DataFrame, texts: DataFrame, rows: DataFrame, threshold: float,
               tolerance: float) -> DataFrame | None:
    """Links that the hubs of large buckets left open, or None where all their texts are in the hub's class.

    The texts of the large buckets of one class are compared with the strays
    among them: those of another class. Both are dealt into tiles of bounded
    size and compared inside the tasks, so pairs are never rows.
    """
    large = bucketed.where(F.col("n") > BLOCK).select("sid", "hub").distinct()
    hubs = classes.select(F.col("sid").alias("hub"), F.col("class").alias("g"))
    known = large.join(classes, "sid", "left").withColumn("class", F.coalesce("class", "sid"))
    known = known.join(hubs, "hub", "left").select("sid", "class", F.coalesce("g", "hub").alias("g")).distinct()
    known = materialized(known.join(texts.select("sid", "n"), "sid"))
    strays = known.where(F.col("class") != F.col("g"))
    if strays.isEmpty():
        return None
    tiles = known.groupBy("g").agg(F.ceil(F.sum("n") / TILE).cast("bigint").alias("t"))
    tile = F.pmod(F.xxhash64("sid", F.lit("tile")), F.col("t"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("t") - 1))
    open_ = known.join(strays.select("g").distinct(), "g", "left_semi").join(tiles, "g")
    members = open_.select("g", "sid", "class", tile.alias("j"), every.alias("i"))
    lost = open_.where(F.col("class") != F.col("g")).select("g", "sid", "class", tile.alias("i"), every.alias("j"))
    sets = materialized(_shingle_sets(open_, texts, rows))
    left = members.join(sets, "sid").select("sid", "class", "shingles", "g", "i", "j")
    right = lost.join(sets, "sid").select("sid", "class", "shingles", "g", "i", "j").toDF(
        "stray", "stray_class", "stray_shingles", "to_g", "to_i", "to_j")
    return (left.groupBy("g", "i", "j").cogroup(right.groupBy("to_g", "to_i", "to_j"))
            .applyInArrow(lambda m, x: _compare_all(m, x, threshold, tolerance), LINKS))


def link_counts(links: DataFrame, classes: DataFrame, bucketed: DataFrame, texts: DataFrame, rows: DataFrame,
                threshold: float = THRESHOLD) -> DataFrame:
    """(sid, n_links): the number of sets that each linked set is similar to.

    Classes with a text in a large bucket are compared whole, in pairs of
    tiles of bounded size; the links of the others are all among ``links``.
    """
    ends = links.select(F.col("a").alias("sid")).union(links.select("b"))
    large = bucketed.where(F.col("n") > BLOCK).select("sid").distinct()
    if large.isEmpty():
        return ends.groupBy("sid").agg(F.count(F.lit(1)).alias("n_links"))
    wide = classes.join(large, "sid", "left_semi").select("class").distinct()
    whole = materialized(classes.join(wide, "class").join(texts.select("sid", "n"), "sid"))
    few = ends.join(whole.select("sid"), "sid", "left_anti").groupBy("sid").agg(F.count(F.lit(1)).alias("n_links"))
    tiles = whole.groupBy("class").agg(F.ceil(F.greatest(F.sum("n") / (2 * TILE), F.count(F.lit(1)) / TILE_TEXTS))
                                       .cast("bigint").alias("t"))
    own = whole.join(tiles, "class").withColumn("own", F.pmod(F.xxhash64("sid", F.lit("tile")), F.col("t")))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("t") - 1))).select(
        "sid", "class", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).alias("right"))
    many = (dealt.join(_shingle_sets(whole, texts, rows), "sid").groupBy("class", "i", "j")
            .applyInArrow(lambda t: _count_links(t, threshold), "sid bigint, n_links bigint"))
    return few.unionByName(many.groupBy("sid").agg(F.sum("n_links").alias("n_links")))


def similarity_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                    tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """(members, links): documents with the id of their shingle set, and the verified links between sets.

    members: doc_id, key, sid (null for texts without words), n. links: a, b,
    similarity; not all that a class with a text in a large bucket has, but
    enough to connect it. Both are written once to the shared folder.
    """
    return _joined(docs, id_col, text_col, threshold, tolerance)[:2]


def _joined(docs: DataFrame, id_col: str, text_col: str, threshold: float, tolerance: float) -> tuple[DataFrame, ...]:
    """(members, links, bucketed, texts, rows) of ``similarity_join``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn(
        "key", F.xxhash64("doc_id", "text"))
    kind = docs.schema[id_col].dataType.simpleString()
    members = materialized(rows.mapInArrow(_sketch, f"doc_id {kind}, key bigint, sid bigint, n bigint, bands array<bigint>"))
    texts = (members.where(F.col("sid").isNotNull())
             .groupBy("sid").agg(F.min("key").alias("key"), F.min("n").alias("n"), F.min("bands").alias("bands")))
    bucketed = materialized(buckets(texts))
    texts = members.where(F.col("sid").isNotNull()).groupBy("sid").agg(F.min("key").alias("key"), F.min("n").alias("n"))
    pairs = materialized(candidates(bucketed))
    links = materialized(verified(pairs, texts, rows, threshold, tolerance))
    if not bucketed.where(F.col("n") > BLOCK).isEmpty():
        rest = _left_open(bucketed, components(links), texts, rows, threshold, tolerance)
        if rest is not None:
            links = materialized(links.unionByName(rest).groupBy("a", "b").agg(F.max("similarity").alias("similarity")))
    return members.select("doc_id", "key", "sid", "n"), links, bucketed, texts, rows


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                 tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: doc_id, key, class, class_id, class_size, n_links, n_shingles.

    ``class_id`` is the smallest doc_id of the class (linked texts and their
    copies); a document alone is its own class. ``n_links`` counts different
    shingle sets. Null, empty and wordless texts have no shingles and stay alone;
    rows that repeat are copies of each other. An empty table gives no rows.
    """
    members, links, bucketed, texts, rows = _joined(docs, id_col, text_col, threshold, tolerance)
    found = materialized(components(links))
    counts = link_counts(links, found, bucketed, texts, rows, threshold)
    return _classed(members, found.join(counts, "sid", "left"))


def _classed(members: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``near_classes`` from (sid, class, n_links) of the linked sets."""
    worded = members.where(F.col("sid").isNotNull()).join(known, "sid", "left")
    worded = worded.withColumn("class", F.coalesce("class", "sid"))
    classes = worded.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    out = worded.join(classes, "class").select("doc_id", "key", "class", "class_id", "class_size",
                                               F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
                                               F.col("n").alias("n_shingles"))
    alone = members.where(F.col("sid").isNull()).select(
        "doc_id", "key", F.lit(None).cast("bigint").alias("class"), F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"),
        F.lit(0).cast("bigint").alias("n_links"), F.col("n").alias("n_shingles"))
    return out.unionByName(alone)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The document with the smallest id of every class, with all columns; of rows that repeat it, one."""
    members, links = similarity_join(docs, id_col, text_col, threshold)
    found = materialized(_classed(members, components(links).withColumn("n_links", F.lit(None).cast("bigint"))))
    many = found.where(F.col("class_size") > 1)
    stays = many.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class").agg(F.min("key").alias("key"))
    mark = many.select("key").distinct().join(stays.select("key", F.lit(True).alias("_stays")), "key", "left").select(
        F.col("key").alias("_mark"), F.coalesce("_stays", F.lit(False)).alias("_stays"))
    x = docs.withColumn("_key", F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))))
    x = x.join(mark, x["_key"] == mark["_mark"], "left").where(F.coalesce("_stays", F.lit(True)))
    again = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))  # the join's own partitioning
    return x.withColumn("_n", again).where(F.col("_stays").isNull() | (F.col("_n") == 1)).select(docs.columns)
