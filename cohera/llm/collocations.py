"""Phrase collocation mining by multikey quicksort of suffix pointers.

Texts are cut into pieces and words; a phrase is 2 to 5 words of one piece,
counted per language. A suffix is the piece from one of its words on, read to
five words. Suffixes with the same leading words are brought to one task,
which sorts pointers to them by three-way partitioning on one word at a time:
the suffixes equal to the pivot share one word more, and their number is that
phrase's count. A partition that holds fewer suffixes than the least count is
abandoned: nothing below it can be frequent.

Abandoning starts before suffixes move. Words and then leading pairs are
counted over the whole corpus (each task folds its own first), and a suffix
ends where its next pair is infrequent. Suffixes are routed by language and
leading pair; those of a pair with more than ``HOT`` occurrences are routed by
all their words, and their prefixes are summed by Spark instead.

While counting, a word of a language stands for a 64-bit hash. That no two
share one is checked over the whole corpus by a second, independent hash; if
some do, both are taken anew. Pairs are named by a hash only to leave suffixes
out and to route them: equal names of two pairs cost work, never a count. The
names of frequent words and pairs go to the tasks while they number at most
``MAX_KEYS`` (words are then numbered, and suffixes packed in four bytes a
word); beyond, suffixes are left whole and carry the names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, materialized, mix64, powers, text_batches, word_spans

LONGEST = 5
LEAST = 100
TOP = 2000
#: suffixes of one task's group; pairs beyond are hot
HOT = 500_000
#: suffixes that a task folds before it packs them
HELD = 1 << 20
#: hot pairs at most
MAX_HOT = 1 << 20
#: names (8 bytes each) sent to the tasks
MAX_KEYS = 4 << 20
#: parts in which the best phrases of a language are chosen first
PARTS = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# fixed values: the bytes that end a piece, and those between words
_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_IS_WORD = ~_IS_BREAK
_IS_WORD[[0x20, 0x09]] = False
_LANG = np.uint64(0xC2B2AE3D27D4EB4F)


def _hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A polynomial hash per range; the seed chooses the base."""
    base = (BASE + 0x51ED270B * 8 * seed) & ((1 << 64) - 1)
    pre = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=pre[1:])
    return mix64((pre[ends] - pre[starts]) * powers(pow(base, -1, 1 << 64), len(values) + 1)[starts]
                 + (ends - starts).astype(np.uint64) * _LANG)


class _Piece:
    """The words of some texts: their names (of word and language), and which are followed by another in their piece."""

    def __init__(self, part: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray, seed: int):
        self.low = _LOWER[buf]
        self.starts, self.ends, doc = word_spans(self.low, offs, _IS_WORD)
        piece = np.cumsum(_IS_BREAK[self.low], dtype=np.int32)[self.starts]
        self.goes_on = np.zeros(len(doc), bool)
        self.goes_on[:-1] = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
        langs = part.column(part.schema.get_field_index("lang")).dictionary_encode()
        self.names = langs.dictionary
        self.lang = langs.indices.to_numpy()[doc]
        self.lang_key = part.column(part.schema.get_field_index("lang_key")).to_numpy().view(np.uint64)[doc]
        self.word = np.maximum(mix64(_hashes(self.low, self.starts, self.ends, seed) + self.lang_key * _LANG), np.uint64(1))
        self.pair = np.zeros(len(doc), np.uint64)
        self.pair[:-1] = mix64(self.word[:-1] * np.uint64(31) + self.word[1:])


def _among(keys: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    """Which keys are in the sorted array ``known``; all where it is None."""
    if known is None:
        return np.ones(len(keys), bool)
    if not len(known):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys


def _pieces(batches, seed: int):
    for part, buf, offs in text_batches(batches, "text"):
        p = _Piece(part, buf, offs, seed)
        if len(p.word):
            yield p


def _word_counts(seed: int):
    """(lang, key, check, n) of each batch; words that share a key are both given."""
    def run(batches):
        for p in _pieces(batches, seed):
            key, first, at, n = np.unique(p.word, return_index=True, return_inverse=True, return_counts=True)
            other = _hashes(p.low, p.starts, p.ends, seed + 1) ^ p.lang_key * _LANG
            clash = np.flatnonzero(other != other[first][at])
            pick, n = np.concatenate([first, clash]), np.concatenate([n, np.zeros(len(clash), n.dtype)])
            yield pa.RecordBatch.from_arrays(
                [p.names.take(pa.array(p.lang[pick])), pa.array(p.word[pick].view(np.int64)),
                 pa.array(other[pick].view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "key", "check", "n"])

    return run


def _pair_counts(seed: int, words: np.ndarray | None):
    def run(batches):
        for p in _pieces(batches, seed):
            known = _among(p.word, words)
            at = np.flatnonzero(p.goes_on[:-1] & known[:-1] & known[1:])
            key, n = np.unique(p.pair[at], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return run


def _cut_suffixes(p: _Piece, pairs: np.ndarray | None, words: np.ndarray | None):
    """(keys, leading pairs, word numbers): a row of ``LONGEST`` keys per suffix, zeros where it ends.

    A key is the word's place in ``words``, counted from 1, or its name where ``words`` is None.
    """
    known = _among(p.word, words)  # also where another pair's name let an infrequent word in
    more = p.goes_on & _among(p.pair, pairs) & known
    more[:-1] &= known[1:]
    at = np.flatnonzero(more)
    own = p.word if words is None else (np.searchsorted(words, p.word) + 1).astype(np.uint32)
    w = np.zeros((len(at), LONGEST), own.dtype)
    w[:, 0] = own[at]
    live = np.ones(len(at), bool)
    for d in range(1, LONGEST):
        live &= (at + d < len(own)) & more[np.minimum(at + d - 1, len(own) - 1)]
        w[:, d] = np.where(live, own[np.minimum(at + d, len(own) - 1)], 0)
    used = more.copy()
    used[1:] |= more[:-1]
    return w, p.pair[at], np.flatnonzero(used)


PACKED = "bin int, keys binary, n binary, names binary, words string"


def _suffixes(seed: int, pairs: np.ndarray | None, words: np.ndarray | None, hot: np.ndarray | None, bins: int):
    """The different suffixes of about ``HELD`` at a time, packed per bin; those of hot pairs are in bin -1.

    ``keys`` holds the suffixes by column, ``n`` their numbers; ``names`` and
    ``words`` tell the words that occur in them, dealt by name.
    """
    def pack(held, named):
        w, pair = (np.concatenate(x) for x in zip(*held))
        turn = np.lexsort(w.T[::-1])
        w, pair = w[turn], pair[turn]
        first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]).any(1)]))
        n = np.diff(np.append(first, len(w))).astype(np.int32)
        w, where = w[first], (mix64(pair[first]) % np.uint64(bins)).astype(np.int64)
        where[_among(pair[first], hot) if hot is not None else np.zeros(len(where), bool)] = -1
        names = np.array(sorted(named), np.uint64)
        home = (mix64(names) % np.uint64(bins)).astype(np.int64)
        turn, by = np.argsort(where, kind="stable"), np.argsort(home, kind="stable")
        where, home, w, n, names = where[turn], home[by], w[turn], n[turn], names[by]
        out = []
        for b in np.union1d(where, home).tolist():
            x, y = slice(*np.searchsorted(where, [b, b + 1])), slice(*np.searchsorted(home, [b, b + 1]))
            out.append((b, w[x].T.tobytes(), n[x].tobytes(), names[y].tobytes(), " ".join(named[k] for k in names[y].tolist())))
        cols = list(zip(*out))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["bin", "keys", "n", "names", "words"])

    def run(batches):
        held, named, size = [], {}, 0
        for p in _pieces(batches, seed):
            w, pair, used = _cut_suffixes(p, pairs, words)
            if not len(w):
                continue
            held.append((w, pair))
            size += len(w)
            names, first = np.unique(p.word[used], return_index=True)
            for k, i in zip(names.tolist(), used[first].tolist()):
                if k not in named:
                    named[k] = p.low[p.starts[i]:p.ends[i]].tobytes().decode("utf-8", "replace")
            if size >= HELD:
                yield pack(held, named)
                held, named, size = [], {}, 0
        if size:
            yield pack(held, named)

    return run


def multikey_counts(keys: np.ndarray, weights: np.ndarray, least: int, shortest: int) -> list[tuple[int, int, int]]:
    """(row, length, count) of every prefix of the rows of ``keys`` with at least ``least`` occurrences.

    Three-way partitioning of pointers, one column at a time, to the last
    column; zero ends a row. A partition below ``least`` is abandoned.
    ``row`` is some row that has the prefix; prefixes of fewer than
    ``shortest`` columns are not given.
    """
    found, stack = [], [(np.arange(len(keys)), 0)]
    while stack:
        rows, depth = stack.pop()
        if weights[rows].sum() < least:
            continue
        col = keys[rows, depth]
        pivot = col[len(col) // 2]
        same = col == pivot
        below = col < pivot
        for side in (below, ~(same | below)):
            if side.any():
                stack.append((rows[side], depth))
        rows = rows[same]
        count = int(weights[rows].sum())
        if pivot == 0 or count < least:
            continue
        if depth + 1 >= shortest:
            found.append((int(rows[0]), depth + 1, count))
        if depth + 1 < keys.shape[1]:
            stack.append((rows, depth + 1))
    return found


def _unpacked(keys: list, n: list, words: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    kind = np.uint64 if words is None else np.uint32
    w = [np.frombuffer(x, kind).reshape(LONGEST, -1).T for x in keys]
    return np.concatenate(w), np.concatenate([np.frombuffer(x, np.int32) for x in n])


def _named(keys: np.ndarray, words: np.ndarray | None) -> np.ndarray:
    """The names of a suffix's words, without the zeros behind it."""
    keys = keys[keys != 0]
    return (keys if words is None else words[keys.astype(np.int64) - 1]).view(np.int64)


def _mined(least: int, words: np.ndarray | None):
    """(p, f, word): the frequent phrases of a bin, and with ``word`` the words dealt to it."""
    def run(table: pa.Table) -> pa.Table:
        keys, n = _unpacked([x.as_buffer() for c in table["keys"].chunks for x in c],
                            [x.as_buffer() for c in table["n"].chunks for x in c], words)
        found = multikey_counts(keys, n, least, 2)
        texts = {}
        for names, text in zip(table["names"], table["words"]):
            texts.update(zip(np.frombuffer(names.as_buffer(), np.int64).tolist(), text.as_py().split(" ")))
        p = [_named(keys[r, :m], words).tolist() for r, m, _ in found] + [[k] for k in texts]
        return pa.table({"p": pa.array(p, pa.list_(pa.int64())), "f": pa.array([c for _, _, c in found] + [0] * len(texts), pa.int64()),
                         "word": pa.array([None] * len(found) + list(texts.values()), pa.string())})

    return run


def _whole(words: np.ndarray | None):
    """(w, n): packed suffixes as rows."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys, n = _unpacked([batch.column(0)[i].as_buffer()], [batch.column(1)[i].as_buffer()], words)
                yield pa.RecordBatch.from_arrays([pa.array([_named(k, words).tolist() for k in keys], pa.list_(pa.int64())),
                                                  pa.array(n.astype(np.int64))], ["w", "n"])

    return run


def _keys(df: DataFrame) -> np.ndarray | None:
    """The sorted names in column ``key``, or None where there are too many to send."""
    if df.count() > MAX_KEYS:
        return None
    return np.sort(df.select("key").toArrow()["key"].to_numpy().view(np.uint64))


def _counted_words(rows: DataFrame) -> tuple[DataFrame, int]:
    """(lang, key, n) of the corpus, and the hash seed under which no two words share ``key``."""
    for seed in range(8):
        words = rows.mapInArrow(_word_counts(seed), "lang string, key bigint, check bigint, n bigint")
        words = materialized(words.groupBy("lang", "key", "check").agg(F.sum("n").alias("n")))
        shared = words.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        if shared.isEmpty():
            return words.drop("check"), seed
    raise RuntimeError("words that share their hash under every seed")


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> tuple[DataFrame, ...]:
    """(phrases, words, totals): counts per language.

    phrases: (p, f) with ``p`` the names of 1 to 5 words and f at least
    ``least``. words: (key, word) of all words in phrases of two and more.
    totals: (key, lang, n), the occurrences of all words in a frequent word's language.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("lang_key", F.xxhash64("lang"))
    counted, seed = _counted_words(rows)
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    single = counted.where(F.col("n") >= least)
    words = _keys(single)
    pairs = rows.mapInArrow(_pair_counts(seed, words), "key bigint, n bigint")
    pairs = materialized(pairs.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = _keys(pairs.where(F.col("n") > max(HOT, total // MAX_HOT)))
    packed = rows.mapInArrow(_suffixes(seed, _keys(pairs), words, hot, max(1, -(-total // HOT))), PACKED)
    any_hot = hot is not None and len(hot)
    if any_hot:
        packed = materialized(packed)  # read for the bins and for the hot pairs
    mined = packed.where(F.col("bin") >= 0).groupBy("bin").applyInArrow(
        _mined(least, words), "p array<bigint>, f bigint, word string")
    found = materialized(mined)
    phrases = found.where(F.col("word").isNull()).select("p", "f").unionByName(single.select(F.array("key").alias("p"), F.col("n").alias("f")))
    if any_hot:
        spread = packed.where("bin = -1").select("keys", "n").mapInArrow(_whole(words), "w array<bigint>, n bigint")
        spread = spread.groupBy("w").agg(F.sum("n").alias("n")).select(
            F.explode(F.transform(F.sequence(F.lit(2), F.size("w")), lambda m: F.slice("w", 1, m))).alias("p"), "n")
        phrases = phrases.unionByName(spread.groupBy("p").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
    names = found.where(F.col("word").isNotNull()).select(F.element_at("p", 1).alias("key"), "word").distinct()
    return phrases, names, single.join(totals, "lang").select("key", "lang", F.col("total").alias("n"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP
                 ) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases.

    A candidate is a phrase of 2 to 5 words with ``a >= least``. Its score is
    ``floor(1000 a n / (l r))`` at the cut where that is lowest (of equals the
    earliest). Left out are candidates that some longer candidate holds at
    least as often: a longer phrase is never more frequent than one it holds,
    so it is enough to look at those one word longer. Ranked by score, a and
    phrase.

    Null texts are empty, a null language is ``und``; rows that repeat count
    each time. Texts of any length are read whole; other columns of the input,
    whatever their names, are not read. An empty table gives no rows.
    """
    phrases, words, totals = phrase_counts(docs, text_col, lang_col, least)
    phrases = materialized(phrases)
    cands = phrases.where(F.size("p") >= 2).withColumnRenamed("f", "a")
    sub = phrases.where(F.size("p") < LONGEST)
    cuts = cands.select("p", "a", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.select("p", "a", "k", F.slice("p", F.lit(1), F.col("k")).alias("lp"),
                       F.slice("p", F.col("k") + 1, F.size("p") - F.col("k")).alias("rp"))
    cuts = cuts.join(sub.select(F.col("p").alias("lp"), F.col("f").alias("l")), "lp")
    cuts = cuts.join(sub.select(F.col("p").alias("rp"), F.col("f").alias("r")), "rp")
    cuts = cuts.withColumn("key", F.element_at("p", 1)).join(totals, "key").drop("key")
    big = lambda c: F.col(c).cast("decimal(15,0)")  # noqa: E731  products of up to 36 digits
    cuts = cuts.withColumn("up", F.lit(1000).cast("decimal(4,0)") * (big("a") * big("n"))).withColumn("down", big("l") * big("r"))
    best = cuts.groupBy("lang", "p").agg(F.min(F.struct(F.expr("up div down").alias("score"), "k", "a", "l", "r", "n")).alias("b"))
    best = best.select("lang", "p", "b.*").drop("k")
    inner = cands.where(F.size("p") > 2).select(F.explode(F.array(
        F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1))).alias("p"), F.col("a").alias("f"))
    inner = inner.groupBy("p").agg(F.max("f").alias("f"))
    best = best.join(inner, "p", "left").where(F.col("f").isNull() | (100 * F.col("f") < 100 * F.col("a"))).drop("f")
    named = best.select("*", F.posexplode("p").alias("i", "key")).join(words, "key")
    named = named.groupBy("lang", "p", "score", "a", "l", "r", "n").agg(
        F.sort_array(F.collect_list(F.struct("i", "word"))).alias("w"))  # at most five
    named = named.withColumn("phrase", F.array_join(F.transform("w", lambda x: x["word"]), " "))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    named = named.withColumn("part", F.pmod(F.xxhash64("p"), F.lit(PARTS)))
    some = named.withColumn("i", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("i") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return some.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = rf"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x
  FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
ws AS MATERIALIZED (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
g AS (
  SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase, k
  FROM ws, (SELECT unnest(range(1, {LONGEST + 1})) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k >= 2 AND f >= {LEAST}),
cut AS (
  SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j + 1:k], ' ') AS rp
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
scored AS (
  SELECT cut.lang, cut.phrase, cut.a, j, l.f AS l, r.f AS r, n.n,
         ((1000::HUGEINT * cut.a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = cut.lp JOIN f r ON r.lang = cut.lang AND r.phrase = cut.rp
  JOIN n ON n.lang = cut.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c b ON b.lang = s.lang AND b.k > s.k
    AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * b.a >= 100 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best ANTI JOIN inside USING (lang, phrase)
QUALIFY rank <= {TOP}
"""
