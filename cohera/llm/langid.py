"""Language ID: a linear-chain conditional random field over words.

Each word (a run of ASCII letters and bytes beyond ASCII) gets features:
prefixes and suffixes of one to four bytes, all byte trigrams, and a lexicon
class (the language that uses the word most, from the labelled sample). The
chain has learned transitions between languages. Forward-backward gives each
word's posterior; a document's language is the one with the largest expected
number of words, and the score is its share of them.

Texts in one language teach no switches, so half of the training chains are
spliced from two texts; code-switched texts are then labelled word by word
(``spans``). Chains are stretches of at most ``CHAIN`` words of one text:
every word of every text is labelled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .common import id_hash, materialized, mix64, range_hashes, release, text_batches, word_spans

BITS = 17
CHAIN = 128
#: labelled rows per language that the model is fitted on at most (about; by a hash of the id), and per shard
MAX_PER_LANG = 1_000
SHARD_ROWS = 1_000
EPOCHS, BATCH, RATE, DECAY = 4, 128, 0.3, 1e-6
TRAIN_CHAIN = 64
#: a lexicon word was seen so often, and in its language with this share
LEXICON_SEEN, LEXICON_SHARE = 3, 0.6
UNKNOWN = "und"
_SAMPLE = 1 << 40
#: text whose words are labelled together
PIECE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(97, 123), *range(128, 256)]] = True


class Words:
    """The distinct words of a buffer with their features, and the running text as word numbers."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        low = _LOWER[buf]
        starts, ends, self.doc = word_spans(low, offs, _IS_WORD)
        h = range_hashes(low, starts, ends)
        self.hash, first, self.ids = np.unique(h, return_index=True, return_inverse=True)
        s, e = starts[first], ends[first]
        n = e - s
        cols = [self.hash >> np.uint64(64 - BITS)]
        for k in (1, 2, 3, 4):
            m = np.minimum(n, k)
            for salt, a, b in ((k, s, s + m), (10 + k, e - m, e)):
                cols.append(mix64(range_hashes(low, a, b) + np.uint64(salt)) >> np.uint64(64 - BITS))
        self.affix = np.stack(cols, 1).astype(np.int64) if len(s) else np.zeros((0, 9), np.int64)
        count = np.maximum(n - 2, 0)
        self.tri_word = np.repeat(np.arange(len(s)), count)
        at = np.repeat(s - np.concatenate([[0], np.cumsum(count)[:-1]]) if len(s) else s, count) + np.arange(count.sum())
        tri = (low[at].astype(np.uint64) << np.uint64(16) | low[at + 1].astype(np.uint64) << np.uint64(8)
               | low[at + 2].astype(np.uint64)) if len(at) else np.zeros(0, np.uint64)
        self.tri = (mix64(tri + np.uint64(20 << 24)) >> np.uint64(64 - BITS)).astype(np.int64)

    def scores(self, weights: np.ndarray, lexicon: np.ndarray, lex_weights: np.ndarray) -> np.ndarray:
        """Emission score of every distinct word for every language."""
        out = np.zeros((len(self.hash), weights.shape[1]))
        for k in range(self.affix.shape[1]):
            out += weights[self.affix[:, k]]
        if len(self.tri):
            for lang in range(weights.shape[1]):
                out[:, lang] += np.bincount(self.tri_word, weights[self.tri, lang], minlength=len(out))
        return out + lex_weights[lexicon[self.affix[:, 0]]]


def chains(doc: np.ndarray, length: int) -> np.ndarray:
    """Word positions as a matrix of chains: rows of up to ``length`` words of one text, -1 beyond."""
    if not len(doc):
        return np.zeros((0, length), np.int64)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    sizes = np.diff(np.append(first, len(doc)))
    per = -(-sizes // length)
    row0 = np.repeat(np.concatenate([[0], np.cumsum(per)[:-1]]), sizes)
    inside = np.arange(len(doc)) - np.repeat(first, sizes)
    out = np.full((per.sum(), length), -1, np.int64)
    out[row0 + inside // length, inside % length] = np.arange(len(doc))
    return out


def forward_backward(emit: np.ndarray, mask: np.ndarray, trans: np.ndarray, start: np.ndarray,
                     expect: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Posteriors of every word, and (if asked) the expected number of transitions.

    ``emit``: (chains, words, languages) scores; words beyond a chain's end
    are masked and change nothing. Scaled, so nothing under- or overflows.
    """
    n, t, k = emit.shape
    e = np.exp(emit - emit.max(2, keepdims=True))
    a = np.exp(trans - trans.max())
    alpha, beta = np.empty((n, t, k)), np.ones((n, t, k))
    cur = e[:, 0] * np.exp(start - start.max())
    alpha[:, 0] = cur = cur / cur.sum(1, keepdims=True)
    for i in range(1, t):
        nxt = (cur @ a) * e[:, i]
        cur = np.where(mask[:, i, None], nxt / nxt.sum(1, keepdims=True), cur)
        alpha[:, i] = cur
    cur = beta[:, -1]
    for i in range(t - 1, 0, -1):
        nxt = (e[:, i] * cur) @ a.T
        cur = np.where(mask[:, i, None], nxt / nxt.sum(1, keepdims=True), cur)
        beta[:, i - 1] = cur
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    if not expect:
        return post, None
    left, right = alpha[:, :-1], e[:, 1:] * beta[:, 1:]
    pair = left[..., :, None] * a * right[..., None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    return post, (pair * mask[:, 1:, None, None]).sum((0, 1))


def fit_crf(words: Words, labels: np.ndarray, k: int, lexicon: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """CRF weights by AdaGrad on mini-batches of chains, half of them spliced.

    ``labels``: the language of each text of the buffer.
    """
    rng = np.random.default_rng(seed)
    w = {"feature": np.zeros((1 << BITS, k)), "lexicon": np.zeros((k + 1, k)), "trans": np.zeros((k, k)), "start": np.zeros(k)}
    seen = {name: np.full_like(v, 1e-4) for name, v in w.items()}
    rows = chains(words.doc, TRAIN_CHAIN)
    word = np.where(rows >= 0, words.ids[rows], -1)
    lang = np.where(rows >= 0, labels[words.doc[rows]], -1)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            x, y = word[pick].copy(), lang[pick].copy()
            half = len(pick) // 2
            other = rng.integers(0, len(rows), half)
            cut = rng.integers(1, TRAIN_CHAIN, half)
            tail = (np.arange(TRAIN_CHAIN)[None, :] >= cut[:, None]) & (word[other] >= 0) & (x[:half] >= 0)
            x[:half][tail], y[:half][tail] = word[other][tail], lang[other][tail]
            mask = x >= 0
            own, inv = np.unique(x[mask], return_inverse=True)
            affix = words.affix[own]
            lo, hi = np.searchsorted(words.tri_word, own), np.searchsorted(words.tri_word, own, side="right")
            tri_n = hi - lo
            tri_of = np.repeat(np.arange(len(own)), tri_n)
            tri = words.tri[np.repeat(lo - np.concatenate([[0], np.cumsum(tri_n)[:-1]]), tri_n) + np.arange(tri_n.sum())]
            lex = lexicon[affix[:, 0]]
            score = w["feature"][affix].sum(1) + w["lexicon"][lex]
            for c in range(k):
                score[:, c] += np.bincount(tri_of, w["feature"][tri, c], minlength=len(own))
            emit = np.zeros((*x.shape, k))
            emit[mask] = score[inv]
            post, pairs = forward_backward(emit, mask, w["trans"], w["start"])
            gold = np.zeros_like(post)
            gold[mask, y[mask]] = 1.0
            diff = (gold - post)[mask]
            err = np.stack([np.bincount(inv, diff[:, c], minlength=len(own)) for c in range(k)], 1)
            slots = np.concatenate([affix.ravel(), tri])
            of = np.concatenate([np.repeat(np.arange(len(own)), affix.shape[1]), tri_of])
            used, back = np.unique(slots, return_inverse=True)
            g = np.stack([np.bincount(back, err[of, c], minlength=len(used)) for c in range(k)], 1) / len(pick)
            g -= DECAY * w["feature"][used]
            seen["feature"][used] += g * g
            w["feature"][used] += RATE * g / np.sqrt(seen["feature"][used])
            both = mask[:, 1:] & mask[:, :-1]
            true = np.zeros((k, k))
            np.add.at(true, (y[:, :-1][both], y[:, 1:][both]), 1.0)
            dense = {"lexicon": np.stack([np.bincount(lex, err[:, c], minlength=k + 1) for c in range(k)], 1),
                     "trans": true - pairs, "start": (gold[:, 0] - post[:, 0])[mask[:, 0]].sum(0)}
            for name, grad in dense.items():
                grad = grad / len(pick) - DECAY * w[name]
                seen[name] += grad * grad
                w[name] += RATE * grad / np.sqrt(seen[name])
    return w


def train(docs: DataFrame, rule: Column, lang: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The model: languages, lexicon classes by slot, and weights.

    The sample is a hash range of the ids of each language (about
    ``MAX_PER_LANG``); its chains are fitted in shards of bounded size, whose
    weights are averaged. The size of the model depends on the number of
    languages alone.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(lang).isNotNull() & F.col(text_col).isNotNull() & rule)
    counts = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    k = len(langs)
    if not k:
        return {"langs": [], "lexicon": np.zeros(1 << BITS, np.uint8), "feature": np.zeros((1 << BITS, 0), np.float32),
                "lex": np.zeros((1, 0)), "trans": np.zeros((0, 0)), "start": np.zeros(0)}
    spot = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(_SAMPLE))
    few = F.lit(False)
    number = F.lit(None).cast("int")
    for i, name in enumerate(langs):
        limit = max(1, int(min(1.0, MAX_PER_LANG / counts[name]) * _SAMPLE))
        few = few | ((F.col(lang) == F.lit(name)) & (spot < F.lit(limit)))
        number = F.when(F.col(lang) == F.lit(name), F.lit(i)).otherwise(number)
    shards = max(1, math.ceil(sum(min(n, MAX_PER_LANG) for n in counts.values()) / SHARD_ROWS))
    sample = known.where(few).select(
        F.col(text_col).alias("text"), number.alias("y"), F.xxhash64(F.col(id_col).cast("string"), F.lit("order")).alias("order"),
        F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("shard")), F.lit(shards)).cast("int").alias("shard"))
    sample = materialized(sample)  # bounded; read by the lexicon and by the fit

    def count(batches):
        for part, buf, offs in text_batches(batches, "text"):
            words = Words(buf, offs)
            y = part.column(part.schema.get_field_index("y")).to_numpy()
            key, n = np.unique(words.affix[words.ids, 0] * k + y[words.doc], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key // k, pa.int64()), pa.array(key % k, pa.int32()), pa.array(n, pa.int64())],
                                             ["slot", "y", "n"])

    used = (sample.select("text", "y").mapInArrow(count, "slot bigint, y int, n bigint")
            .groupBy("slot", "y").agg(F.sum("n").alias("n")).toArrow())  # at most slots x languages
    table = np.zeros((1 << BITS, k))
    table[used["slot"].to_numpy(), used["y"].to_numpy()] = used["n"].to_numpy()
    total = table.sum(1)
    clear = (total >= LEXICON_SEEN) & (table.max(1) >= LEXICON_SHARE * total)
    lexicon = np.where(clear, table.argmax(1) + 1, 0).astype(np.int16)
    shipped = spark.sparkContext.broadcast(lexicon)

    def fit(part: pa.Table) -> pa.Table:
        part = part.sort_by([("order", "ascending"), ("y", "ascending"), ("text", "ascending")]).combine_chunks()
        batch = part.select(["text"]).to_batches(max_chunksize=part.num_rows)[0]
        _, buf, offs = next(text_batches([batch], "text", 1 << 40))
        w = fit_crf(Words(buf, offs), part["y"].to_numpy(), k, shipped.value, int(part["shard"][0].as_py()))
        release()
        live = np.flatnonzero(np.abs(w["feature"]).max(1) > 1e-6)
        flat = [("feature", live, w["feature"][live])] + [(name, np.arange(len(w[name].reshape(-1, k))), w[name].reshape(-1, k))
                                                          for name in ("lexicon", "trans", "start")]
        return pa.table({"name": pa.array([name for name, i, _ in flat for _ in i], pa.string()),
                         "i": pa.array(np.concatenate([i for _, i, _ in flat]), pa.int64()),
                         "w": pa.array([r for _, _, v in flat for r in v.tolist()], pa.list_(pa.float64()))})

    parts = sample.groupBy("shard").applyInArrow(fit, "name string, i bigint, w array<double>")
    fitted = F.max(F.when(F.col("name") == "start", 1).otherwise(0))
    sums = parts.groupBy("name", "i").agg(*[F.sum(F.col("w")[c]).alias(f"w{c}") for c in range(k)],
                                          F.count(F.lit(1)).alias("n"), fitted.alias("s")).toArrow()  # bounded as above
    w = {"feature": np.zeros((1 << BITS, k), np.float32), "lexicon": np.zeros((k + 1, k)), "trans": np.zeros((k, k)),
         "start": np.zeros((1, k))}
    n_fit = max((n for n, s in zip(sums["n"].to_pylist(), sums["s"].to_pylist()) if s), default=1)
    values = np.stack([sums[f"w{c}"].to_numpy() for c in range(k)], 1) / n_fit if sums.num_rows else np.zeros((0, k))
    names, at = np.array(sums["name"].to_pylist()), sums["i"].to_numpy()
    for name in w:
        own = names == name
        w[name][at[own]] = values[own]
    return {"langs": langs, "lexicon": lexicon, "feature": w["feature"], "lex": w["lexicon"], "trans": w["trans"],
            "start": w["start"][0]}


def predict(docs: DataFrame, model: dict, text_col: str = "text", keep_text: bool = True, spans: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score (and ``spans``), in place of columns of those names.

    A text that is null, empty or has no letter is ``und`` with score 0. With
    ``spans``, an array of (lang, first word, words) gives each stretch of
    words with one most probable language.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    letter = "_has_letter"
    x = docs.withColumn(letter, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    keep = [c for c in docs.columns if (keep_text or c != text_col) and c not in ("lang_pred", "score", "spans")]
    fields = [f for f in docs.schema.fields if f.name in keep]
    fields += [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    span = StructType([StructField("lang", StringType()), StructField("at", LongType()), StructField("n", LongType())])
    if spans:
        fields.append(StructField("spans", ArrayType(span)))

    def run(batches):
        m = shipped.value
        k = len(m["langs"])
        names = np.array([*m["langs"], UNKNOWN], object)
        for part, buf, offs in text_batches(batches, text_col, PIECE_BYTES):
            n = part.num_rows
            ok = part.column(part.schema.get_field_index(letter)).to_numpy(zero_copy_only=False).astype(bool)
            expected, words, post = np.zeros((n, max(k, 1))), None, None
            if k:
                words = Words(buf, offs)
                rows = chains(words.doc, CHAIN)
                mask = rows >= 0
                emit = np.zeros((*rows.shape, k))
                emit[mask] = words.scores(m["feature"], m["lexicon"], m["lex"])[words.ids[rows[mask]]]
                full, _ = forward_backward(emit, mask, m["trans"], m["start"], False) if len(rows) else (emit, None)
                post = np.empty((len(words.doc), k))
                post[rows[mask]] = full[mask]
                for c in range(k):
                    expected[:, c] = np.bincount(words.doc, post[:, c], minlength=n)
            total = expected.sum(1)
            ok &= total > 0
            best = np.where(ok, expected.argmax(1), k)
            share = np.where(ok, expected.max(1) / np.maximum(total, 1e-300), 0.0)
            cols = [part.column(part.schema.get_field_index(c)) for c in keep]
            cols += [pa.array(names[best].tolist(), pa.string()), pa.array(np.clip(share, 0, 1), pa.float64())]
            head = [*keep, "lang_pred", "score"]
            if spans:
                head.append("spans")
                cols.append(pa.array(_spans(words, post, ok, m["langs"], n), pa.list_(pa.struct(
                    [("lang", pa.string()), ("at", pa.int64()), ("n", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(cols, head)

    return x.mapInArrow(run, StructType(fields))


def _spans(words: Words | None, post: np.ndarray | None, ok: np.ndarray, langs: list[str], n: int) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(n)]
    if words is None or not len(words.doc):
        return out
    best = post.argmax(1)
    new = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (words.doc[1:] != words.doc[:-1])]))
    first = np.searchsorted(words.doc, np.arange(n))
    for a, b in zip(new, np.append(new[1:], len(best))):
        d = int(words.doc[a])
        if ok[d]:
            out[d].append({"lang": langs[best[a]], "at": int(a - first[d]), "n": int(b - a)})
    return out


def trainable(id_col: str = "doc_id", folds: int = 3) -> Column:
    """Ids that may be learned from: crc32(id as text) mod ``folds`` is not 1."""
    return F.pmod(id_hash(id_col), F.lit(folds)) != 1


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Null ids count as the text ``null``; rows that repeat are predicted each;
    without labelled rows every text is ``und``; an empty table gives no rows.
    """
    model = train(docs, trainable(id_col), lang, id_col, text_col)
    x = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (~trainable(id_col)).alias("held_out"))
    return predict(x, model, keep_text=False).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang: str = "lang") -> DataFrame:
    """The documents in some language, also in several; all columns stay.

    Rejected are texts that are null or have no letter. Where no row is
    labelled nothing can be learned, and a text with a letter stays. Rows that
    repeat stay or go alike, columns keep their names whatever they are, texts
    are read whole; an empty table gives no rows.
    """
    if docs.where(F.col(lang).isNotNull() & trainable(id_col)).isEmpty():
        return docs.where(F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}"))
    model = train(docs, trainable(id_col), lang, id_col, text_col)
    x = predict(docs.withColumnsRenamed({c: f"_in_{c}" for c in docs.columns}), model, f"_in_{text_col}")
    return x.where(F.col("lang_pred") != UNKNOWN).select([F.col(f"_in_{c}").alias(c) for c in docs.columns])
