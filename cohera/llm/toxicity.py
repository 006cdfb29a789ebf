"""Toxicity: FTRL-proximal logistic regression over hashed n-grams and skip-grams.

A document's features are the distinct hashes of its words, of neighbouring
word pairs and of pairs with one word between. FTRL-proximal gives every
coordinate its own learning rate and an L1 threshold that leaves most
weights at zero, so the model is a short list of (slot, weight) whose size
is bounded by the number of slots, whatever the corpus.

The model is fitted on a bounded sample of labelled rows, in shards of
bounded size whose weights are averaged. L1 and averaging shrink its sums, so
scale and bias are then fitted on rows kept back from the sample (Platt's
method). Every document is scored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import id_hash, mix64, range_hashes, text_batches, word_spans

#: weight slots
BITS = 20
#: labelled rows that the model is fitted on at most (about; chosen by a hash of the id), and per shard
MAX_ROWS = 20_000
SHARD_ROWS = 5_000
#: FTRL-proximal: learning rate, its damping, L1, L2, passes
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 6.0, 0.1, 6
#: one in so many sampled rows is not learned from but sets the score's scale
CALIBRATION = 5
_SAMPLE = 1 << 40

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[39, *range(48, 58), *range(97, 123), *range(128, 256)]] = True


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, slot) of every word, pair and skip-gram of the texts in a buffer."""
    low = _LOWER[buf]
    starts, ends, doc = word_spans(low, offs, _IS_WORD)
    h = range_hashes(low, starts, ends)
    docs, hashes = [doc], [h]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(h) > gap:
            same = doc[:-gap] == doc[gap:]
            docs.append(doc[:-gap][same])
            hashes.append(mix64(h[:-gap][same] * np.uint64(salt) + h[gap:][same]))
    return np.concatenate(docs), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def fit_ftrl(rows: list[tuple[np.ndarray, int]], bias0: float) -> tuple[np.ndarray, float]:
    """Weights and bias from (slots, label) examples, in the order given, EPOCHS times."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias, bias_n = bias0, 0.0
    for _ in range(EPOCHS):
        for slots, label in rows:
            zi, ni = z[slots], n[slots]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2))
            p = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, bias + w.sum()))))
            g = p - label
            grown = ni + g * g
            z[slots] = zi + g - (np.sqrt(grown) - root) / ALPHA * w
            n[slots] = grown
            bias_n += g * g
            bias -= 0.05 * g / (1.0 + math.sqrt(bias_n))
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w, bias


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) such that ``a * z + b`` is the log-odds of label 1, by damped Newton steps.

    The rarer class weighs more, by the square root of its odds. Without both
    classes it is (1, 0).
    """
    ones, zeros = float((y == 1).sum()), float((y == 0).sum())
    if not ones or not zeros:
        return 1.0, 0.0
    at = np.lexsort((y, z))  # sums do not depend on the rows' order
    z, y = z[at], y[at]
    want = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    weight = np.where(y == 1, math.sqrt(zeros / ones), 1.0)
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, h = weight * (p - want), weight * p * (1 - p)
        hess = np.array([[(h * z * z).sum() + 1.0, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])  # a is held near 1
        step = np.linalg.solve(hess, [(g * z).sum() + a - 1.0, g.sum()])
        step *= min(1.0, 2.0 / max(float(np.abs(step).max()), 1e-9))
        a, b = a - float(step[0]), b - float(step[1])
    return (a, b) if a > 0 else (1.0, 0.0)


def labelled(docs: DataFrame, labels: DataFrame, train: Column, label: str, id_col: str, text_col: str,
             max_rows: int = MAX_ROWS) -> tuple[DataFrame, int]:
    """(text, y, order) of about ``max_rows`` labelled training rows, and how many labels there are.

    The sample is a hash range of the ids, so it does not depend on the
    layout, and its ids are few enough to broadcast: the texts do not move.
    An id with several labels counts as positive if one is.
    """
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & train)
             .groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("y")))
    total = known.count()
    spot = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(_SAMPLE))
    share = min(1.0, max_rows / max(total, 1))
    few = known.where(spot < F.lit(max(1, int(share * _SAMPLE)))).withColumn("order", spot)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(few), "_id").select("_id", "text", "y", "order"), total


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
          rule: Column | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """The model: slots with a weight, their weights, and the bias.

    ``rule`` says which ids may be learned from. Without any label the model
    is empty and every score is 0.5.
    """
    rows, total = labelled(docs, labels, F.lit(True) if rule is None else rule, label, id_col, text_col)
    shards = max(1, math.ceil(min(total, MAX_ROWS) / SHARD_ROWS))
    back = F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit("calibrate")), F.lit(CALIBRATION)) == 0
    kept_back, rows = rows.where(back).select("text", "y"), rows.where(~back)
    # copies under one id are dealt by their texts too
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.col("_id").cast("string"), "text", F.lit("shard")), F.lit(shards)).cast("int"))

    def prepare(batches):
        for part, buf, offs in text_batches(batches, "text"):
            doc, slot = features(buf, offs)
            key = np.unique(doc << BITS | slot)
            of, slots = key >> BITS, (key & ((1 << BITS) - 1)).astype("<u4")
            cuts = np.searchsorted(of, np.arange(part.num_rows + 1))
            packed = pa.array([slots[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
            column = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([column("shard"), column("order"), column("y"), packed],
                                             ["shard", "order", "y", "slots"])

    def fit(table: pa.Table) -> pa.Table:
        ys, slots, order = table["y"].to_numpy(), table["slots"].to_pylist(), table["order"].to_numpy()
        at = sorted(range(len(ys)), key=lambda i: (order[i], slots[i]))
        rate = min(max(float(np.mean(ys)), 1e-3), 1 - 1e-3)
        w, bias = fit_ftrl([(np.frombuffer(slots[i], "<u4").astype(np.int64), int(ys[i])) for i in at],
                           math.log(rate / (1 - rate)))
        live = np.flatnonzero(w)
        return pa.table({"slot": pa.array([*live.tolist(), -1], pa.int64()), "w": pa.array([*w[live], bias], pa.float64())})

    parts = (rows.mapInArrow(prepare, "shard int, order bigint, y int, slots binary")
             .groupBy("shard").applyInArrow(fit, "slot bigint, w double"))
    # at most 2**BITS rows: the slots
    model = parts.groupBy("slot").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).toArrow()
    slot, w = model["slot"].to_numpy(), model["w"].to_numpy()
    if not len(slot):
        return np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0
    own = slot < 0
    fitted = int(model["n"].to_numpy()[own][0])  # shards that had rows
    at = np.argsort(slot[~own])
    slots, weights, bias = slot[~own][at], w[~own][at] / fitted, float(w[own][0] / fitted)
    # about MAX_ROWS / CALIBRATION rows
    seen = score(kept_back, (slots, weights.astype(np.float32), bias), keep_text=False).toArrow()
    p = np.clip(seen["score"].to_numpy(), 1e-13, 1 - 1e-13)
    a, b = platt(np.log(p / (1 - p)), seen["y"].to_numpy())
    return slots, (a * weights).astype(np.float32), a * bias + b


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text",
          out_col: str = "score", keep_text: bool = True) -> DataFrame:
    """``docs`` with the probability of the label. Null and empty texts get the bias alone."""
    keep = [c for c in docs.columns if (keep_text or c != text_col) and c != out_col]
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS weights
    schema = StructType([*[f for f in docs.schema.fields if f.name in keep], StructField(out_col, DoubleType())])

    def run(batches):
        slots, values, bias = shipped.value
        weights = np.zeros(1 << BITS, np.float32)
        weights[slots] = values
        for part, buf, offs in text_batches(batches, text_col):
            doc, slot = features(buf, offs)
            live = weights[slot] != 0
            key = np.unique(doc[live] << BITS | slot[live])  # a feature counts once per document
            total = np.bincount(key >> BITS, weights=weights[key & ((1 << BITS) - 1)].astype(np.float64),
                                minlength=part.num_rows)
            p = 1.0 / (1.0 + np.exp(-np.clip(total + bias, -30, 30)))
            cols = [part.column(part.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p, pa.float64())], [*keep, out_col])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
             folds: int = 5) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Rows whose crc32(id as text) mod ``folds`` is 0 are never learned from.
    Null ids count as the text ``null``; null texts as empty; rows that
    repeat are scored each; an empty table gives no rows; labels without a
    document, or neither 0 nor 1, are ignored. Other columns are ignored,
    whatever their names. A very long text is scored whole, by one task.
    """
    model = train(docs, labels, label, id_col, text_col, F.pmod(id_hash(id_col), F.lit(folds)) != 0)
    x = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                    (F.pmod(id_hash(id_col), F.lit(folds)) == 0).alias("held_out"))
    x = score(x, model, keep_text=False)
    return x.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
