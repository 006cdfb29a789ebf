"""Linear classifiers of all folds and regularisations, trained together.

``fit_models`` reads one table of scored rows. A row names the folds that
validate or test on it; it trains in all others. One step is one pass: every
task multiplies its rows by the weights of all unfinished models at once and
keeps loss, gradient and Hessian per model; Spark sums these small rows. The
driver then takes a damped Newton step per model. Cost therefore grows with
rows, and hardly with the number of folds.

The model has ``num_labels`` classes with softmax probabilities; class 0 is
the reference (its logit is 0). The loss of a row with true-class probability
``p`` is ``-a_y (1 - p)^gamma log p``. Weighted training divides by the sum of
weights, focal training by the number of rows. The penalty is half of
``reg`` times the squared weights on standardised features; biases are free.

Each step's state can be written to a folder: a run that stops goes on from
its last whole step. Every ``eval_every`` steps the models are judged by exact
validation ROC AUC, and the best weights of each model are what it ends with.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.prefix import running_sums
from ..session import fenced_where

#: entries of the arrays a task works on at a time
PIECE = 1 << 20
#: the folds that validate and test on a row
FOLD_COLUMNS = ("val_folds", "test_folds")
#: the bias of a class without training rows
ABSENT = -30.0


@dataclass
class Options:
    num_labels: int = 2
    #: weight per class: of the loss and its divisor, or (focal) of the loss alone
    class_weights: list[float] | None = None
    gamma: float = 0.0
    focal: bool = False
    max_iter: int = 50
    tolerance: float = 1e-12
    eval_every: int = 0


@dataclass
class State:
    """Weights and optimiser state of every model; all that a restart needs."""
    step: int
    weights: np.ndarray              # (models, classes - 1, features + 1), the bias first
    direction: np.ndarray
    rate: np.ndarray
    objective: np.ndarray
    active: np.ndarray
    best: np.ndarray
    best_auc: np.ndarray
    kind: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(self).items()})

    @classmethod
    def from_json(cls, text: str) -> "State":
        raw = json.loads(text)
        return cls(**{k: np.array(v, bool if k == "active" else float) if isinstance(v, list) else v for k, v in raw.items()})


def training_rows(cands: DataFrame, features, label: str = "label", keep=()) -> DataFrame:
    """(label, x, val_folds, test_folds, *keep): rows with a null label or feature are left out.

    Fold columns that the table does not have are empty: its rows train.
    """
    none = F.array().cast("array<int>")
    folds = [(F.coalesce(F.col(c), none) if c in cands.columns else none).alias(c) for c in FOLD_COLUMNS]
    whole = F.col(label).isNotNull()
    for f in features:
        whole = whole & F.col(f).isNotNull()
    x = F.array(*[F.col(f).cast("double") for f in features])
    return fenced_where(cands, whole).select(F.col(label).cast("int").alias("label"), x.alias("x"), *folds, *keep)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The features behind a column of ones."""
    x = batch.column(batch.schema.get_field_index("x"))
    flat = x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return np.concatenate([np.ones((batch.num_rows, 1)), flat], 1)


def _folds(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, fold) of a column of fold lists."""
    lists = batch.column(batch.schema.get_field_index(column))
    return lists.value_parent_indices().to_numpy(), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _trains(batch: pa.RecordBatch, position: dict[int, int]) -> np.ndarray:
    """1 where the row trains in the fold."""
    mask = np.ones((batch.num_rows, len(position)))
    for column in FOLD_COLUMNS:
        row, fold = _folds(batch, column)
        at = np.array([position.get(f, -1) for f in fold.tolist()], np.int64)
        mask[row[at >= 0], at[at >= 0]] = 0
    return mask


def _labels(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("label")).to_numpy()


def _summed(rows: DataFrame, partial, shape: tuple[int, ...], size: int) -> np.ndarray:
    """Sum of ``partial(batch)`` (an array of ``shape``) over the table; ``size`` bounds the rows looked at together."""
    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                total += partial(batch.slice(a, size))
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["at", "v"])

    out = np.zeros(int(np.prod(shape)))
    for r in rows.mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out.reshape(shape)


def fold_statistics(rows: DataFrame, folds: list[int], width: int, o: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(divisor, variance, rows per class) of each fold's training rows."""
    position = {f: i for i, f in enumerate(folds)}
    weight = np.ones(o.num_labels) if o.class_weights is None else np.array(o.class_weights, float)

    def partial(batch):
        x, y, mask = _matrix(batch), _labels(batch), _trains(batch, position)
        a = np.ones(len(y)) if o.focal else weight[y]
        classes = np.eye(o.num_labels)[y]
        cols = np.concatenate([(a[:, None] * x), (a[:, None] * x * x), (a * a)[:, None], classes], 1)
        return mask.T @ cols

    t = _summed(rows, partial, (len(folds), 2 * (width + 1) + 1 + o.num_labels), max(1, PIECE // (len(folds) + 3 * width + 8)))
    z, s, s2 = t[:, 0], t[:, 1:width + 1], t[:, width + 2:2 * width + 2]
    squares, counts = t[:, 2 * width + 2], t[:, 2 * width + 3:]
    with np.errstate(invalid="ignore", divide="ignore"):
        var = (s2 - s * s / z[:, None]) / (z - squares / z)[:, None]  # of weighted rows, unbiased
    return z, np.where(np.isfinite(var) & (var > 1e-30), var, 0.0), counts


def _look(rows: DataFrame, folds: list[int], fold_of: np.ndarray, weights: np.ndarray, o: Options):
    """Loss, gradient and curvature of some models over their training rows: one pass."""
    position = {f: i for i, f in enumerate(folds)}
    models, k, width = weights.shape
    a_y = np.ones(o.num_labels) if o.class_weights is None else np.array(o.class_weights, float)
    n = k * width

    def partial(batch):
        x, y = _matrix(batch), _labels(batch)
        mask = _trains(batch, position)[:, fold_of] * a_y[y][:, None]
        z = np.einsum("ri,mki->rmk", x, weights, optimize=True)
        top = np.maximum(z.max(2), 0.0)
        e = np.exp(z - top[:, :, None])
        total = e.sum(2) + np.exp(-top)
        p = e / total[:, :, None]
        own = np.concatenate([np.zeros((len(y), models, 1)), z], 2)[np.arange(len(y)), :, y]
        lp = own - top - np.log(total)
        py = np.exp(lp)
        if o.gamma:
            miss = np.maximum(1.0 - py, 0.0)
            loss = -miss ** o.gamma * lp
            slope = o.gamma * py * np.maximum(miss, 1e-12) ** (o.gamma - 1) * lp - miss ** o.gamma
        else:
            loss, slope = -lp, np.full_like(lp, -1.0)
        slope = slope * mask
        hit = np.concatenate([np.zeros((1, k)), np.eye(k)])[y]
        r = slope[:, :, None] * (hit[:, None, :] - p)
        h = -slope[:, :, None, None] * (p[:, :, :, None] * np.eye(k) - p[:, :, :, None] * p[:, :, None, :])
        grad = (x.T @ r.reshape(len(y), -1)).reshape(width, models, k).transpose(1, 2, 0).reshape(models, n)
        outer = (x[:, :, None] * x[:, None, :]).reshape(len(y), -1)
        curve = (outer.T @ h.reshape(len(y), -1)).reshape(width, width, models, k, k)
        curve = curve.transpose(2, 3, 0, 4, 1).reshape(models, n * n)
        return np.concatenate([(loss * mask).sum(0)[:, None], grad, curve], 1)

    t = _summed(rows, partial, (models, 1 + n + n * n), max(1, PIECE // (models * (k * k + 2 * k + 4) + width * width)))
    return t[:, 0], t[:, 1:1 + n].reshape(models, k, width), t[:, 1 + n:].reshape(models, n, n)


def model_scores(rows: DataFrame, column: str, weights: dict[int, list[np.ndarray]], keep: dict[str, str]) -> DataFrame:
    """(fold, model, p1, label, *keep): each row scored by the models of the folds it names in ``column``.

    ``p1`` is class 1's share of the softmax. ``keep`` maps carried columns to their types.
    """
    def run(batches):
        for batch in batches:
            row, fold = _folds(batch, column)
            known = np.array([f in weights for f in fold.tolist()], bool)
            row, fold = row[known], fold[known]
            if not len(row):
                continue
            x = _matrix(batch)[row]
            for m in range(len(next(iter(weights.values())))):
                z = np.einsum("ri,rki->rk", x, np.stack([weights[f][m] for f in fold.tolist()]))
                top = np.maximum(z.max(1), 0.0)
                p1 = np.exp(z[:, 0] - top) / (np.exp(z - top[:, None]).sum(1) + np.exp(-top))
                take = pa.array(row)
                cols = [pa.array(fold.astype(np.int32)), pa.array(np.full(len(row), m, np.int32)), pa.array(p1),
                        pa.array(_labels(batch)[row].astype(np.int32))]
                cols += [batch.column(batch.schema.get_field_index(c)).take(take) for c in keep]
                yield pa.RecordBatch.from_arrays(cols, ["fold", "model", "p1", "label", *keep])

    return rows.mapInArrow(run, "fold int, model int, p1 double, label int" + "".join(f", {c} {t}" for c, t in keep.items()))


def grouped_roc_auc(scored: DataFrame, groups: list[str], score: str = "p1", label: str = "label") -> DataFrame:
    """(*groups, roc_auc): the exact area per group, ties one half, null with one class.

    One row per group and distinct score; running counts go over all groups in
    one order, so neither a group nor a score is gathered in one task.
    """
    per = scored.groupBy(F.struct(*groups, score).alias("at")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    run = running_sums(per, "at", ["neg"])
    below = F.col("cum_neg") - F.col("neg") / 2
    agg = run.groupBy(*[F.col(f"at.{g}").alias(g) for g in groups]).agg(
        F.sum(F.col("pos") * below).alias("area"), F.sum("pos").alias("p"), F.sum("neg").alias("n"),
        F.min(F.col("cum_neg") - F.col("neg")).alias("before"))
    auc = (F.col("area") - F.col("p") * F.col("before")) / (F.col("p").cast("double") * F.col("n"))
    return agg.select(*groups, F.when((F.col("p") > 0) & (F.col("n") > 0), auc).alias("roc_auc"))


def _read_state(spark: SparkSession, path: str) -> State | None:
    try:
        last = spark.read.parquet(path).orderBy(F.desc("at")).limit(1).collect()
    except AnalysisException:  # nothing written yet
        return None
    return State.from_json(last[0]["state"]) if last else None


def _write_state(spark: SparkSession, path: str, state: State) -> None:
    one = spark.createDataFrame([(state.step, state.to_json())], "at int, state string")
    one.coalesce(1).write.mode("overwrite").parquet(f"{path}/step={state.step}")


def fit_models(rows: DataFrame, folds: list[int], width: int, reg_params=(0.0,), options: Options | None = None,
               state_path: str | None = None, stop_after: int | None = None) -> tuple[dict[int, list[np.ndarray]], dict, dict]:
    """Weights, validation AUC and class counts per fold: ``{fold: [weights per reg]}`` and so on.

    ``rows`` is a table as ``training_rows`` makes it, written once. Folds
    without training rows of class 0 or of any other class are left out.
    ``stop_after`` ends the run early after that many steps, as a lost driver would.
    """
    o = options or Options()
    spark = rows.sparkSession
    k, r = o.num_labels - 1, len(reg_params)
    z, var, counts = fold_statistics(rows, folds, width, o)
    usable = np.flatnonzero((counts[:, 0] > 0) & (counts[:, 1:].sum(1) > 0))
    fold_of = np.repeat(usable, r)
    reg = np.tile(np.array(reg_params, float), len(usable))
    m = len(fold_of)
    penalty = reg[:, None, None] * np.concatenate([np.zeros((m, 1)), var[fold_of]], 1)[:, None, :] * np.ones((m, k, 1))
    # a feature without spread and a class without rows keep their starting weights
    fixed = np.concatenate([np.zeros((m, 1), bool), var[fold_of] == 0], 1)[:, None, :] | (counts[fold_of, 1:] == 0)[:, :, None]
    kind = {"folds": list(folds), "reg": list(map(float, reg_params)), "options": vars(o), "width": width}
    start = np.zeros((m, k, width + 1))
    start[:, :, 0] = np.where(counts[fold_of, 1:] == 0, ABSENT, 0.0)
    state = _read_state(spark, state_path) if state_path else None
    if state is not None and state.kind != json.loads(json.dumps(kind)):
        raise ValueError(f"{state_path} holds the state of other models: {state.kind}")
    if state is None:
        state = State(0, start, np.zeros_like(start), np.zeros(m), np.full(m, np.inf), np.ones(m, bool), start.copy(),
                      np.full(m, -1.0), kind)

    def judge():
        by_fold = {folds[f]: [state.weights[i] for i in np.flatnonzero(fold_of == f)] for f in usable.tolist()}
        scored = model_scores(rows, "val_folds", by_fold, {})
        first = {f: int(np.flatnonzero(fold_of == f)[0]) for f in usable.tolist()}
        at = {f: i for i, f in enumerate(folds)}
        for row in grouped_roc_auc(scored, ["fold", "model"]).collect():
            i = first[at[row["fold"]]] + row["model"]
            auc = -1.0 if row["roc_auc"] is None else row["roc_auc"]
            if auc > state.best_auc[i]:
                state.best_auc[i], state.best[i] = auc, state.weights[i]

    taken = 0
    while state.active.any() and state.step < o.max_iter and m:
        if stop_after is not None and taken == stop_after:
            break
        on = np.flatnonzero(state.active)
        trial = state.weights[on] + state.rate[on, None, None] * state.direction[on]
        loss, grad, curve = _look(rows, folds, fold_of[on], trial, o)
        for j, i in enumerate(on.tolist()):
            value = loss[j] / z[fold_of[i]] + 0.5 * float((penalty[i] * trial[j] ** 2).sum())
            if not value <= state.objective[i] + 1e-13 * abs(state.objective[i]) and np.isfinite(state.objective[i]):
                state.rate[i] /= 2
                state.active[i] = state.rate[i] > 1e-6
                continue
            state.weights[i], state.objective[i] = trial[j], value
            free = ~fixed[i].ravel()
            g = (grad[j] / z[fold_of[i]] + penalty[i] * trial[j]).ravel()
            h = curve[j] / z[fold_of[i]] + np.diag(penalty[i].ravel())
            step = np.zeros(g.size)
            step[free] = -np.linalg.lstsq(h[np.ix_(free, free)], g[free], rcond=1e-14)[0]
            state.direction[i], state.rate[i] = step.reshape(k, -1), 1.0
            state.active[i] = -float(g @ step) > o.tolerance
        state.step += 1
        taken += 1
        if o.eval_every and state.step % o.eval_every == 0:
            judge()
        if state_path:
            _write_state(spark, state_path, state)
    if m:
        judge()
    if not o.eval_every:  # the weights of the last step
        state.best = state.weights
    weights, aucs = {}, {}
    for f in usable.tolist():
        own = np.flatnonzero(fold_of == f)
        weights[folds[f]] = [state.best[i] for i in own]
        aucs[folds[f]] = [float(state.best_auc[i]) for i in own]
    return weights, aucs, {f: counts[i].astype(int).tolist() for i, f in enumerate(folds)}
