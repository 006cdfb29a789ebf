"""Model scoring and training (re-aim of transformer fine-tuning).

* ``score_candidates``: any per-text classifier through
  ``predict_batch_udf`` (Arrow batches cut across texts, the model loaded
  once per Python worker), keeping the class-1 softmax as the score.
* ``train_classifier``: logistic regression on candidate features for two or
  more classes, under weighted log loss or focal loss (``train_focal``).
* ``select_best_model``: the regularisation whose model has the best exact
  validation ROC AUC; it can judge during training and go on after a stop.
  Both train through ``many_models``: Newton steps, each one pass.
* ``save_model`` / ``load_model``: a model as one JSON row.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scoring import softmax_positive
from ..session import ensure_checkpoint_dir
from .many_models import FOLD_COLUMNS, Options, fit_models, training_rows

#: candidate features, made by ``plans.jobs.scored_candidates``
FEATURES = ("lexical", "first_overlap", "last_overlap", "skip_overlap", "length_change", "first_length")


@dataclass
class LinearModel:
    """Weights of a two-class linear model over named features."""
    features: list[str]
    weights: list[float]
    bias: float
    reg_param: float = 0.0

    def margin(self) -> Column:
        return sum((F.lit(w) * F.col(f) for f, w in zip(self.features, self.weights)), F.lit(self.bias))

    def logits(self) -> Column:
        return F.array(F.lit(0.0), self.margin())


@dataclass
class SoftmaxModel:
    """A linear model of several classes: weights and bias per class; class 0 is the reference, all zeros."""
    features: list[str]
    weights: list[list[float]]
    bias: list[float]
    reg_param: float = 0.0

    def logits(self) -> Column:
        return F.array(*[LinearModel(self.features, w, b).margin() for w, b in zip(self.weights, self.bias)])


def as_model(features, weights: np.ndarray, reg_param: float) -> LinearModel | SoftmaxModel:
    """Weights of ``many_models`` (classes - 1, bias and features) as a model."""
    names = list(features)
    if len(weights) == 1:
        return LinearModel(names, weights[0, 1:].tolist(), float(weights[0, 0]), reg_param)
    return SoftmaxModel(names, [[0.0] * len(names), *weights[:, 1:].tolist()], [0.0, *weights[:, 0].tolist()], reg_param)


def score_candidates(cands: DataFrame, make_predict_fn, text: str = "text", num_labels: int = 2,
                     batch_size: int = 64, out: str = "score") -> DataFrame:
    """Add ``out``: class-1 softmax of a text classifier's logits.

    ``make_predict_fn()`` returns ``fn(texts: np.ndarray) -> np.ndarray`` of
    shape ``(batch, num_labels)``; it runs inside the Python workers. The
    score is class 1's share of the softmax over all ``num_labels`` logits.
    """
    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
                            input_tensor_shapes=None)
    logits = F.slice(udf(F.col(text)), 1, num_labels)
    return cands.withColumn("logits", logits).withColumn(out, softmax_positive("logits")).drop("logits")


def _fit(train: DataFrame, val: DataFrame | None, label: str, features, reg_params, options: Options,
         state_path: str | None = None, stop_after: int | None = None):
    """(models, AUCs) per regularisation value, trained together over one written table."""
    ensure_checkpoint_dir(train.sparkSession)
    rows = training_rows(train.drop(*FOLD_COLUMNS), features, label)
    if val is not None:
        rows = rows.union(training_rows(val.drop(*FOLD_COLUMNS).withColumn("val_folds", F.array(F.lit(1))), features, label))
    weights, aucs, counts = fit_models(rows.checkpoint(), [1], len(features), reg_params, options, state_path, stop_after)
    if 1 not in weights:
        raise ValueError(f"training needs rows of class 0 and of another class; rows per class are {counts[1]}")
    return [as_model(features, w, rp) for w, rp in zip(weights[1], reg_params)], aucs[1]


def train_classifier(train: DataFrame, label: str = "label", features=FEATURES, class_weights=None,
                     reg_param: float = 0.0, max_iter: int = 50, num_labels: int = 2) -> LinearModel | SoftmaxModel:
    """Fit a logistic regression of ``num_labels`` classes; ``class_weights[y]`` weighs each row.

    Rows with a null label or feature are left out. A class without rows gets
    probability near zero; without rows of class 0 or of any other class this
    raises. Two classes give a ``LinearModel``, more a ``SoftmaxModel``.
    """
    o = Options(num_labels, class_weights, max_iter=max_iter)
    return _fit(train, None, label, features, (reg_param,), o)[0][0]


def train_focal(train: DataFrame, label: str = "label", features=FEATURES, alpha=None, gamma: float = 2.0,
                reg_param: float = 0.0, steps: int = 60, num_labels: int = 2) -> LinearModel | SoftmaxModel:
    """Fit the same model under focal loss.

    The loss of a row with true-class probability ``p`` is
    ``-alpha_y (1 - p)^gamma log p``, averaged over rows; ``gamma`` 0 without
    ``alpha`` is log loss.
    """
    o = Options(num_labels, alpha, gamma, focal=True, max_iter=steps)
    return _fit(train, None, label, features, (reg_param,), o)[0][0]


def model_logits(model: LinearModel | SoftmaxModel, df: DataFrame) -> DataFrame:
    """The model's logits per row (class 0 has 0): their softmax gives its probabilities."""
    return df.withColumn("logits", model.logits())


def select_best_model(train: DataFrame, val: DataFrame, reg_params=(0.0, 0.01, 0.1), label: str = "label", features=FEATURES,
                      class_weights=None, alpha=None, gamma: float | None = None, num_labels: int = 2, max_iter: int = 50,
                      eval_every: int = 0, state_path: str | None = None, stop_after: int | None = None):
    """``(model, reg_param, val_roc_auc)`` with the best validation ROC AUC; the first of equals.

    All values are trained together. With ``eval_every`` the models are judged
    every so many steps and the best weights seen are kept. With
    ``state_path`` each step's state is written there (a folder that driver
    and executors share) and a run that stopped goes on from the last one;
    ``stop_after`` stops a run after that many steps.
    """
    focal = gamma is not None
    o = Options(num_labels, alpha if focal else class_weights, gamma or 0.0, focal, max_iter, eval_every=eval_every)
    models, aucs = _fit(train, val, label, features, reg_params, o, state_path, stop_after)
    i = int(np.argmax(aucs))
    return models[i], reg_params[i], aucs[i]


def save_model(spark: SparkSession, model: LinearModel | SoftmaxModel, path: str) -> None:
    """The model as one JSON row in the folder ``path``."""
    spark.createDataFrame([(json.dumps(asdict(model)),)], "model string").coalesce(1).write.mode("overwrite").text(path)


def save_fold_models(spark: SparkSession, models: dict, path: str) -> None:
    """The model of each fold as one JSON row in the folder ``path/fold=<fold>``."""
    rows = spark.createDataFrame([(f, json.dumps(asdict(m))) for f, m in models.items()], "fold int, model string")
    rows.coalesce(1).write.mode("overwrite").partitionBy("fold").text(path)


def load_model(spark: SparkSession, path: str) -> LinearModel | SoftmaxModel:
    raw = json.loads(spark.read.text(path).first()["value"])
    return (SoftmaxModel if isinstance(raw["bias"], list) else LinearModel)(**raw)
