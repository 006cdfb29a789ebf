"""Training losses over ``(label, logits)`` rows.

* weighted cross entropy: ``sum(w_y * nll) / sum(w_y)`` (the weighted-mean
  reduction); plain mean without weights.
* focal loss: ``-(1 - p_t)^gamma * log p_t``, times ``alpha[y]`` when given;
  ``mean`` divides by the row count even with ``alpha``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import log_softmax_at

REDUCTIONS = ("none", "mean", "sum")
ROUND = 9


def _class_value(values, label: Column) -> Column:
    arr = F.array(*[F.lit(float(v)) for v in values])
    return F.element_at(arr, label.cast("int") + 1)


def focal_term(label: str = "label", logits: str = "logits", alpha=None, gamma: float = 2.0) -> Column:
    """Per-row focal loss; gamma 0 without alpha is plain cross entropy."""
    y = F.col(label)
    log_pt = log_softmax_at(logits, y)
    loss = -F.pow(1 - F.exp(log_pt), F.lit(float(gamma))) * log_pt
    if alpha is not None:
        loss = _class_value(alpha, y) * loss
    return loss


def focal_loss(df: DataFrame, label: str = "label", logits: str = "logits", alpha=None, gamma: float = 2.0,
               reduction: str = "mean") -> DataFrame:
    """``reduction='none'`` adds a ``loss`` column; otherwise one row."""
    if reduction not in REDUCTIONS:
        raise ValueError(f"reduction must be one of {REDUCTIONS}")
    term = focal_term(label, logits, alpha, gamma)
    if reduction == "none":
        return df.withColumn("loss", term)
    agg = F.avg(term) if reduction == "mean" else F.sum(term)
    return df.agg(F.round(agg, ROUND).alias("loss"))


def weighted_cross_entropy(df: DataFrame, label: str = "label", logits: str = "logits",
                           class_weights=None) -> DataFrame:
    """One row ``loss``: class-weighted mean negative log-likelihood."""
    y = F.col(label)
    nll = -log_softmax_at(logits, y)
    if class_weights is None:
        return df.agg(F.round(F.avg(nll), ROUND).alias("loss"))
    w = _class_value(class_weights, y)
    return df.agg(F.round(F.sum(w * nll) / F.sum(w), ROUND).alias("loss"))
