"""Binary classification metrics over ``(label, logits)`` rows.

``f1``, ``accuracy``: one partial aggregate. ``roc_auc`` (exact, ties count
one half) and ``average_precision`` (step-wise, no interpolation) need
running counts over the score order: rows are first reduced to one row per
distinct score (map-side combine), then ``running_sums`` adds the counts
without a single-task sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import predict_label, softmax
from ..plans.prefix import running_sums

ROUND = 9


def with_predictions(df: DataFrame, label: str = "label", logits: str = "logits") -> DataFrame:
    """``y``, ``p1`` (class-1 softmax), ``y_pred`` (argmax, ties to class 0)."""
    probs = softmax(logits)
    return (df.select(F.col(label).cast("int").alias("y"), probs.alias("_p"))
            .select("y", F.element_at("_p", 2).alias("p1"), predict_label("_p").alias("y_pred")))


def confusion_counts(pred: DataFrame) -> DataFrame:
    """One row: ``n, tp, fp, fn, correct, positives, negatives``."""
    y, p = F.col("y"), F.col("y_pred")
    return pred.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y != 1) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p != 1)).alias("fn"),
        F.count_if(y == p).alias("correct"),
        F.count_if(y == 1).alias("positives"),
        F.count_if(y != 1).alias("negatives"),
    )


def accuracy(pred: DataFrame) -> DataFrame:
    return confusion_counts(pred).select(
        F.round(F.coalesce(F.try_divide(F.col("correct").cast("double"), F.col("n").cast("double")),
                           F.lit(0.0)), ROUND).alias("accuracy"))


def f1(pred: DataFrame) -> DataFrame:
    """Binary F1 for class 1; 0.0 when there is no tp, fp or fn."""
    c = confusion_counts(pred)
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return c.select(F.round(F.when(den > 0, 2.0 * F.col("tp") / den).otherwise(F.lit(0.0)), ROUND).alias("f1"))


def score_table(pred: DataFrame) -> DataFrame:
    """One row per distinct class-1 probability, with running counts taken
    from the highest score down (``cum_pos``, ``cum_neg`` include the row).

    Confusion counts ride along: they are additive, so the same partial
    aggregate carries them and no second pass is needed.
    """
    y, p = F.col("y"), F.col("y_pred")
    per_score = pred.groupBy(F.col("p1")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg"),
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y != 1) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p != 1)).alias("fn"), F.count_if(y == p).alias("correct"),
    ).withColumn("_desc", -F.col("p1"))
    return running_sums(per_score, "_desc", ["pos", "neg"])


def _areas_and_counts(pred: DataFrame) -> DataFrame:
    t = score_table(pred)
    cp, cn = F.col("cum_pos"), F.col("cum_neg")
    return t.agg(
        F.sum(F.col("neg") * (cp - 0.5 * F.col("pos"))).alias("_auc_num"),
        F.sum(F.when(F.col("pos") > 0, F.col("pos") * (cp / (cp + cn)))).alias("_ap_num"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.sum("correct").alias("correct"),
    )


def _finish(agg: DataFrame) -> DataFrame:
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    auc = F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("_auc_num") / (P * N))
    ap = F.when(F.col("P") > 0, F.col("_ap_num") / P)
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f1_ = F.when(den > 0, 2.0 * F.col("tp") / den).otherwise(F.lit(0.0))
    acc = F.coalesce(F.try_divide(F.col("correct").cast("double"), P + N), F.lit(0.0))
    return agg.select(F.round(f1_, ROUND).alias("f1"), F.round(auc, ROUND).alias("roc_auc"),
                      F.round(acc, ROUND).alias("accuracy"), F.round(ap, ROUND).alias("pr_auc"))


def ranking_areas(pred: DataFrame) -> DataFrame:
    """One row: ``roc_auc`` (exact, ties one half; null with one class) and
    ``pr_auc`` (average precision: sum over scores, descending, of
    ``pos/P * precision``)."""
    return _finish(_areas_and_counts(pred)).select("roc_auc", "pr_auc")


def roc_auc(pred: DataFrame) -> DataFrame:
    return ranking_areas(pred).select("roc_auc")


def average_precision(pred: DataFrame) -> DataFrame:
    return ranking_areas(pred).select("pr_auc")


def classification_report(df: DataFrame, label: str = "label", logits: str = "logits") -> DataFrame:
    """One row ``f1, roc_auc, accuracy, pr_auc`` from labels and logits."""
    return _finish(_areas_and_counts(with_predictions(df, label, logits)))
