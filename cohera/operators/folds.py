"""Cross-validation: per-fold test metrics and their summary.

With a fixed scorer every item is scored once; its test folds are then a
row-wise function of the fold plan (random folds) or one join with the fold
table (group folds), so all folds are evaluated by one grouped aggregate
instead of a loop of jobs. Linear models of all folds are trained and tested
together (``run_folds_together``); ``run_folds`` is the loop for any other
``fit``, each fold being ordinary Spark jobs.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .many_models import fit_models, model_scores
from .ranking import items_from_scores, metric_name, ranking_report, regroup_scores
from .splits import FoldPlan, fold_split, role_column, with_group_folds

ROUND = 9
log = logging.getLogger(__name__)


def test_folds(plan: FoldPlan, record_id: str = "record_id") -> Column:
    """``ARRAY<INT>`` of the random folds in which a record is in the test set."""
    if plan.no_test:
        return F.array().cast("array<int>")
    return F.filter(F.sequence(F.lit(1), F.lit(len(plan.folds))),
                    lambda f: role_column(plan, f, record_id) == "test")


def with_test_fold(items: DataFrame, plan: FoldPlan) -> DataFrame:
    """One row per item and fold that tests it, with its ``fold``."""
    if plan.kind == "key":
        x = with_group_folds(items, plan).drop("val_folds").withColumnRenamed("test_fold", "fold")
    else:
        # explode_outer + filter: a plain explode makes the optimizer infer a
        # size filter and push it (with the inlined expression) below the scoring
        x = items.withColumn("fold", F.explode_outer(test_folds(plan)))
    return x.where(F.col("fold").isNotNull())


def fold_reports(items: DataFrame, plan: FoldPlan, k_values=(3, 5, 10), compute_metrics=None) -> DataFrame:
    """One ranking report row per fold, over that fold's test items.

    ``total_items_in_dataset`` counts the fold's test records. A fold without
    test records has a row of zeros.
    """
    reports = ranking_report(with_test_fold(items, plan), k_values, ["fold"], compute_metrics)
    if plan.kind == "key" or plan.no_test:
        return reports  # every group has records
    folds = items.sparkSession.range(1, len(plan.folds) + 1).select(F.col("id").cast("int").alias("fold"))
    return folds.join(reports, "fold", "left").na.fill(0)


def fold_metrics_long(reports: DataFrame, fold: str = "fold") -> DataFrame:
    """``(fold, metric, value)`` from one-row-per-fold reports; metrics as they are reported (``recall@3``)."""
    metrics = [c for c in reports.columns if c != fold]
    pairs = ", ".join(f"'{metric_name(m)}', cast(`{m}` as double)" for m in metrics)
    return reports.selectExpr(f"cast({fold} as int) as fold", f"stack({len(metrics)}, {pairs}) as (metric, value)")


def prefix_metrics(long: DataFrame, prefix: str = "test_") -> DataFrame:
    """Fold metrics are logged as ``test_<metric>``."""
    return long.withColumn("metric", F.concat(F.lit(prefix), F.col("metric")))


def cv_summary(long: DataFrame) -> DataFrame:
    """``(metric, mean, std, n_folds)``: mean and *sample* std over folds.

    One fold gives std 0.0; nulls (non-numeric or failed) are left out.
    """
    v = F.col("value")
    return long.where(v.isNotNull()).groupBy("metric").agg(
        F.round(F.avg(v), ROUND).alias("mean"),
        F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), ROUND).alias("std"),
        F.count(v).alias("n_folds"),
    )


def summary_rows(summary: DataFrame) -> DataFrame:
    """``(name, value)`` with ``<metric>_avg`` and ``<metric>_std`` names."""
    return summary.select(F.explode(F.array(
        F.struct(F.concat(F.col("metric"), F.lit("_avg")).alias("name"), F.col("mean").alias("value")),
        F.struct(F.concat(F.col("metric"), F.lit("_std")).alias("name"), F.col("std").alias("value")),
    )).alias("r")).select("r.name", "r.value")


FOLD_RESULT_SCHEMA = T.StructType([
    T.StructField("fold", T.IntegerType()), T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("status", T.StringType()),
])


def run_folds(spark, records: DataFrame, plan: FoldPlan, fit, evaluate, no_test: bool | None = None) -> DataFrame:
    """Per fold: split, ``fit(train, val, fold)``, ``evaluate(model, test)``.

    ``evaluate`` returns a one-row report DataFrame. A failing fold is
    logged, recorded as ``status='failed'`` and the loop goes on; if no fold
    succeeds the error is raised. Returns ``(fold, metric, value, status)``
    with metrics prefixed ``test_``.
    """
    no_test = plan.no_test if no_test is None else no_test
    rows, errors = [], []

    def one_fold(f):
        split = fold_split(records, plan, f)
        model = fit(split.where(F.col("role") == "train"), split.where(F.col("role") == "val"), f)
        if no_test:
            return [(f, None, None, "trained")]
        rep = evaluate(model, split.where(F.col("role") == "test")).collect()
        if not rep:
            return [(f, None, None, "empty")]
        return [(f, "test_" + metric_name(k), float(v), "ok") for k, v in rep[0].asDict().items()
                if isinstance(v, (int, float)) and not isinstance(v, bool)]

    done = 0
    for f in plan.fold_numbers():
        done += 1
        rows += isolate_fold_failure(f, one_fold, errors)
    if errors and len(errors) == done:
        raise errors[0]
    return spark.createDataFrame(rows, FOLD_RESULT_SCHEMA)


def with_fold_roles(records: DataFrame, plan: FoldPlan) -> DataFrame:
    """Records with ``val_folds`` and ``test_folds``; a record trains in all other folds."""
    none = F.array().cast("array<int>")
    if plan.kind == "key":
        x = with_group_folds(records, plan)
        tests = F.when(F.col("test_fold").isNull(), none).otherwise(F.array("test_fold"))
        return x.withColumn("test_folds", tests).drop("test_fold")
    roles = F.transform(F.sequence(F.lit(1), F.lit(len(plan.folds))), lambda f: F.struct(f.alias("f"), role_column(plan, f).alias("r")))
    x = records.withColumn("_roles", roles)

    def folds_of(role):
        return F.transform(F.filter("_roles", lambda z: z["r"] == role), lambda z: z["f"])

    return x.withColumns({"val_folds": folds_of("val"), "test_folds": folds_of("test")}).drop("_roles")


def run_folds_together(rows: DataFrame, folds: list[int], features, reg_params, options, no_test: bool = False,
                       compute_metrics=None):
    """All folds trained, selected and tested together: ``(results, models)``.

    ``rows`` as ``many_models.training_rows`` makes them, with ``record_id``,
    ``cand_idx`` and ``n_neg``, written once. Every regularisation of every
    fold is trained in the same passes; the one with the best validation ROC
    AUC (the first of equals) scores the fold's test rows, and all folds are
    reported by one grouped aggregate. ``results`` is as ``run_folds`` gives
    it; a fold that cannot be trained is 'failed', and if none can, this
    raises. ``models`` is ``{fold: (weights, reg_param, val_roc_auc)}``.
    """
    spark = rows.sparkSession
    weights, aucs, counts = fit_models(rows, folds, len(features), reg_params, options)
    if not weights:
        raise ValueError(f"no fold has training rows of class 0 and another class: {counts}")
    models = {}
    for f, w in weights.items():
        i = max(range(len(w)), key=lambda j: (aucs[f][j], -j))
        models[f] = (w[i], reg_params[i], aucs[f][i])
    lost = [(f, None, None, "failed") for f in folds if f not in weights]
    for f, *_ in lost:
        log.error("fold %s cannot be trained: rows per class are %s", f, counts[f])
    if no_test:
        return spark.createDataFrame([(f, None, None, "trained") for f in models] + lost, FOLD_RESULT_SCHEMA), models
    scored = model_scores(rows, "test_folds", {f: [m[0]] for f, m in models.items()},
                          {"record_id": rows.schema["record_id"].dataType.simpleString(), "cand_idx": "int", "n_neg": "int"})
    key = F.struct("fold", "record_id").alias("record_id")
    items = items_from_scores(regroup_scores(scored.select(key, "cand_idx", "n_neg", F.col("p1").alias("score"))))
    reports = ranking_report(items.withColumn("fold", F.col("record_id.fold")), group_by=["fold"], compute_metrics=compute_metrics)
    known = spark.createDataFrame([(f,) for f in models], "fold int")
    long = prefix_metrics(fold_metrics_long(known.join(reports, "fold", "left").na.fill(0)))
    return long.withColumn("status", F.lit("ok")).union(spark.createDataFrame(lost, FOLD_RESULT_SCHEMA)), models


def isolate_fold_failure(fold: int, work, errors: list) -> list:
    """Run one fold; an error is logged and kept, and the fold is marked failed."""
    try:
        return work(fold)
    except Exception as e:  # one fold's failure must not stop the others
        log.error("fold %s failed: %s", fold, e)
        errors.append(e)
        return [(fold, None, None, "failed")]
