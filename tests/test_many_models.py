"""Models trained together: against pyspark.ml, alone, across a stop, and with several classes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cohera.operators.many_models import Options, _look, fit_models, grouped_roc_auc, training_rows
from cohera.operators.models import (LinearModel, SoftmaxModel, load_model, model_logits, save_fold_models, select_best_model,
                                     train_classifier)

NAMES = ["a", "b", "flat"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        a, b = rng.normal(3, 2), rng.normal(-1, 0.5)
        y = int(rng.random() < 1 / (1 + np.exp(-(0.8 * a - 1.2 * b - 3))))
        rows.append((i, y, int(rng.integers(0, 3)) if i % 4 else y, float(a), float(b), 7.0, [i % 5 + 1], [(i // 5) % 5 + 1]))
    rows += [(900, None, 0, 1.0, 1.0, 7.0, None, None), (901, 1, 1, None, 1.0, 7.0, None, None)]  # left out
    df = spark.createDataFrame(rows, "record_id bigint, label int, three int, a double, b double, flat double, "
                                     "val_folds array<int>, test_folds array<int>")
    return df.repartition(5).checkpoint()


@pytest.mark.parametrize("weights, reg", [(None, 0.0), ([1.0, 4.0], 0.1)])
def test_two_classes_equal_the_library(table, weights, reg):
    own = train_classifier(table, features=NAMES, class_weights=weights, reg_param=reg)
    x = VectorAssembler(inputCols=NAMES, outputCol="x").transform(table.dropna(subset=["label", *NAMES]))
    x = x.withColumn("w", F.when(F.col("label") == 1, (weights or [1, 1])[1]).otherwise(1.0).cast("double"))
    ref = LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", regParam=reg, maxIter=200, tol=1e-12).fit(x)
    assert isinstance(own, LinearModel) and own.weights == pytest.approx(list(ref.coefficients), abs=2e-4)
    assert own.bias == pytest.approx(ref.intercept, abs=1e-3) and own.weights[2] == 0.0


def test_together_equals_alone(spark, table):
    rows = training_rows(table, NAMES).checkpoint()
    many, aucs, counts = fit_models(rows, [1, 2, 3, 4, 5], 3, (0.0, 0.05), Options())
    one, auc, _ = fit_models(rows, [3], 3, (0.05,), Options())
    assert np.allclose(many[3][1], one[3][0], atol=1e-8) and aucs[3][1] == auc[3][0]
    part = table.where(~F.array_contains("val_folds", 3) & ~F.array_contains("test_folds", 3))
    plain = train_classifier(part.drop("val_folds", "test_folds"), features=NAMES, reg_param=0.05)
    assert np.allclose([plain.bias, *plain.weights], one[3][0][0], atol=1e-8)
    assert sum(counts[3]) == part.where("label is not null and a is not null").count()


@pytest.mark.parametrize("focal", [False, True])
def test_several_classes_end_at_a_minimum(spark, table, focal):
    o = Options(4, [1.0, 2.0, 0.5, 1.0], 2.0 if focal else 0.0, focal)
    rows = training_rows(table, ["a", "b"], "three").withColumn("val_folds", F.array().cast("array<int>")).checkpoint()
    weights, _, counts = fit_models(rows, [1], 2, (0.0,), o)
    _, grad, _ = _look(rows, [1], np.zeros(1, int), weights[1][0][None], o)
    assert np.abs(grad[0, :2]).max() < 1e-2 and weights[1][0][2].tolist() == [-30.0, 0.0, 0.0]  # class 3 has no rows
    assert counts[1][3] == 0


def test_softmax_model_scores_and_is_saved(spark, table, scratch):
    model = train_classifier(table, "three", NAMES[:2], reg_param=0.01, num_labels=3)
    assert isinstance(model, SoftmaxModel)
    save_fold_models(spark, {2: model}, f"{scratch}/models")
    assert load_model(spark, f"{scratch}/models/fold=2") == model
    r = model_logits(model, table.where("a is not null").limit(1)).first()
    assert r["logits"] == pytest.approx([b + w[0] * r["a"] + w[1] * r["b"] for w, b in zip(model.weights, model.bias)])


def test_a_stopped_run_goes_on(table, scratch):
    train, val = table.where("record_id % 3 > 0"), table.where("record_id % 3 = 0")
    kw = {"features": NAMES, "eval_every": 1, "reg_params": (0.0, 1.0)}
    whole = select_best_model(train, val, **kw)
    select_best_model(train, val, state_path=f"{scratch}/state", stop_after=2, **kw)
    again = select_best_model(train, val, state_path=f"{scratch}/state", **kw)
    assert again[1:] == whole[1:] and again[0].weights == pytest.approx(whole[0].weights, abs=1e-9)
    with pytest.raises(ValueError):  # the state of other models
        select_best_model(train, val, features=NAMES, reg_params=(0.5,), state_path=f"{scratch}/state")


def test_one_class_cannot_be_trained(table):
    with pytest.raises(ValueError):
        train_classifier(table.where("label = 1"), features=NAMES)


def test_grouped_roc_auc(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(s), int(y)) for g, s, y in zip(rng.integers(0, 4, 500), rng.integers(0, 30, 500) / 7, rng.integers(0, 2, 500))]
    rows += [(9, 0.5, 1), (9, 0.7, 1)]
    got = {r["g"]: r["roc_auc"] for r in grouped_roc_auc(spark.createDataFrame(rows, "g int, p1 double, label int"), ["g"]).collect()}
    for g in range(4):
        pos = [s for h, s, y in rows if h == g and y]
        neg = [s for h, s, y in rows if h == g and not y]
        assert got[g] == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)))
    assert got[9] is None
