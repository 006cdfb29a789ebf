"""Classification metrics and losses against brute force (FIXTURES §5, §6)."""

import math
import random

import pytest

from cohera.operators.classification import classification_report, with_predictions
from cohera.operators.losses import focal_loss, weighted_cross_entropy


def _df(spark, rows):
    return spark.createDataFrame(rows, "label int, logits array<double>")


def _softmax(l):
    m = max(l)
    e = [math.exp(x - m) for x in l]
    return [x / sum(e) for x in e]


def brute(rows):
    y = [r[0] for r in rows]
    p = [_softmax(r[1])[1] for r in rows]
    pred = [max(range(len(r[1])), key=lambda i: (_softmax(r[1])[i], -i)) for r in rows]
    tp = sum(1 for a, b in zip(y, pred) if a == 1 and b == 1)
    fp = sum(1 for a, b in zip(y, pred) if a != 1 and b == 1)
    fn = sum(1 for a, b in zip(y, pred) if a == 1 and b != 1)
    f1 = 2 * tp / (2 * tp + fp + fn) if (2 * tp + fp + fn) else 0.0
    acc = sum(1 for a, b in zip(y, pred) if a == b) / len(y)
    pos = [s for s, t in zip(p, y) if t == 1]
    neg = [s for s, t in zip(p, y) if t != 1]
    auc = None
    if pos and neg:
        auc = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg) / (len(pos) * len(neg))
    ap = None
    if pos:
        ap = 0.0
        for s in sorted(set(p), reverse=True):
            ge = [t for q, t in zip(p, y) if q >= s]
            at = sum(1 for q, t in zip(p, y) if q == s and t == 1)
            ap += at / len(pos) * (sum(ge) / len(ge))
    return f1, auc, acc, ap


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_report_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.randint(0, 1), [0.0, round(rnd.gauss(0, 1), 1)]) for _ in range(300)]  # many ties
    got = classification_report(_df(spark, rows)).first()
    f1, auc, acc, ap = brute(rows)
    assert got.f1 == pytest.approx(f1, abs=1e-9)
    assert got.roc_auc == pytest.approx(auc, abs=1e-9)
    assert got.accuracy == pytest.approx(acc, abs=1e-9)
    assert got.pr_auc == pytest.approx(ap, abs=1e-9)


def test_edge_cases(spark):
    one_class = classification_report(_df(spark, [(1, [0.0, 1.0]), (1, [0.0, 2.0])])).first()
    assert one_class.roc_auc is None
    no_pos_pred = classification_report(_df(spark, [(1, [1.0, 0.0]), (0, [2.0, 0.0])])).first()
    assert no_pos_pred.f1 == 0.0
    ties = with_predictions(_df(spark, [(1, [0.5, 0.5])])).first()
    assert ties.y_pred == 0  # equal logits go to class 0


def _ce(l, y):
    return -math.log(_softmax(l)[y])


def test_losses(spark):
    rnd = random.Random(9)
    rows = [(rnd.randint(0, 1), [rnd.gauss(0, 2), rnd.gauss(0, 2)]) for _ in range(200)]
    df = _df(spark, rows)
    plain = sum(_ce(l, y) for y, l in rows) / len(rows)
    assert weighted_cross_entropy(df).first().loss == pytest.approx(plain, abs=1e-8)
    assert focal_loss(df, gamma=0.0).first().loss == pytest.approx(plain, abs=1e-8)
    w = [1.0, 3.0]
    wce = sum(w[y] * _ce(l, y) for y, l in rows) / sum(w[y] for y, _ in rows)
    assert weighted_cross_entropy(df, class_weights=w).first().loss == pytest.approx(wce, abs=1e-8)
    alpha, g = [0.25, 0.75], 2.0
    terms = [alpha[y] * -(1 - _softmax(l)[y]) ** g * math.log(_softmax(l)[y]) for y, l in rows]
    assert focal_loss(df, alpha=alpha, gamma=g).first().loss == pytest.approx(sum(terms) / len(terms), abs=1e-8)
    assert focal_loss(df, alpha=alpha, gamma=g, reduction="sum").first().loss == pytest.approx(sum(terms), abs=1e-7)
    per_row = focal_loss(df, alpha=alpha, gamma=g, reduction="none")
    assert per_row.count() == 200 and "loss" in per_row.columns
    with pytest.raises(ValueError):
        focal_loss(df, reduction="max")
