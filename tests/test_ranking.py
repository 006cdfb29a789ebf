"""Ranking metrics on scored candidates (FIXTURES §4) and the report."""

import math

import pytest
from pyspark.sql import functions as F

from cohera.operators.ranking import (
    item_pair_score,
    items_from_scores,
    normalize_k_values,
    ranking_report,
    report_order,
    report_rows,
)


def _items(spark, score_lists):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(score_lists)], "record_id long, scores array<double>")
    return items_from_scores(df)


def test_item_values(spark):
    it = {r.record_id: r for r in _items(spark, [[0.9, 0.1, 0.2], [0.5, 0.5, 0.1], [0.2, 0.9, 0.1], [0.9]]).collect()}
    assert (it[0].rank, it[0].wins) == (1, 2)
    assert (it[1].rank, it[1].wins) == (1, 1)       # tie favours the original, but loses the pair
    assert (it[2].rank, it[2].wins) == (2, 1)
    assert not it[3].rankable


def test_report_values(spark):
    rep = ranking_report(_items(spark, [[0.9, 0.1, 0.2], [0.5, 0.5, 0.1], [0.2, 0.9, 0.1], [0.9]])).first()
    assert rep.total_items_in_dataset == 4 and rep.evaluated_items_count == 3
    assert rep.top_1_success_count == 2 and rep.top_1_failure_count == 1
    assert rep.top_1_accuracy == pytest.approx(2 / 3)
    assert rep.mean_reciprocal_rank == pytest.approx((1 + 1 + 0.5) / 3)
    assert rep.pair_correct_count == 4 and rep.pair_total_count == 6
    assert rep.pair_ranking_accuracy == pytest.approx(4 / 6)
    assert rep.avg_margin_victory == pytest.approx((0.7 + 0.0) / 2)
    assert rep.avg_margin_defeat == pytest.approx(0.7)
    assert rep.ndcg_at_3 == pytest.approx((1 + 1 + 1 / math.log2(3)) / 3)
    pos = [0.9, 0.5, 0.2]
    mean = sum(pos) / 3
    assert rep.std_positive_score == pytest.approx(math.sqrt(sum((p - mean) ** 2 for p in pos) / 3))
    negs = [0.1, 0.2, 0.5, 0.1, 0.9, 0.1]
    assert rep.avg_negative_score == pytest.approx(sum(negs) / 6)


def test_empty_report_is_zero(spark):
    rep = ranking_report(_items(spark, [[0.9], [0.3]])).first().asDict()
    assert rep["total_items_in_dataset"] == 2 and rep["evaluated_items_count"] == 0
    assert all(v == 0 for k, v in rep.items() if k != "total_items_in_dataset")
    rows = {r.metric: r.text for r in report_rows(ranking_report(_items(spark, [[0.9]]))).collect()}
    assert rows["top_1_success_count"] == "0.0000" and rows["evaluated_items_count"] == "0"


def test_pair_score_minus_one(spark):
    ps = {r.record_id: r.pair_score for r in item_pair_score(_items(spark, [[0.9, 0.1, 0.95], [0.4]])).collect()}
    assert ps == {0: 0.5, 1: -1.0}


def test_report_order_and_format(spark):
    rows = report_rows(ranking_report(_items(spark, [[0.9, 0.1, 0.2]]))).orderBy("ord").collect()
    names = [r.metric for r in rows]
    assert names[:3] == ["total_items_in_dataset", "evaluated_items_count", "top_1_success_count"]
    assert names[-6:] == ["recall@3", "recall@5", "recall@10", "ndcg@3", "ndcg@5", "ndcg@10"]
    by = {r.metric: r.text for r in rows}
    assert by["std_positive_score"] == "0.000000" and by["top_1_accuracy"] == "1.0000"
    assert report_order(["zzz", "recall_at_10", "recall_at_3"]) == ["recall@3", "recall@10", "zzz"]


def test_normalize_k():
    assert normalize_k_values([10, 3, 3, 5]) == [3, 5, 10]


def test_null_model_near_chance(spark):
    """Scores unrelated to order: top-1 near mean 1/(1+n_neg), pairwise near 0.5."""
    import random

    rnd = random.Random(3)
    lists = [[rnd.random() for _ in range(1 + rnd.randint(1, 20))] for _ in range(3000)]
    rep = ranking_report(_items(spark, lists)).first()
    chance = sum(1 / len(s) for s in lists) / len(lists)
    assert abs(rep.top_1_accuracy - chance) < 0.03
    assert abs(rep.pair_ranking_accuracy - 0.5) < 0.03
