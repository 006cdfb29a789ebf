"""Ranking metrics: the original (candidate 0) against its shuffles.

Per item first (in the row, no exchange), then one global aggregate whose
partial step runs map-side, so the only exchange carries one partial row
per task. ``pos`` is the score of candidate 0, ``neg_scores`` the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import metric_name
from ..session import fenced_where

DEFAULT_K_VALUES = (3, 5, 10)
#: a caller's metrics: aggregate columns by name
Metrics = Callable[[], dict[str, Column]]
ROUND = 9  # metric decimals kept; float sums differ in the last bits by order

# Report order of the metric names, and the names printed as
# integers. Unlisted names follow in their own order.
REPORT_ORDER = [
    "total_items_in_dataset",
    "evaluated_items_count",
    "top_1_success_count",
    "top_1_failure_count",
    "top_1_accuracy",
    "mean_reciprocal_rank",
    "pair_ranking_accuracy",
    "pair_correct_count",
    "pair_total_count",
    "avg_len_shuffled",
    "avg_len_shuffled_success",
    "avg_len_shuffled_failure",
    "avg_positive_score",
    "std_positive_score",
    "avg_negative_score",
    "std_negative_score",
    "avg_margin_victory",
    "avg_margin_defeat",
]
INTEGER_METRICS = {"total_items_in_dataset", "evaluated_items_count", "top_1_success_count",
                   "top_1_failure_count", "pair_correct_count", "pair_total_count"}


def normalize_k_values(k_values) -> list[int]:
    """Unique, sorted cut-offs for recall@k and ndcg@k."""
    return sorted(set(int(k) for k in k_values))


def rank_of_original(pos: Column, neg_scores: Column) -> Column:
    """1-based position of candidate 0 in a stable descending sort.

    Ties favour the original (it comes first), so only strictly greater
    negatives push it down; no sort is needed.
    """
    return (1 + F.size(F.filter(neg_scores, lambda x: x > pos))).cast("int")


def pair_wins(pos: Column, neg_scores: Column) -> Column:
    """Negatives strictly below the original; ties lose, NaN never wins."""
    return F.size(F.filter(neg_scores, lambda x: (pos > x) & ~F.isnan(pos))).cast("int")


def items_from_scores(df: DataFrame, scores: str = "scores") -> DataFrame:
    """Per-item ranking values from an in-row score array (index 0 first)."""
    sc = F.col(scores)
    n_neg = (F.size(sc) - 1).cast("int")
    df = (
        df.withColumn("n_neg", n_neg)
        .withColumn("pos", F.element_at(sc, 1))
        .withColumn("neg_scores", F.when(F.col("n_neg") > 0, F.slice(sc, 2, F.col("n_neg")))
                    .otherwise(F.array().cast("array<double>")))
    )
    return (
        df.withColumn("rankable", F.col("n_neg") > 0)
        .withColumn("rank", F.when(F.col("rankable"), rank_of_original(F.col("pos"), F.col("neg_scores"))))
        .withColumn("wins", F.when(F.col("rankable"), pair_wins(F.col("pos"), F.col("neg_scores"))))
        .withColumn("max_neg", F.when(F.col("rankable"), F.array_max("neg_scores")))
    )


def rankable(items: DataFrame) -> DataFrame:
    """Items with at least one shuffle (others cannot be ranked)."""
    return fenced_where(items, F.col("n_neg") > 0)


def regroup_scores(scored: DataFrame, record_id: str = "record_id", cand_idx: str = "cand_idx",
                   score: str = "score", n_neg: str = "n_neg") -> DataFrame:
    """``(record_id, scores, complete)``: scored candidates as items, none dropped.

    ``complete`` is false where the score count differs from ``1 + n_neg``;
    such an item keeps only its first score, so it counts in totals but
    cannot be ranked. Groups hold at most ``k_max + 1`` rows.
    """
    grouped = scored.groupBy(record_id).agg(
        F.sort_array(F.collect_list(F.struct(F.col(cand_idx).alias("i"), F.col(score).alias("s")))).alias("_c"),
        F.max(n_neg).alias("_n_neg"),
        F.count(score).alias("_n_scores"),
    )
    complete = F.col("_n_scores") == F.col("_n_neg") + 1
    all_scores = F.transform("_c", lambda z: z["s"])
    return grouped.select(record_id, F.when(complete, all_scores).otherwise(F.slice(all_scores, 1, 1)).alias("scores"),
                          complete.alias("complete"))


def candidate_count_ok(scored: DataFrame, record_id: str = "record_id", cand_idx: str = "cand_idx",
                       score: str = "score", n_neg: str = "n_neg") -> DataFrame:
    """The items of ``regroup_scores`` that have a score for every candidate."""
    items = regroup_scores(scored, record_id, cand_idx, score, n_neg)
    return items.where("complete").select(record_id, "scores")


def item_pair_score(items: DataFrame, record_id: str = "record_id") -> DataFrame:
    """``wins / n_neg`` per item, ``-1.0`` when the text has no shuffle."""
    return with_pair_score(items).select(record_id, "pair_score")


def with_pair_score(items: DataFrame) -> DataFrame:
    """Items with their ``pair_score`` (see ``item_pair_score``) in place."""
    return items.withColumn("pair_score", F.when(F.col("n_neg") > 0, F.col("wins") / F.col("n_neg")).otherwise(F.lit(-1.0)))


def _r(c: Column) -> Column:
    return F.round(c, ROUND)


def ranking_report(items: DataFrame, k_values=DEFAULT_K_VALUES, group_by: list[str] | None = None,
                   compute_metrics: Metrics | None = None) -> DataFrame:
    """All ranking metrics in one aggregate (one row, or one per group).

    Pooled negative-score statistics come from each item's own count, mean
    and sum of squared deviations, merged in the aggregate; nothing is
    exploded. Every metric is 0.0 when nothing could be evaluated;
    ``total_items_in_dataset`` counts unrankable items too.

    ``compute_metrics`` adds a caller's own metrics to the same pass: it
    returns aggregates over the item columns ``rankable``, ``rank``,
    ``n_neg``, ``wins``, ``pos`` and ``max_neg`` by name. Spark merges them as
    it does its own, per group. They are neither rounded nor set to zero.
    """
    ks = normalize_k_values(k_values)
    group_by = group_by or []
    negs, m = F.col("neg_scores"), F.size("neg_scores")
    total = F.aggregate(negs, F.lit(0.0), lambda acc, s: acc + s)
    x = items.select(*group_by, "rankable", "rank", "n_neg", "wins", "pos", "max_neg", "neg_scores",
                     m.alias("_m"), F.when(m > 0, total / m).alias("_mean"))
    x = x.withColumn("_m2", F.when(F.col("_m") > 0, F.aggregate(
        negs, F.lit(0.0), lambda acc, s: acc + (s - F.col("_mean")) * (s - F.col("_mean")))))
    x = x.drop("neg_scores")
    ev = F.col("rankable")
    top = ev & (F.col("rank") == 1)
    miss = ev & (F.col("rank") > 1)
    aggs = [
        F.count(F.lit(1)).alias("total_items_in_dataset"),
        F.count_if(ev).alias("evaluated_items_count"),
        F.count_if(top).alias("top_1_success_count"),
        F.count_if(miss).alias("top_1_failure_count"),
        F.avg(F.when(ev, (F.col("rank") == 1).cast("double"))).alias("top_1_accuracy"),
        F.avg(F.when(ev, 1.0 / F.col("rank"))).alias("mean_reciprocal_rank"),
        F.sum(F.when(ev, F.col("wins"))).cast("bigint").alias("pair_correct_count"),
        F.sum(F.when(ev, F.col("n_neg"))).cast("bigint").alias("pair_total_count"),
        F.avg(F.when(ev, F.col("n_neg"))).alias("avg_len_shuffled"),
        F.avg(F.when(top, F.col("n_neg"))).alias("avg_len_shuffled_success"),
        F.avg(F.when(miss, F.col("n_neg"))).alias("avg_len_shuffled_failure"),
        F.avg(F.when(ev, F.col("pos"))).alias("avg_positive_score"),
        F.stddev_pop(F.when(ev, F.col("pos"))).alias("std_positive_score"),
        F.sum("_m").alias("_n"), F.sum(F.col("_m") * F.col("_mean")).alias("_s1"),
        F.sum(F.col("_m") * F.col("_mean") * F.col("_mean")).alias("_s2"), F.sum("_m2").alias("_dev"),
        F.avg(F.when(top, F.col("pos") - F.col("max_neg"))).alias("avg_margin_victory"),
        F.avg(F.when(miss, F.col("max_neg") - F.col("pos"))).alias("avg_margin_defeat"),
    ]
    for k in ks:
        aggs.append(F.avg(F.when(ev, (F.col("rank") <= k).cast("double"))).alias(f"recall_at_{k}"))
    for k in ks:
        aggs.append(F.avg(F.when(ev, F.when(F.col("rank") <= k, 1.0 / F.log2(F.col("rank") + 1))
                                 .otherwise(F.lit(0.0)))).alias(f"ndcg_at_{k}"))
    own = dict(compute_metrics()) if compute_metrics else {}
    taken = sorted(set(own) & {*REPORT_ORDER, *group_by, *(f"{m}_at_{k}" for m in ("recall", "ndcg") for k in ks)})
    if taken:
        raise ValueError(f"compute_metrics names metrics of the report: {taken}")
    agg = x.groupBy(*group_by).agg(*aggs, *(c.alias(f"_own_{name}") for name, c in own.items()))
    mean = F.try_divide(F.col("_s1"), F.col("_n"))
    spread = F.col("_dev") + F.col("_s2") - F.col("_n") * mean * mean
    agg = agg.withColumns({"avg_negative_score": mean,
                           "std_negative_score": F.sqrt(F.greatest(F.try_divide(spread, F.col("_n")), F.lit(0.0)))})

    out = list(group_by)
    for name in ["total_items_in_dataset", "evaluated_items_count", "top_1_success_count",
                 "top_1_failure_count"]:
        out.append(F.col(name).cast("bigint").alias(name))
    zero = F.lit(0.0)
    doubles = ["top_1_accuracy", "mean_reciprocal_rank"]
    out += [_r(F.coalesce(F.col(c), zero)).alias(c) for c in doubles]
    pt, pc = F.coalesce(F.col("pair_total_count"), F.lit(0)), F.coalesce(F.col("pair_correct_count"), F.lit(0))
    out += [
        _r(F.coalesce(F.try_divide(pc.cast("double"), pt.cast("double")), zero)).alias("pair_ranking_accuracy"),
        pc.cast("bigint").alias("pair_correct_count"),
        pt.cast("bigint").alias("pair_total_count"),
    ]
    rest = ["avg_len_shuffled", "avg_len_shuffled_success", "avg_len_shuffled_failure",
            "avg_positive_score", "std_positive_score", "avg_negative_score", "std_negative_score",
            "avg_margin_victory", "avg_margin_defeat"]
    rest += [f"recall_at_{k}" for k in ks] + [f"ndcg_at_{k}" for k in ks]
    out += [_r(F.coalesce(F.col(c), zero)).alias(c) for c in rest]
    return agg.select(*out, *(F.col(f"_own_{name}").alias(name) for name in own))


def report_order(columns: list[str]) -> list[str]:
    """Print order: the fixed list, then recall@k and ndcg@k by k, then the rest."""
    names = [metric_name(c) for c in columns]
    ordered = [m for m in REPORT_ORDER if m in names]
    ordered += sorted((m for m in names if m.startswith("recall@")), key=lambda m: int(m.split("@")[1]))
    ordered += sorted((m for m in names if m.startswith("ndcg@")), key=lambda m: int(m.split("@")[1]))
    ordered += [m for m in names if m not in ordered]
    return ordered


def report_rows(report: DataFrame) -> DataFrame:
    """Long, printable form ``(ord, metric, value, text)`` of a one-row report.

    Six decimals for names holding ``std_`` or ``margin_``, four otherwise;
    integer counts print bare. With nothing evaluated the top-1 counts are
    floats (0.0000), as the empty report defines them.
    """
    cols = report.columns
    by_metric = {metric_name(c): c for c in cols}
    order = report_order(cols)
    pairs = ", ".join(f"{i + 1}, '{m}', cast(`{by_metric[m]}` as double)" for i, m in enumerate(order))
    long = report.selectExpr(
        "evaluated_items_count AS _ev",
        f"stack({len(order)}, {pairs}) AS (ord, metric, value)",
    )
    is_int = F.col("metric").isin(sorted(INTEGER_METRICS)) & ~(
        F.col("metric").isin("top_1_success_count", "top_1_failure_count") & (F.col("_ev") == 0))
    six = F.col("metric").contains("std_") | F.col("metric").contains("margin_")
    text = (
        F.when(is_int, F.col("value").cast("bigint").cast("string"))
        .when(six, F.format_string("%.6f", F.col("value")))
        .otherwise(F.format_string("%.4f", F.col("value")))
    )
    return long.select(F.col("ord").cast("int").alias("ord"), "metric", _r(F.col("value")).alias("value"),
                       text.alias("text"))


# Metric groups of the report, each a projection of the one aggregate (a
# caller wanting several groups should select them from ``ranking_report``).
METRIC_GROUPS = {
    "top1": ["top_1_success_count", "top_1_accuracy"],
    "pairwise_accuracy": ["pair_correct_count", "pair_total_count", "pair_ranking_accuracy"],
    "mean_reciprocal_rank": ["mean_reciprocal_rank"],
    "shuffle_count_stats": ["avg_len_shuffled", "avg_len_shuffled_success", "avg_len_shuffled_failure"],
    "top1_counts": ["top_1_success_count", "top_1_failure_count"],
    "margins": ["avg_margin_victory", "avg_margin_defeat"],
    "positive_score_stats": ["avg_positive_score", "std_positive_score"],
    "negative_score_stats": ["avg_negative_score", "std_negative_score"],
    "item_counts": ["total_items_in_dataset", "evaluated_items_count", "pair_total_count"],
}


def _group(name: str, items: DataFrame) -> DataFrame:
    return ranking_report(items).select(*METRIC_GROUPS[name])


def top1(items: DataFrame) -> DataFrame:
    """Count and rate of items whose original ranks first."""
    return _group("top1", items)


def pairwise_accuracy(items: DataFrame) -> DataFrame:
    """Strictly-greater pairs over all pairs, pooled over items."""
    return _group("pairwise_accuracy", items)


def mean_reciprocal_rank(items: DataFrame) -> DataFrame:
    return _group("mean_reciprocal_rank", items)


def recall_at_k(items: DataFrame, k_values=DEFAULT_K_VALUES) -> DataFrame:
    """Share of items whose original ranks within k, per k."""
    return ranking_report(items, k_values).select(*[f"recall_at_{k}" for k in normalize_k_values(k_values)])


def ndcg_at_k(items: DataFrame, k_values=DEFAULT_K_VALUES) -> DataFrame:
    """Mean of ``1/log2(rank+1)`` when rank <= k, else 0, per k."""
    return ranking_report(items, k_values).select(*[f"ndcg_at_{k}" for k in normalize_k_values(k_values)])


def shuffle_count_stats(items: DataFrame) -> DataFrame:
    """Mean shuffle count: all evaluated items, top-1 successes, failures."""
    return _group("shuffle_count_stats", items)


def top1_counts(items: DataFrame) -> DataFrame:
    return _group("top1_counts", items)


def margins(items: DataFrame) -> DataFrame:
    """Victory margin ``pos - max(negs)`` and defeat margin ``max(negs) - pos``."""
    return _group("margins", items)


def positive_score_stats(items: DataFrame) -> DataFrame:
    """Mean and population std of the original's score."""
    return _group("positive_score_stats", items)


def negative_score_stats(items: DataFrame) -> DataFrame:
    """Mean and population std pooled over every negative."""
    return _group("negative_score_stats", items)


def item_counts(items: DataFrame) -> DataFrame:
    """Items in the input, evaluated items, compared pairs."""
    return _group("item_counts", items)


def empty_result(items: DataFrame) -> DataFrame:
    """The report of items none of which can be ranked: every metric 0."""
    return ranking_report(fenced_where(items, ~F.col("rankable")))
