"""Reported metric names."""

from __future__ import annotations


def metric_name(column: str) -> str:
    """Column name to the reported metric name (``recall_at_3`` -> ``recall@3``)."""
    for prefix in ("recall", "ndcg"):
        if column.startswith(prefix + "_at_"):
            return prefix + "@" + column[len(prefix) + 4:]
    return column
