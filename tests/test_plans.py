"""Plan properties that matter at scale (guards against silent regressions)."""

import json
import os

import __spark_entry__ as E
from cohera.sources.records import read_records
from conftest import SF001


def _plans(df):
    qe = df._jdf.queryExecution()
    return qe.optimizedPlan().toString(), qe.executedPlan().toString()


def test_flagship_computes_each_heavy_expression_once(spark):
    opt, phys = _plans(E.queries()["ranking_report"](spark, SF001))
    assert opt.count("array_intersect") == 1       # pair overlaps: once per candidate
    assert opt.count("lower(") == 1                # word sets: once per text
    assert opt.count("md5(") == 3                  # enumerate branch + two sampling passes
    assert "BroadcastHashJoin" in phys             # fixed permutation table, broadcast
    # exchanges: the spread that the query asks for and the one-row aggregate only
    assert phys.count("Exchange hashpartitioning") <= 1
    assert "posexplode" not in opt                 # negatives are not exploded
    assert phys.count("Exchange SinglePartition") == 1


def test_filters_on_scores_are_not_duplicated(spark):
    for name in ("rank_of_original", "rankable", "lexical_coherence", "labelled_pairs"):
        opt, _ = _plans(E.queries()[name](spark, SF001))
        assert opt.count("md5(") <= 4, name
        assert opt.count("array_intersect") <= 1, name


def test_jsonl_filter_pushed_and_columns_pruned(spark, scratch):
    p = os.path.join(scratch, "r.jsonl")
    with open(p, "w") as f:
        f.write(json.dumps({"text_raw": "r", "summary": "A. B.", "metadata": {"source": "s"}}) + "\n")
    df = read_records(spark, p).select("record_id", "summary")
    _, phys = _plans(df)
    assert "PushedFilters: [IsNotNull(summary), Not(EqualTo(summary,))" in phys
    assert df.count() == 1
