"""Splits (FIXTURES §8) and cross-validation summaries (FIXTURES §7)."""

import statistics

import pytest
from pyspark.sql import functions as F

from cohera.operators import splits as SP
from cohera.operators.folds import cv_summary, run_folds


def _recs(spark, n, groups=None):
    rows = [(i, f"text {i}.", (groups[i % len(groups)] if groups else None)) for i in range(n)]
    return spark.createDataFrame(rows, "record_id long, summary string, source string")


def test_exact_sizes(spark):
    recs = _recs(spark, 100)
    held, _, m = SP.split_exact(recs, 0.29)
    assert m == 28 and recs.where(held).count() == 28
    held0, _, m0 = SP.split_exact(recs, 0.0)
    assert m0 == 0 and recs.where(held0).count() == 0
    with pytest.raises(ValueError):
        SP.split_exact(recs, None)


def test_random_plan_disjoint_complete(spark):
    recs = _recs(spark, 257)
    plan = SP.random_holdout(recs, 0.2, 0.2, num_splits=3, seed=11)
    t = SP.split_table(recs, plan)
    sizes = {(r.fold, r.role): r.n for r in SP.split_sizes(t).collect()}
    for f in (1, 2, 3):
        assert sizes[(f, "test")] == int(257 * 0.2)
        rest = 257 - int(257 * 0.2)
        assert sizes[(f, "val")] == int(rest * (0.2 / 0.8))
        assert sum(v for (ff, _), v in sizes.items() if ff == f) == 257
    per = t.groupBy("fold", "record_id").count()
    assert per.where(F.col("count") != 1).count() == 0
    tests = [set(r.record_id for r in t.where((F.col("fold") == f) & (F.col("role") == "test")).collect())
             for f in (1, 2, 3)]
    assert tests[0] != tests[1]  # independent reshuffles


def test_random_plan_repeatable_across_partitions(spark):
    recs = _recs(spark, 300)
    a = SP.split_table(recs.repartition(1), SP.random_holdout(recs.repartition(1), num_splits=2, seed=3))
    b = SP.split_table(recs.repartition(9), SP.random_holdout(recs.repartition(9), num_splits=2, seed=3))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_test_size_one_and_no_test(spark):
    recs = _recs(spark, 40)
    plan = SP.random_holdout(recs, test_size=1.0, val_size=0.2)
    assert plan.sizes[1] == {"test": 40, "val": 0, "train": 0}
    nt = SP.split_table(recs, SP.no_test_split(recs, 0.25, 1))
    assert {r.role for r in nt.collect()} == {"train", "val"}
    assert nt.where(F.col("role") == "val").count() == 10


def test_group_plan(spark):
    recs = _recs(spark, 50, groups=["a", "b", None, "c"])
    plan = SP.leave_one_group_out(recs, "source", seed=2)
    assert list(plan.fold_numbers()) == [1, 2, 3, 4]
    rows = plan.groups.orderBy("fold").collect()
    assert [r.test_group for r in rows] == ["a", "b", None, "c"]  # first-seen order, null kept
    assert all(r.val_group != r.test_group for r in rows)
    t = SP.split_table(recs.select("record_id", "source"), plan)
    assert t.count() == 50  # one row per record
    assert t.where("test_fold = 3").count() == recs.where(F.col("source").isNull()).count()
    for f, r in enumerate(rows, 1):
        split = SP.fold_split(recs, plan, f)
        assert {x.source for x in split.where("role = 'test'").collect()} == {r.test_group}
        assert {x.source for x in split.where("role = 'val'").collect()} == {r.val_group}
        val = {x.record_id for x in t.where(F.array_contains("val_folds", f)).collect()}
        assert val == {x.record_id for x in split.where("role = 'val'").collect()}
    with pytest.raises(IndexError):
        SP.leave_one_group_out(_recs(spark, 5, groups=["only"]), "source")
    two = SP.leave_one_group_out(_recs(spark, 5, groups=["only"]), "source", no_test=True)
    assert list(two.fold_numbers()) == [1]


def test_many_groups(spark):
    """Five thousand groups: nothing is nested, collected or ordered in one task."""
    recs = spark.range(0, 10_000).select(F.col("id").alias("record_id"), (F.col("id") % 5000).cast("string").alias("source"))
    plan = SP.leave_one_group_out(recs, "source", seed=4)
    t = SP.split_table(recs, plan)
    got = t.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("test_fold").alias("folds"), F.min("test_fold").alias("lo"),
                F.max("test_fold").alias("hi"), F.sum(F.size("val_folds")).alias("vals")).first()
    assert tuple(got) == (10_000, 5000, 1, 5000, 10_000)  # every fold validates on one group of two records


def test_many_random_folds(spark):
    recs = _recs(spark, 30)
    plan = SP.random_holdout(recs, 0.2, 0.25, num_splits=400)
    sizes = SP.split_sizes(SP.split_table(recs, plan)).groupBy("role").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).collect()
    assert {r.role: (r.lo, r.hi) for r in sizes} == {"test": (6, 6), "val": (7, 7), "train": (17, 17)}


def test_empty_test_folds_are_zeros(spark):
    from cohera.plans import jobs as J

    long, summary = J.cv_lexical(_recs(spark, 20), "random", None, test_size=0.01, cv=2)
    rows = long.collect()
    assert {r.fold for r in rows} == {1, 2} and {r.value for r in rows} == {0.0}
    assert "test_recall@3" in {r.metric for r in summary.collect()}


def test_running_sums_over_many_buckets(spark):
    from cohera.plans.prefix import running_sums

    df = spark.range(0, 5000).select((F.col("id") * 7 % 5003).alias("o"), (F.col("id") % 11).alias("v"))
    rows = sorted((r.o, r.v, r.cum_v) for r in running_sums(df, "o", ["v"], n_buckets=37).collect())
    total = 0
    for _, v, cum in rows:
        total += v
        assert cum == total


def test_unknown_split_type(spark):
    with pytest.raises(ValueError):
        SP.make_splits(_recs(spark, 5), "stratified")
    with pytest.raises(ValueError):
        SP.make_splits(_recs(spark, 5), "key", None)


def test_cv_summary(spark):
    long = spark.createDataFrame([(1, "m", 0.5), (2, "m", 0.7), (3, "m", 0.9), (1, "one", 0.3)],
                                 "fold int, metric string, value double")
    got = {r.metric: r for r in cv_summary(long).collect()}
    assert got["m"].mean == pytest.approx(0.7)
    assert got["m"].std == pytest.approx(statistics.stdev([0.5, 0.7, 0.9]))
    assert got["one"].std == 0.0


def test_run_folds_isolates_failure(spark):
    recs = _recs(spark, 30, groups=["a", "b", "c"])
    plan = SP.leave_one_group_out(recs, "source", seed=1)

    def fit(train, val, fold):
        return train.count()

    def evaluate(model, test):
        if test.where(F.col("source") == "b").count():
            raise RuntimeError("boom")
        return test.agg(F.count(F.lit(1)).alias("n"))

    out = run_folds(spark, recs, plan, fit, evaluate)
    status = {r.fold: r.status for r in out.collect()}
    assert sorted(set(status.values())) == ["failed", "ok"]
    with pytest.raises(RuntimeError):
        run_folds(spark, recs, plan, fit, lambda m, t: (_ for _ in ()).throw(RuntimeError("all")))


def test_nth_smallest_multilevel_matches_sort(spark):
    """Force several narrowing levels (tiny buckets) and compare with a sort."""
    from cohera.functions.keys import key60
    from cohera.plans.prefix import nth_smallest, nth_smallest_by_group

    ids = spark.range(0, 3000).select(F.col("id").alias("record_id"))
    keyed = ids.select("record_id", key60(F.lit(1), F.col("record_id")).alias("k"))
    rows = sorted((r.k, r.record_id) for r in keyed.collect())
    for m in (1, 17, 1500, 3000):
        assert nth_smallest(keyed, "k", "record_id", m, bits=2, final_rows=5) == rows[m - 1]
    g = keyed.withColumn("g", (F.col("record_id") % 3).cast("int"))
    got = nth_smallest_by_group(g, "g", "k", "record_id", {0: 5, 1: 999, 2: 0}, bits=3, final_rows=10)
    for grp, m in ((0, 5), (1, 999)):
        want = sorted((r.k, r.record_id) for r in g.where(F.col("g") == grp).collect())[m - 1]
        assert got[grp] == want
    assert got[2] is None
