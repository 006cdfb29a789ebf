"""Readers, sinks, parameter rules and jobs (FIXTURES §1, §2)."""

import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cohera.plans import jobs as J
from cohera.sources.records import read_eval_csv, read_records, require_nonempty
from cohera.sources.sinks import commit_run, read_runs, run_group_name, write_fold_results, write_metrics

from conftest import SF001


def _jsonl(path, lines):
    with open(path, "w") as f:
        for line in lines:
            f.write(line if isinstance(line, str) else json.dumps(line))
            f.write("\n")
    return path


def test_jsonl_edge_lines(spark, scratch):
    p = _jsonl(os.path.join(scratch, "a.jsonl"), [
        {"text_raw": "r1", "summary": "A. B.", "metadata": {"source": "s1"}},
        {"text_raw": "r2", "metadata": {"source": "s1"}},
        {"text_raw": "r3", "summary": None, "metadata": {"source": "s1"}},
        {"text_raw": "r4", "summary": "", "metadata": {"source": "s1"}},
        {"summary": ""},
        {"text_raw": "r6", "summary": "   ", "metadata": {"source": "s2"}},
        {"text_raw": "r7", "summary": "C. D.", "metadata": {}},
    ])
    rows = sorted(read_records(spark, p).collect(), key=lambda r: r.text_raw)
    assert [r.text_raw for r in rows] == ["r1", "r6", "r7"]
    assert rows[2].source is None and rows[1].summary == "   "


def test_required_fields_and_errors(spark, scratch):
    p = _jsonl(os.path.join(scratch, "b.jsonl"), [{"text_raw": "r1", "summary": "A."}])
    with pytest.raises(Exception, match="record without required field: text_raw, metadata"):
        read_records(spark, p).collect()
    bad = _jsonl(os.path.join(scratch, "c.jsonl"), ['{"summary": "A.", "text_raw": ', ])
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILFAST|FAILED_READ_FILE"):
        read_records(spark, bad).collect()
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_records(spark, os.path.join(scratch, "missing.jsonl"))
    empty = _jsonl(os.path.join(scratch, "d.jsonl"), [{"summary": ""}])
    with pytest.raises(ValueError):
        require_nonempty(read_records(spark, empty))


def test_eval_csv_job(spark, scratch):
    csv = os.path.join(scratch, "bench_csv")
    spark.read.parquet(f"{SF001}/benchmark.parquet").coalesce(1).write.option("header", True) \
        .option("escape", '"').csv(csv)
    rows = read_eval_csv(spark, csv)
    assert "text" in rows.columns and rows.count() == 40
    out = os.path.join(scratch, "out")
    report, scored = J.evaluate_csv(spark, csv, out)
    rep = report.first()
    assert rep.total_items_in_dataset == 40
    s = scored.collect()
    assert len(s) == 40 and all(-1.0 <= r.pair_score <= 1.0 for r in s)
    assert sum(1 for r in s if r.pair_score == -1.0) == rep.total_items_in_dataset - rep.evaluated_items_count
    back = read_eval_csv(spark, f"{out}/test_data_predicted.csv")
    assert set(back.columns) == {"item_id", "text", "pair_score", "record_id"} and back.count() == 40
    metrics = spark.read.json(f"{out}/results.json").first().asDict()
    assert metrics["recall@3"] == rep["recall_at_3"] and "recall_at_3" not in metrics
    with pytest.raises(KeyError):
        read_eval_csv(spark, csv, text="nope")


def test_write_metrics(spark, scratch):
    rep = J.evaluate(spark.read.parquet(f"{SF001}/documents.parquet").selectExpr(
        "doc_id AS record_id", "text AS summary", "source"))
    write_metrics(rep, os.path.join(scratch, "m"))
    back = spark.read.json(os.path.join(scratch, "m")).first()
    assert back.total_items_in_dataset == rep.first().total_items_in_dataset


def test_validate_params():
    J.validate_params()
    with pytest.raises(ValueError):
        J.validate_params("random", "source")
    with pytest.raises(ValueError):
        J.validate_params("key", None)
    with pytest.raises(ValueError):
        J.validate_params(trainer_type="weighted")
    with pytest.raises(ValueError):
        J.validate_params(trainer_type="weighted", class_weights=[1.0])
    with pytest.raises(ValueError):
        J.validate_params(trainer_type="weighted", class_weights=[1.0, 2.0], focal_loss_alpha=[0.5, 0.5])
    with pytest.raises(ValueError):
        J.validate_params(trainer_type="focal", class_weights=[1.0, 2.0])
    with pytest.raises(ValueError):
        J.validate_params(trainer_type="focal", focal_loss_alpha=[1.0])
    with pytest.raises(ValueError):
        J.validate_params(trainer_type="default", focal_loss_alpha=[0.5, 0.5])
    with pytest.raises(ValueError):
        J.validate_params(trainer_type="mystery")
    J.validate_params(trainer_type="focal", focal_loss_alpha=[0.25, 0.75], focal_loss_gamma=1.0)


def test_run_group_name():
    name = run_group_name("weighted", "/models/base-model", 5)
    assert name.startswith("WEIGHTED_CV_base-model_") and len(name.rsplit("_", 1)[1]) == 8
    assert run_group_name("default", "m", 1).startswith("DEFAULT_Train_m_")


def test_train_job(spark, scratch):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").selectExpr(
        "doc_id AS record_id", "text AS summary", "source")
    folds, summary = J.train(spark, docs, "random", None, cv=2, reg_params=(0.0,), output_dir=scratch,
                             trainer_type="weighted", class_weights=[1.0, 5.0])
    rows = folds.collect()
    assert {r.status for r in rows} == {"ok"} and {r.fold for r in rows} == {1, 2}
    got = {r.metric: r for r in summary.collect()}
    assert got["test_evaluated_items_count"].n_folds == 2
    back = read_runs(spark, os.path.join(scratch, "fold_results"))
    assert back.select("run_group").distinct().count() == 1
    kept = {r.metric: r for r in read_runs(spark, os.path.join(scratch, "cv_summary")).collect()}
    assert kept["test_recall@3"].mean == got["test_recall@3"].mean and kept["test_recall@3"].job_type == "cv_summary"
    report = J.evaluate_saved(spark, docs, os.path.join(scratch, "models", "fold=1")).first()
    assert report.evaluated_items_count > 0


def test_train_by_key_and_without_test(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").selectExpr(
        "doc_id AS record_id", "text AS summary", "concat('g', doc_id % 3) AS source")
    folds, summary = J.train(spark, docs, "key", "source", reg_params=(0.01,))
    assert {r.fold for r in folds.collect()} == {1, 2, 3} and summary is not None
    folds, summary = J.train(spark, docs, "random", None, no_test=True, reg_params=(0.01,), trainer_type="focal",
                             focal_loss_alpha=[0.25, 0.75])
    assert [(r.fold, r.status) for r in folds.collect()] == [(1, "trained")] and summary is None


def _noisy(spark):
    import random

    rnd = random.Random(3)
    rows = []
    for _ in range(400):
        x = [rnd.gauss(0, 1) for _ in range(2)]
        rows.append((int(rnd.random() < 1 / (1 + 2.718281828 ** -(1.5 * x[0] - 0.5 * x[1] + 0.3))), *x, rnd.gauss(0, 1)))
    return spark.createDataFrame(rows, "label int, a double, b double, noise double")


def test_focal_without_focus_is_log_loss(spark):
    from cohera.operators.models import train_classifier, train_focal

    df, names = _noisy(spark).cache(), ["a", "b", "noise"]
    plain = train_classifier(df, features=names)
    focal = train_focal(df, features=names, gamma=0.0, steps=300)
    assert focal.weights == pytest.approx(plain.weights, abs=2e-3) and focal.bias == pytest.approx(plain.bias, abs=2e-3)
    other = train_focal(df, features=names, alpha=[0.1, 0.9], gamma=2.0, steps=100)
    assert other.bias > focal.bias + 0.3  # the weighted class is favoured


def test_best_model_differs_in_ranking(spark):
    from cohera.operators.models import load_model, model_logits, save_model, select_best_model
    from cohera.operators.classification import classification_report

    df = _noisy(spark).cache()
    aucs = {}
    for rp in (0.0, 0.01, 50.0):
        _, _, aucs[rp] = select_best_model(df.limit(30), df, (rp,), features=["a", "b", "noise"])
    model, rp, auc = select_best_model(df.limit(30), df, tuple(aucs), features=["a", "b", "noise"])
    assert auc == max(aucs.values()) and aucs[rp] == auc and len(set(aucs.values())) > 1


def test_saved_model_scores_alike(spark, scratch):
    from cohera.operators.models import load_model, save_model, train_classifier

    model = train_classifier(_noisy(spark), features=["a", "b"])
    save_model(spark, model, f"{scratch}/m")
    assert load_model(spark, f"{scratch}/m") == model


def test_record_ids_do_not_depend_on_the_layout(spark, scratch):
    from cohera.operators import splits as SP

    lines = [{"text_raw": f"r{i}", "summary": f"Text {i % 1500}. B.", "metadata": {"source": "s"}} for i in range(2000)]
    lines += [lines[7]] * 300  # equal lines
    p = _jsonl(os.path.join(scratch, "many.jsonl"), lines)
    held = []
    for size in ("128m", "64k", "8k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            recs = read_records(spark, p)
            plan = SP.random_holdout(recs, 0.2, 0.2)
            rows = SP.fold_split(recs, plan, 1).select("record_id", "summary", "role").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert len({r.record_id for r in rows}) == 2300
        assert sum(r.role == "test" for r in rows) == 460
        held.append(sorted((r.record_id, r.summary, r.role) for r in rows))
    assert held[0] == held[1] == held[2]


def test_mismatched_items_count_but_do_not_rank(spark):
    from cohera.operators.ranking import candidate_count_ok, items_from_scores, ranking_report, regroup_scores

    scored = spark.createDataFrame([(1, 0, 0.9, 2), (1, 1, 0.1, 2), (1, 2, 0.2, 2), (2, 0, 0.9, 2), (2, 1, 0.5, 2), (3, 0, 0.4, 0),
                                    (4, 0, None, 1), (4, 1, 0.2, 1)], "record_id long, cand_idx int, score double, n_neg int")
    assert sorted(r.record_id for r in candidate_count_ok(scored).collect()) == [1, 3]
    rep = ranking_report(items_from_scores(regroup_scores(scored))).first()
    assert (rep.total_items_in_dataset, rep.evaluated_items_count, rep.pair_total_count) == (4, 1, 2)


def test_normalized_original_and_splitter(spark):
    docs = spark.createDataFrame([(1, "One  a.\nTwo b."), (2, "x | y | z")], "record_id long, summary string")
    cands = J.model_candidates(docs, normalize_original=True).collect()
    assert [c.text for c in cands if c.record_id == 1 and c.cand_idx == 0] == ["One  a. Two b."]
    raw = J.model_candidates(docs).collect()
    assert [c.text for c in raw if c.record_id == 1 and c.cand_idx == 0] == ["One  a.\nTwo b."]
    bars = J.evaluate(docs, splitter=lambda c: F.split(c, r" \| "))
    assert bars.first().evaluated_items_count == 1
    cut = J.model_candidates(docs, max_length=2).where("record_id = 1").collect()
    assert all(c.truncated and len(c.text.split()) == 2 for c in cut)


def _exchanged(df) -> list[str]:
    """The input columns of every exchange in the plan."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    blocks = plan.split("\n\n")
    return [b for b in blocks if "Exchange\n" in b and "Input" in b]


def test_record_ids_move_no_texts(spark, scratch, monkeypatch):
    from cohera.sources import records as R

    lines = [{"text_raw": f"r{i}", "summary": f"Text {i}. B.", "metadata": {"source": "s"}} for i in range(300)]
    p = _jsonl(os.path.join(scratch, "one.jsonl"), lines)
    recs = read_records(spark, p)
    assert not _exchanged(recs) and recs.select("record_id").distinct().count() == 300
    p = _jsonl(os.path.join(scratch, "two.jsonl"), lines + [lines[3]] * 400 + [lines[5]] * 2)
    recs = read_records(spark, p)
    moved = _exchanged(recs)
    assert moved and not any("summary" in x or "text_raw" in x for x in moved)
    ids = sorted(r.record_id for r in recs.collect())
    assert len(set(ids)) == 702
    monkeypatch.setattr(R, "MAX_BROADCAST_ROWS", 0)  # the way beyond the broadcast bound
    assert sorted(r.record_id for r in read_records(spark, p).collect()) == ids
    first = {r.text_raw: r.record_id for r in recs.where("text_raw not in ('r3', 'r5')").collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        other = read_records(spark, p).cache()
        assert sorted(r.record_id for r in other.collect()) == ids
        assert {r.text_raw: r.record_id for r in other.where("text_raw not in ('r3', 'r5')").collect()} == first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


CSV = ('id,text,more\r\n1,"a ""quoted"" word",x\r\n2,"two\nlines, and\n\nmore",\r\n\r\n3,plain,"",\r\n'
       .replace('"",\r', '""\r') + '4,"ends\n""\n",é\r\n5,,"\n\n\n\n"\r\n6,"{}",z\r\n7,"last"'.format("long\nline\n" * 9) + ',w')


def _csv_rows(df):
    return sorted(tuple(r) for r in df.select("id", "text", "more").collect())


@pytest.mark.parametrize("text", [CSV, CSV.replace("\r\n", "\n"), "\r\n" + CSV + "\r\n"])
def test_csv_cut_anywhere(spark, scratch, text):
    import csv
    import io

    path = os.path.join(scratch, "t.csv")
    with open(path, "w", newline="") as f:
        f.write(text)
    norm = lambda rows: sorted((a, b or "", c or "") for a, b, c in rows)  # noqa: E731 (null or empty: compared below)
    want = norm([r for r in csv.reader(io.StringIO(text, newline="")) if r][1:])
    ids, whole = None, (spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))
    n = len(text.encode())
    for size in (5, 23, 64, n // 2 + 1):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            df = read_eval_csv(spark, path).cache()
            got = _csv_rows(df)
            assert norm(got) == want, size
            if "\r" not in text:
                assert got == _csv_rows(whole), size
            now = sorted(r.record_id for r in df.collect())
            ids = ids or now
            assert now == ids and len(set(now)) == len(want)
        finally:
            df.unpersist()
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv_of_many_files_and_errors(spark, scratch):
    rows = [(i, f"line {i}\n\"x\", y\n" * (i % 5), None if i % 7 else "m") for i in range(500)]
    path = os.path.join(scratch, "many")
    (spark.createDataFrame(rows, "id int, text string, more string").repartition(5).write.option("header", True)
     .option("escape", '"').option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        df = read_eval_csv(spark, path).cache()
        assert sorted((int(r.id), r.text or "", r.more) for r in df.collect()) == [(i, t, m) for i, t, m in rows]
        assert df.select("record_id").distinct().count() == 500
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    bad = os.path.join(scratch, "bad.csv")
    with open(bad, "w") as f:
        f.write("id,text\n1,a,b\n")
    with pytest.raises(Exception, match="MALFORMED"):
        read_eval_csv(spark, bad).collect()
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_eval_csv(spark, os.path.join(scratch, "none.csv"))
    empty = os.path.join(scratch, "empty.csv")
    with open(empty, "w") as f:
        f.write("id,text\n")
    assert read_eval_csv(spark, empty).count() == 0


def test_runs_are_committed_whole(spark, scratch):
    rows = spark.createDataFrame([(1, "test_x", 0.5, "ok"), (2, "test_x", 0.7, "ok")], "fold int, metric string, value double, status string")
    path = os.path.join(scratch, "runs")
    write_fold_results(rows, path, "a", {"cv": 2})
    write_fold_results(rows.where("fold = 1"), path, "b", {})
    write_fold_results(rows.withColumn("value", F.col("value") + 1), path, "a", {"cv": 2})  # run again: replaces
    got = sorted((r.run_group, r.fold, r.value) for r in read_runs(spark, path).collect())
    assert got == [("a", 1, 1.5), ("a", 2, 1.7), ("b", 1, 0.5)]
    broken = rows.withColumn("value", F.when(F.col("fold") == 2, F.raise_error(F.lit("boom")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="boom"):
        commit_run(broken.repartition(2, "fold"), path, "a")
    # rows written, but the job was lost before its commit
    (rows.withColumn("run_group", F.lit("c")).withColumn("attempt", F.lit("lost")).write.mode("append")
     .partitionBy("run_group", "attempt").parquet(f"{path}/rows"))
    assert sorted((r.run_group, r.fold, r.value) for r in read_runs(spark, path).drop("job_type", "config").collect()) == got
    assert read_runs(spark, path, "b").count() == 1 and set(read_runs(spark, path).columns) == {
        "run_group", "fold", "metric", "value", "status", "job_type", "config"}


def test_compute_metrics_runs_in_the_same_pass(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").where("doc_id < 40").selectExpr(
        "doc_id AS record_id", "text AS summary", "concat('g', doc_id % 3) AS source")

    def own():
        ev = F.col("rankable")
        return {"mrr_again": F.avg(F.when(ev, 1.0 / F.col("rank"))), "worst_rank": F.max(F.when(ev, F.col("rank"))),
                "top_again": F.count_if(ev & (F.col("rank") == 1))}

    rep = J.evaluate(docs, compute_metrics=own).first()
    assert round(rep.mrr_again, 9) == rep.mean_reciprocal_rank and rep.top_again == rep.top_1_success_count and rep.worst_rank > 1
    plain = J.evaluate(docs).first().asDict()
    assert plain == {k: v for k, v in rep.asDict().items() if k in plain} and len(rep) == len(plain) + 3
    long, summary = J.cv_lexical(docs, "key", "source", compute_metrics=own)
    got = {(r.fold, r.metric): r.value for r in long.collect()}
    assert all(got[f, "test_top_again"] == got[f, "test_top_1_success_count"] for f in (1, 2, 3))
    assert "test_worst_rank" in {r.metric for r in summary.collect()}
    folds, _ = J.train(spark, docs, "key", "source", reg_params=(0.01,), features=("lexical",), compute_metrics=own)
    by = {(r.fold, r.metric): r.value for r in folds.collect()}
    assert all(round(by[f, "test_mrr_again"], 9) == by[f, "test_mean_reciprocal_rank"] for f in (1, 2, 3))
    with pytest.raises(ValueError, match="top_1_accuracy"):
        J.evaluate(docs, compute_metrics=lambda: {"top_1_accuracy": F.count(F.lit(1))})
