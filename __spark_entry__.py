"""

Every query reads the driver's tables (``documents``, ``labels``,
``benchmark``) whole and returns a DataFrame whose column names match the
oracle SQL. Texts are represented by md5 digests and lengths where a query
would otherwise return megabytes of candidate text.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

_ROOT = os.path.dirname(os.path.abspath(__file__))
if _ROOT not in sys.path:  # loaded by file path: make the package importable
    sys.path.insert(0, _ROOT)

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import oracle_sql as O
from cohera.functions.scoring import logits_from_score, predict_label, softmax, softmax_positive
from cohera.operators import candidates as C
from cohera.operators.boundaries import learn_boundaries, learned_splitter
from cohera.operators import classification as CL
from cohera.operators import losses as L
from cohera.operators import ranking as RK
from cohera.operators.models import model_logits, select_best_model, train_classifier
from cohera.operators import splits as SP
from cohera.functions.sentences import sentence_count
from cohera.operators.shuffles import distinct_permutations, enumerable_sizes, permutation_table, shuffle_texts
from cohera.plans import jobs as J
from cohera.plans.evaluation import K_MAX, SEED, lexical_items, lexical_scores, sentence_table, shuffled
from cohera.session import ensure_checkpoint_dir, fenced_where, spread
from cohera.sources.records import filter_nonempty, flatten_record, group_key, read_documents, read_eval_csv, read_records, records_from_table

THRESHOLD = O.THRESHOLD
CLASS_WEIGHTS = [1.0, 5.0]
FOCAL_ALPHA = [0.25, 0.75]


def _ids(spark: SparkSession, sf: str) -> DataFrame:
    """The records as the scan gives them (splits read ids only)."""
    return read_documents(spark, sf)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    """The records dealt to three tasks per core: the tables come in one row group each."""
    return spread(read_documents(spark, sf), "record_id", 3 * spark.sparkContext.defaultParallelism)


def _report(spark, sf) -> DataFrame:
    return RK.ranking_report(lexical_items(_docs(spark, sf)))


def _items(spark, sf) -> DataFrame:
    return lexical_items(_docs(spark, sf))


def _orders_str(col):
    return F.array_join(col, ",")


def _shuffles(spark, sf) -> DataFrame:
    return shuffled(_docs(spark, sf))


def _scores_long(spark, sf) -> DataFrame:
    """(record_id, cand_idx, score) for every candidate of every text."""
    df = lexical_scores(_docs(spark, sf))
    x = df.select("record_id", (F.size("scores") - 1).alias("n_neg"), F.posexplode_outer("scores").alias("cand_idx", "score"))
    return x.select("record_id", F.col("cand_idx").cast("int").alias("cand_idx"), "score", "n_neg")


def _labelled_logits(spark, sf) -> DataFrame:
    """Labelled pairs with the fixed model's logits ``[0, score - T]``."""
    s = _scores_long(spark, sf)
    return s.select("record_id", "cand_idx", (F.col("cand_idx") == 0).cast("int").alias("label"),
                    logits_from_score("score", THRESHOLD).alias("logits"))


# ------------------------------------------------------------------ sources
def _folder(spark, kind: str) -> str:
    """A new folder in the session's shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def _rows_per_id(r: DataFrame) -> DataFrame:
    """``r`` with ``id_rows``: how many rows carry the reader's ``record_id`` (one, if the ids are right)."""
    return r.withColumn("id_rows", F.count(F.lit(1)).over(Window.partitionBy("record_id")))


def q_read_records(spark, sf):
    """``read_records`` on JSON lines that Spark writes from ``documents``; ``text_raw`` carries the doc_id."""
    folder = _folder(spark, "records")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.select(F.col("doc_id").cast("string").alias("text_raw"), F.col("text").alias("summary"),
                F.struct(F.col("source")).alias("metadata")).write.json(folder)
    r = read_records(spark, folder).select("record_id", F.col("text_raw").cast("bigint").alias("doc_id"), "source",
                                           F.length("summary").cast("bigint").alias("n_chars"), F.md5("summary").alias("summary_md5"))
    return _rows_per_id(r).drop("record_id")


def q_filter_nonempty(spark, sf):
    raw = spark.read.parquet(f"{sf}/documents.parquet")
    return filter_nonempty(raw, "text").agg(F.count(F.lit(1)).alias("n_kept"))


# ---------------------------------------------------------------- sentences
def q_split_sentences(spark, sf):
    st = sentence_table(_docs(spark, sf))
    return st.select("record_id", F.size("sentences").cast("int").alias("n_sentences"),
                     F.md5(F.array_join("sentences", "\u0001")).alias("sentences_md5"))


def q_learned_boundaries(spark, sf):
    return learn_boundaries(_docs(spark, sf)).withColumn("score", F.round("score", 6))


def q_learned_sentences(spark, sf):
    """Sentences by the boundaries that the same texts teach."""
    docs = _docs(spark, sf)
    st = sentence_table(docs, splitter=learned_splitter(learn_boundaries(docs)))
    return st.select("record_id", F.size("sentences").cast("int").alias("n_sentences"),
                     F.md5(F.array_join("sentences", "\u0001")).alias("sentences_md5"))


def q_sentence_count(spark, sf):
    st = sentence_table(_docs(spark, sf))
    return st.groupBy(sentence_count("sentences").cast("int").alias("n_sentences")).agg(
        F.count(F.lit(1)).alias("n_texts"))


def q_shuffle_plan(spark, sf):
    return _shuffles(spark, sf).select("record_id", F.col("n_sentences").cast("int").alias("n_sentences"),
                                       F.col("want").cast("int").alias("want"), "method")


def q_distinct_permutations(spark, sf):
    sh = fenced_where(_shuffles(spark, sf), F.col("method") == "enumerate")
    table = F.broadcast(permutation_table(spark, enumerable_sizes(K_MAX)))
    j = sh.join(table, sh["n_sentences"] == table["perm_n"])
    return j.select("record_id", F.size(distinct_permutations(F.col("perms"), F.col("canon")))
                    .cast("bigint").alias("n_distinct"))


def _neg_rows(df):
    return df.select("record_id", F.posexplode_outer("negs").alias("cand_idx", "o")).where(F.col("o").isNotNull()).select(
        "record_id", (F.col("cand_idx") + 1).cast("int").alias("cand_idx"), _orders_str(F.col("o")).alias("order_str"))


def q_sample_permutations(spark, sf):
    return _neg_rows(fenced_where(_shuffles(spark, sf), F.col("method") == "enumerate"))


def q_sample_shuffles(spark, sf):
    return _neg_rows(fenced_where(_shuffles(spark, sf), F.col("method") == "sample"))


def q_join_sentences(spark, sf):
    sh = _shuffles(spark, sf)
    x = sh.select("record_id", F.posexplode_outer(shuffle_texts()).alias("cand_idx", "text")).where(F.col("text").isNotNull())
    return x.select("record_id", (F.col("cand_idx") + 1).cast("int").alias("cand_idx"),
                    F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("text_len"))


def q_generate_shuffles(spark, sf):
    sh = _shuffles(spark, sf)
    joined = F.array_join(F.transform("negs", lambda o: F.array_join(o, ",")), ";")
    return sh.select("record_id", F.col("n_neg").cast("bigint").alias("n_neg"), F.md5(joined).alias("shuffles_md5"))


# --------------------------------------------------------------- candidates
def q_labelled_pairs(spark, sf):
    lp = C.labelled_pairs(_shuffles(spark, sf))
    return lp.select("record_id", "cand_idx", "label", F.md5("text").alias("text_md5"),
                     F.length("text").cast("bigint").alias("text_len"))


def q_ranking_candidates(spark, sf):
    rc = C.ranking_candidates(_shuffles(spark, sf))
    return rc.select("record_id", "cand_idx", F.col("n_neg").cast("bigint").alias("n_neg"),
                     F.md5("text").alias("text_md5"))


def q_truncate_tokens(spark, sf):
    tt = C.truncate_tokens(C.ranking_candidates(_shuffles(spark, sf)), max_length=512)
    return tt.select("record_id", "cand_idx", F.col("n_tokens").cast("bigint").alias("n_tokens"), "truncated",
                     F.md5("text_trunc").alias("trunc_md5"))


# ------------------------------------------------------------------ scoring
def q_lexical_coherence(spark, sf):
    return _scores_long(spark, sf).select("record_id", "cand_idx", F.round("score", 9).alias("score"))


def q_softmax_positive(spark, sf):
    lg = _labelled_logits(spark, sf)
    return lg.select("record_id", "cand_idx", F.round(softmax_positive("logits"), 9).alias("p1"))


def q_predict_label(spark, sf):
    lg = _labelled_logits(spark, sf)
    return lg.select("record_id", "cand_idx", "label", predict_label(softmax("logits")).alias("y_pred"))


def q_weighted_cross_entropy(spark, sf):
    return L.weighted_cross_entropy(_labelled_logits(spark, sf), class_weights=CLASS_WEIGHTS)


def q_focal_loss(spark, sf):
    lg = _labelled_logits(spark, sf)
    t_alpha = L.focal_term(alpha=FOCAL_ALPHA, gamma=2.0)
    return lg.agg(F.round(F.avg(t_alpha), 9).alias("loss_mean"),
                  F.round(F.sum(t_alpha), 9).alias("loss_sum"),
                  F.round(F.avg(L.focal_term(gamma=0.0)), 9).alias("loss_gamma0"))


# ------------------------------------------------------------------ ranking
def q_rank_of_original(spark, sf):
    it = RK.rankable(_items(spark, sf))
    return it.select("record_id", F.col("rank").cast("int").alias("rank"), F.col("n_neg").cast("bigint").alias("n_neg"),
                     F.col("wins").cast("bigint").alias("wins"), F.round("pos", 9).alias("pos"),
                     F.round("max_neg", 9).alias("max_neg"))


def q_rankable(spark, sf):
    return RK.rankable(_items(spark, sf)).select("record_id", F.col("n_neg").cast("bigint").alias("n_neg"))


def q_item_pair_score(spark, sf):
    ps = RK.item_pair_score(_items(spark, sf))
    return ps.select("record_id", F.round("pair_score", 9).alias("pair_score"))


def q_candidate_count_ok(spark, sf):
    ok = RK.candidate_count_ok(_scores_long(spark, sf))
    return ok.select("record_id", F.size("scores").cast("bigint").alias("n_scores"))


def q_empty_result(spark, sf):
    return RK.empty_result(_items(spark, sf).where(F.col("n_sentences") < 2))


def q_report_rows(spark, sf):
    return RK.report_rows(_report(spark, sf))


# ------------------------------------------------------------ classification
def _pred(spark, sf):
    return CL.with_predictions(_labelled_logits(spark, sf))


def q_quality_classification(spark, sf):
    """Quality labels (``labels``) predicted from the original's coherence.

    A plain equi-join on the id: AQE turns it into a broadcast join at run
    time only when the measured label side is small, so nothing of a size
    that grows with the data is broadcast blindly.
    """
    items = _items(spark, sf).select("record_id", "pos")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(
        F.col("doc_id").alias("record_id"), F.col("quality").alias("label"))
    j = items.join(labels, "record_id").select("label", logits_from_score("pos", THRESHOLD).alias("logits"))
    return CL.classification_report(j)


def q_classification_report(spark, sf):
    return CL.classification_report(_labelled_logits(spark, sf))


# -------------------------------------------------------------------- splits
def q_split_exact(spark, sf):
    recs = _ids(spark, sf).select("record_id")
    held, _, _ = SP.split_exact(recs, 0.29, seed=SEED, fold=1, stage="test")
    return recs.select("record_id", held.alias("held"))


def _random_table(spark, sf, folds=3, test=0.2, val=0.2, no_test=False):
    recs = _ids(spark, sf).select("record_id")
    plan = SP.random_holdout(recs, test, val, folds, no_test, SEED)
    return SP.split_table(recs, plan)


def q_random_holdout(spark, sf):
    return _random_table(spark, sf)


def q_no_test_split(spark, sf):
    recs = _ids(spark, sf).select("record_id")
    return SP.split_table(recs, SP.no_test_split(recs, 0.2, 2, SEED))


def q_split_sizes(spark, sf):
    return SP.split_sizes(_random_table(spark, sf))


def q_distinct_groups(spark, sf):
    return SP.distinct_groups(_ids(spark, sf), "source")


def q_pick_val_group(spark, sf):
    return SP.fold_groups(_ids(spark, sf), "source", SEED).select(
        F.col("fold").cast("int").alias("fold"), "test_group", "val_group")


def q_leave_one_group_out(spark, sf):
    recs = _ids(spark, sf).select("record_id", "source")
    table = SP.split_table(recs, SP.leave_one_group_out(recs, "source", SEED))
    return table.withColumn("val_folds", F.array_join(F.transform("val_folds", lambda f: f.cast("string")), ","))


# --------------------------------------------------------------------- folds
def q_prefix_metrics(spark, sf):
    long, _ = J.cv_lexical(_docs(spark, sf), "key", "source")
    return long


def q_cv_summary(spark, sf):
    _, summary = J.cv_lexical(_docs(spark, sf), "key", "source")
    return summary.select("metric", "mean", "std", F.col("n_folds").cast("bigint").alias("n_folds"))


def q_cv_summary_random_folds(spark, sf):
    """Three independent seeded reshuffles; each fold's test part scored once."""
    _, summary = J.cv_lexical(_docs(spark, sf), "random", None, test_size=0.2, val_size=0.2, cv=3)
    return summary.select("metric", "mean", "std", F.col("n_folds").cast("bigint").alias("n_folds"))


# ---------------------------------------------------------- evaluation CSV
def _csv(spark, df: DataFrame, kind: str) -> str:
    """A folder of CSV files that Spark writes from ``df``."""
    folder = _folder(spark, kind)
    (df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(folder))
    return folder


def _bench_records(spark, sf):
    """``benchmark`` written as CSV and read by ``read_eval_csv``; its own ids seed the shuffles."""
    rows = read_eval_csv(spark, _csv(spark, spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text"), "benchmark"))
    return records_from_table(rows, "item_id", "text", None)


def q_read_eval_csv(spark, sf):
    """``read_eval_csv`` on a CSV of ``documents`` whose sentences stand on lines of their own, quotes and all."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("text") != "")
    lined = F.concat(F.lit('"'), F.regexp_replace("text", r"\. ", ".\n"), F.lit('",\n'))
    r = read_eval_csv(spark, _csv(spark, docs.select("doc_id", lined.alias("text")), "documents"))
    return _rows_per_id(r.select("record_id", F.col("doc_id").cast("bigint").alias("doc_id"), F.length("text").cast("bigint").alias("n_chars"),
                                 F.md5("text").alias("text_md5"))).drop("record_id")


def q_eval_csv_report(spark, sf):
    return RK.ranking_report(lexical_items(_bench_records(spark, sf)))


def q_eval_csv_items(spark, sf):
    ps = RK.item_pair_score(lexical_items(_bench_records(spark, sf)))
    return ps.select(F.col("record_id").alias("item_id"), F.round("pair_score", 9).alias("pair_score"))


# ------------------------------------------------- trained models
ONE = ("lexical",)  # the feature that the SQL side has too


def q_train_classifier(spark, sf):
    ensure_checkpoint_dir(spark)
    cands = J.scored_candidates(_docs(spark, sf)).checkpoint()  # read by the fit and by the scoring
    model = train_classifier(cands, features=ONE, class_weights=CLASS_WEIGHTS)
    return model_logits(model, cands).select("record_id", "cand_idx", F.round(softmax_positive("logits"), 4).alias("p1"))


def q_train_multiclass(spark, sf):
    """Three classes of ``labels`` (toxic, else quality 1 or 0) from the original's coherence."""
    items = _items(spark, sf).select("record_id", "pos")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(
        F.col("doc_id").alias("record_id"), F.when(F.col("toxic") == 1, 2).otherwise(F.col("quality")).alias("label"))
    model = train_classifier(items.join(labels, "record_id"), features=("pos",), reg_param=0.01, num_labels=3)
    rows = [(c, round(b, 4), round(w[0], 4)) for c, (b, w) in enumerate(zip(model.bias, model.weights))]
    return spark.createDataFrame(rows, "class int, bias double, weight double")


def q_select_best_model(spark, sf):
    ensure_checkpoint_dir(spark)  # the session's shared folder; a scratch one only when unset
    recs = _docs(spark, sf).select("record_id", "summary")
    plan = SP.random_holdout(recs, 0.2, 0.2, 1, False, SEED)
    split = J.scored_candidates(SP.fold_split(recs, plan, 1), keep=("role",)).checkpoint()
    _, rp, auc = select_best_model(split.where(F.col("role") == "train"), split.where(F.col("role") == "val"), features=ONE)
    return spark.createDataFrame([(float(rp), round(auc, 6))], "reg_param double, val_roc_auc double")


def q_run_folds(spark, sf):
    folds, _ = J.train(spark, _docs(spark, sf).select("record_id", "summary"), "random", None, cv=3,
                       reg_params=(0.0,), features=ONE)
    return folds.withColumn("value", F.round("value", 4))


def _stand_in():
    """A text classifier without a model file: logits from the share of full stops."""
    def make_predict_fn():
        import numpy as np

        def predict(texts):
            # stand-in classifier: logits from punctuation density and length
            t = np.asarray(texts, dtype=object)
            n = np.array([len(x) for x in t], dtype=np.float64)
            p = np.array([x.count(".") for x in t], dtype=np.float64)
            return np.stack([np.zeros_like(n), p / np.maximum(n, 1.0) * 10.0 - 0.1], axis=1)
        return predict

    return make_predict_fn


def q_score_candidates(spark, sf):
    from cohera.operators.models import score_candidates

    rc = J.model_candidates(_docs(spark, sf))
    return score_candidates(rc, _stand_in()).select("record_id", "cand_idx", F.round("score", 9).alias("score"))


def q_model_report(spark, sf):
    return J.evaluate_model(_docs(spark, sf), _stand_in())[0]


def q_jsonl_records(spark, sf):
    """``read_records`` on JSON lines that Spark writes from ``documents``, ids and all."""
    folder = _folder(spark, "jsonl")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.select(F.col("text").alias("text_raw"), F.col("text").alias("summary"),
                F.struct(F.col("source")).alias("metadata")).write.json(folder)
    r = read_records(spark, folder)
    return r.groupBy(group_key(r, "source").alias("source")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("record_id").alias("n_ids"), F.countDistinct("summary").alias("n_texts"))


def q_flatten_record(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    raw = docs.select("doc_id", F.col("text").alias("text_raw"), F.col("text").alias("summary"),
                      F.struct(F.col("source")).alias("metadata"))
    return flatten_record(raw).select("doc_id", "source", F.md5("summary").alias("summary_md5"))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: ranking report of the lexical scorer over sf0.001 documents."""
    return _report(spark, "/root/testdata/sf0.001")


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "read_records": q_read_records,
    "filter_nonempty": q_filter_nonempty,
    "split_sentences": q_split_sentences,
    "learned_boundaries": q_learned_boundaries,
    "learned_sentences": q_learned_sentences,
    "sentence_count": q_sentence_count,
    "shuffle_plan": q_shuffle_plan,
    "distinct_permutations": q_distinct_permutations,
    "sample_permutations": q_sample_permutations,
    "sample_shuffles": q_sample_shuffles,
    "join_sentences": q_join_sentences,
    "generate_shuffles": q_generate_shuffles,
    "labelled_pairs": q_labelled_pairs,
    "ranking_candidates": q_ranking_candidates,
    "truncate_tokens": q_truncate_tokens,
    "lexical_coherence": q_lexical_coherence,
    "softmax_positive": q_softmax_positive,
    "predict_label": q_predict_label,
    "weighted_cross_entropy": q_weighted_cross_entropy,
    "focal_loss": q_focal_loss,
    "rank_of_original": q_rank_of_original,
    "rankable": q_rankable,
    "item_pair_score": q_item_pair_score,
    "candidate_count_ok": q_candidate_count_ok,
    "top1": lambda s, sf: RK.top1(_items(s, sf)),
    "pairwise_accuracy": lambda s, sf: RK.pairwise_accuracy(_items(s, sf)),
    "mean_reciprocal_rank": lambda s, sf: RK.mean_reciprocal_rank(_items(s, sf)),
    "recall_at_k": lambda s, sf: RK.recall_at_k(_items(s, sf)),
    "ndcg_at_k": lambda s, sf: RK.ndcg_at_k(_items(s, sf)),
    "shuffle_count_stats": lambda s, sf: RK.shuffle_count_stats(_items(s, sf)),
    "top1_counts": lambda s, sf: RK.top1_counts(_items(s, sf)),
    "margins": lambda s, sf: RK.margins(_items(s, sf)),
    "positive_score_stats": lambda s, sf: RK.positive_score_stats(_items(s, sf)),
    "negative_score_stats": lambda s, sf: RK.negative_score_stats(_items(s, sf)),
    "item_counts": lambda s, sf: RK.item_counts(_items(s, sf)),
    "ranking_report": _report,
    "empty_result": q_empty_result,
    "report_rows": q_report_rows,
    "accuracy": lambda s, sf: CL.accuracy(_pred(s, sf)),
    "f1": lambda s, sf: CL.f1(_pred(s, sf)),
    "roc_auc": lambda s, sf: CL.roc_auc(_pred(s, sf)),
    "average_precision": lambda s, sf: CL.average_precision(_pred(s, sf)),
    "classification_report": q_classification_report,
    "quality_classification": q_quality_classification,
    "split_exact": q_split_exact,
    "random_holdout": q_random_holdout,
    "no_test_split": q_no_test_split,
    "split_sizes": q_split_sizes,
    "distinct_groups": q_distinct_groups,
    "pick_val_group": q_pick_val_group,
    "leave_one_group_out": q_leave_one_group_out,
    "prefix_metrics": q_prefix_metrics,
    "cv_summary": q_cv_summary,
    "cv_summary_random_folds": q_cv_summary_random_folds,
    "read_eval_csv": q_read_eval_csv,
    "eval_csv_report": q_eval_csv_report,
    "eval_csv_items": q_eval_csv_items,
    "train_classifier": q_train_classifier,
    "train_multiclass": q_train_multiclass,
    "select_best_model": q_select_best_model,
    "run_folds": q_run_folds,
    "score_candidates": q_score_candidates,
    "model_report": q_model_report,
    "jsonl_records": q_jsonl_records,
    "flatten_record": q_flatten_record,
}


def _llm():
    """The training-data queries, or None where that subpackage is not installed."""
    try:
        from cohera.llm import queries as q
    except ImportError:  # the subpackage, the pipeline or a library that they need is not installed
        return None
    return q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    llm = _llm()
    return dict(_QUERIES) | (llm.QUERIES if llm else {})


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL per query."""
    llm = _llm()
    return O.all_queries() | (llm.ORACLE_SQL if llm else {})
