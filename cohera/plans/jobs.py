"""End-to-end jobs: evaluate a scorer, evaluate a CSV, train with folds.

Jobs take keyword parameters (no command-line parser) and return
DataFrames; writing is optional and goes through ``sources.sinks``.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.folds import cv_summary, fold_metrics_long, fold_reports, prefix_metrics, run_folds_together, with_fold_roles
from ..functions.scoring import (
    ORDER_FEATURES,
    batch_coherence,
    batch_features,
    candidate_features,
    lexical_coherence_scores,
    softmax_positive,
    split_words,
)
from ..functions.sentences import plain_word_sets, plain_words, split_sentences
from ..operators.candidates import ranking_candidates, truncate_tokens
from ..operators.many_models import Options, training_rows
from ..operators.models import FEATURES, as_model, load_model, model_logits, save_fold_models, score_candidates
from ..operators.ranking import items_from_scores, ranking_report, regroup_scores, with_pair_score
from ..operators.shuffles import DRAWN_INPUTS, drawn_inputs, planned_shuffles, row_orders
from ..operators.splits import make_splits
from ..session import ensure_checkpoint_dir, spread, with_batches
from ..sources.records import read_eval_csv, read_records, require_nonempty
from ..sources.sinks import run_group_name, write_cv_summary, write_fold_results, write_metrics, write_scored_items
from .evaluation import K_MAX, SEED, Splitter, lexical_items, sentence_table, shuffled, with_drawn

log = logging.getLogger(__name__)
TRAINER_TYPES = ("default", "weighted", "focal")
DEFAULT_GAMMA = 2.0
FEATURE_TYPE = f"array<struct<{','.join(f'{c}: double' for c in ORDER_FEATURES)}>>"


def validate_params(split_type: str = "random", split_key: str | None = None, trainer_type: str = "default",
                    class_weights=None, focal_loss_alpha=None, focal_loss_gamma: float = DEFAULT_GAMMA,
                    num_labels: int = 2) -> None:
    """Parameter rules of the training job; raises ``ValueError``."""
    if split_type == "random":
        if split_key is not None:
            raise ValueError("a random split takes no split_key")
    elif split_type == "key":
        if split_key is None:
            raise ValueError("split_type 'key' needs a split_key")
    else:
        raise ValueError(f"split_type is {split_type!r}; it can be 'random' or 'key'")
    if trainer_type == "weighted":
        if class_weights is None:
            raise ValueError("the weighted trainer needs class_weights")
        if len(class_weights) != num_labels:
            raise ValueError(f"class_weights has {len(class_weights)} entries for {num_labels} classes")
        if focal_loss_alpha is not None:
            raise ValueError("focal_loss_alpha belongs to the focal trainer, not to the weighted one")
        if focal_loss_gamma != DEFAULT_GAMMA:
            log.warning("the weighted trainer does not use focal_loss_gamma=%s", focal_loss_gamma)
    elif trainer_type == "focal":
        if class_weights is not None:
            raise ValueError("class_weights belongs to the weighted trainer, not to the focal one")
        if focal_loss_alpha is not None and len(focal_loss_alpha) != num_labels:
            raise ValueError(f"focal_loss_alpha has {len(focal_loss_alpha)} entries for {num_labels} classes")
    elif trainer_type == "default":
        if class_weights is not None:
            raise ValueError("class_weights belongs to the weighted trainer, not to the default one")
        if focal_loss_alpha is not None:
            raise ValueError("focal_loss_alpha belongs to the focal trainer, not to the default one")
        if focal_loss_gamma != DEFAULT_GAMMA:
            log.warning("the default trainer does not use focal_loss_gamma=%s", focal_loss_gamma)
    else:
        raise ValueError(f"trainer_type is {trainer_type!r}; it can be one of {TRAINER_TYPES}")


def evaluate(records: DataFrame, k_max: int = K_MAX, seed: int = SEED, k_values=(3, 5, 10),
             output_file: str | None = None, splitter: Splitter = split_sentences, compute_metrics=None) -> DataFrame:
    """Ranking report of the lexical scorer over records (one row); ``compute_metrics`` as in ``ranking_report``."""
    report = ranking_report(lexical_items(records, k_max, seed, splitter=splitter), k_values, compute_metrics=compute_metrics)
    if output_file:
        write_metrics(report, output_file)
    return report


def model_candidates(records: DataFrame, k_max: int = K_MAX, seed: int = SEED, max_length: int = 512,
                     normalize_original: bool = False, splitter: Splitter = split_sentences,
                     partitions: int | None = None) -> DataFrame:
    """Candidates as a text classifier sees them: cut at ``max_length`` tokens.

    ``(record_id, cand_idx, n_neg, text, n_tokens, truncated)``. The records
    are dealt into ``partitions`` (None: left as they are), not their up to
    ``k_max + 1`` candidates each, which are that many times the text.
    """
    records = spread(records, "record_id", partitions)
    cands = ranking_candidates(shuffled(records, k_max, seed, splitter=splitter), normalize_original)
    return truncate_tokens(cands, max_length=max_length).drop("text").withColumnRenamed("text_trunc", "text")


def evaluate_model(records: DataFrame, make_predict_fn, k_max: int = K_MAX, seed: int = SEED, k_values=(3, 5, 10),
                   max_length: int = 512, num_labels: int = 2, normalize_original: bool = False,
                   splitter: Splitter = split_sentences, batch_size: int = 64, partitions: int | None = None,
                   output_file: str | None = None, compute_metrics=None) -> tuple[DataFrame, DataFrame]:
    """Ranking report and items of a user's text classifier.

    ``make_predict_fn`` is as in ``score_candidates``. The scored items (one
    narrow row per text, with ``pair_score``) are written once to the shared
    folder; the report is made from them.
    """
    cands = model_candidates(records, k_max, seed, max_length, normalize_original, splitter, partitions)
    scored = score_candidates(cands, make_predict_fn, num_labels=num_labels, batch_size=batch_size)
    items = items_from_scores(regroup_scores(scored.select("record_id", "cand_idx", "n_neg", "score")))
    ensure_checkpoint_dir(records.sparkSession)
    items = with_pair_score(items).checkpoint(eager=True)
    report = ranking_report(items, k_values, compute_metrics=compute_metrics)
    if output_file:
        write_metrics(report, output_file)
    return report, items


def evaluate_csv(spark: SparkSession, path: str, output_path: str | None = None, k_max: int = K_MAX,
                 seed: int = SEED, text: str = "text", k_values=(3, 5, 10), make_predict_fn=None, max_length: int = 512,
                 num_labels: int = 2, normalize_original: bool = False, splitter: Splitter = split_sentences,
                 multi_line: bool = True, partitions: int | None = None):
    """CSV with a text column -> ``(report, scored rows with pair_score)``.

    Without ``make_predict_fn`` the lexical scorer is used and the input
    columns ride along with the row's scores. Either way everything is
    computed once. Texts without shuffles get pair_score -1.0 and are
    counted as items but not evaluated.
    """
    rows = spread(require_nonempty(read_eval_csv(spark, path, text, multi_line), "evaluation rows"), "record_id", partitions)
    columns = [c for c in rows.columns if c != "record_id"]
    if make_predict_fn is None:
        carried = rows.select("record_id", F.col(text).alias("summary"), F.struct(*columns).alias("_row"))
        ensure_checkpoint_dir(spark)
        items = with_pair_score(lexical_items(carried, k_max, seed, keep=("_row",), splitter=splitter)).checkpoint(eager=True)
        report = ranking_report(items, k_values)
        scored = items.select("record_id", "_row.*", "pair_score")
    else:
        report, items = evaluate_model(rows.select("record_id", F.col(text).alias("summary")), make_predict_fn, k_max, seed,
                                       k_values, max_length, num_labels, normalize_original, splitter, partitions=partitions)
        scored = rows.join(items.select("record_id", "pair_score"), "record_id", "left")
    if output_path:
        write_metrics(report, f"{output_path}/results.json")
        write_scored_items(scored, f"{output_path}/test_data_predicted.csv")
    return report, scored.drop("record_id")


def _scores_and_features(orders, plain, lengths):
    """Scores and order features of an Arrow batch."""
    words = split_words(plain)
    return [batch_coherence(words, orders), batch_features(words, lengths, orders)]


def scored_candidates(records: DataFrame, k_max: int = K_MAX, seed: int = SEED,
                      splitter: Splitter = split_sentences, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(record_id, cand_idx, label, n_neg, *FEATURES, *keep)``: one row per candidate."""
    df = planned_shuffles(sentence_table(records, keep=keep, splitter=splitter).drop("summary"), k_max, seed,
                          only_when=F.col("record_id").isNull())
    lengths = F.transform("sentences", lambda x: F.length(x))
    rest = ("_plain", "_lengths", *DRAWN_INPUTS)  # of use to the rows that the batches leave out
    df = df.select("record_id", *keep, plain_words("sentences").alias("_plain"), lengths.alias("_lengths"), *drawn_inputs())
    df = with_drawn(df, seed, ("_scores", "_more"), ("array<double>", FEATURE_TYPE), _scores_and_features, rest)
    df = df.withColumns({"words": plain_word_sets("_plain"), "_orders": F.when(F.col("_scores").isNull(), row_orders(seed))})
    total = F.aggregate(F.col("words"), F.lit(0).cast("bigint"), lambda acc, w: acc + F.size(w))
    scores = F.coalesce("_scores", lexical_coherence_scores("words", F.col("_orders"), total))
    more = F.coalesce("_more", candidate_features("words", "_lengths", F.col("_orders")))
    df = df.withColumn("_lexical", scores)
    df = df.withColumn("n_neg", F.size("_lexical") - 1).withColumnRenamed("_lexical", "lexical")
    df = df.select("record_id", "n_neg", *keep, F.arrays_zip(F.col("lexical"), more.alias("more")).alias("c"))
    x = df.select("record_id", "n_neg", *keep, F.posexplode_outer("c").alias("cand_idx", "c"))
    return x.select("record_id", F.col("cand_idx").cast("int").alias("cand_idx"),
                    (F.col("cand_idx") == 0).cast("int").alias("label"), "n_neg", "c.lexical", "c.more.*", *keep)


def model_items(model, cands: DataFrame) -> DataFrame:
    """Score candidates with a fitted model and regroup them per item.

    An item whose candidates did not all get a score still counts in the
    report's total; it is not evaluated.
    """
    scored = model_logits(model, cands).withColumn("score", softmax_positive("logits"))
    return items_from_scores(regroup_scores(scored))


def evaluate_saved(spark: SparkSession, records: DataFrame, model_path: str, k_max: int = K_MAX, seed: int = SEED,
                   k_values=(3, 5, 10), splitter: Splitter = split_sentences) -> DataFrame:
    """Ranking report of a model that ``train`` saved."""
    return ranking_report(model_items(load_model(spark, model_path), scored_candidates(records, k_max, seed, splitter)), k_values)


def train(spark: SparkSession, records: DataFrame, split_type: str = "random", split_key: str | None = None,
          test_size: float = 0.2, val_size: float = 0.2, cv: int = 1, k_max: int = K_MAX, seed: int = SEED,
          trainer_type: str = "default", class_weights=None, focal_loss_alpha=None,
          focal_loss_gamma: float = DEFAULT_GAMMA, num_labels: int = 2, no_test: bool = False,
          reg_params=(0.0, 0.01), output_dir: str | None = None, model_name: str = "logistic",
          splitter: Splitter = split_sentences, features=FEATURES, compute_metrics=None, run_group: str | None = None):
    """Folds of train -> select on val ROC AUC -> ranking report on test.

    Returns ``(fold_results, summary)``; ``summary`` is None without test
    results. Every record is shuffled and scored once, whatever the number of
    folds: its candidates are written with the folds that validate or test on
    it, and all folds and regularisations are trained in the same passes. With
    ``output_dir`` the model selected in fold ``f`` is saved under
    ``models/fold=f`` (see ``evaluate_saved``), and results and summary are
    committed under ``run_group`` (a fresh name by default); a job that is run
    again under its name replaces what it wrote. ``compute_metrics`` adds
    metrics to every fold's test report and to the summary. Classes beyond original (1) and
    shuffle (0) have no rows here and get probability near zero.
    """
    validate_params(split_type, split_key, trainer_type, class_weights, focal_loss_alpha, focal_loss_gamma,
                    num_labels)
    records = require_nonempty(records)
    plan = make_splits(records, split_type, split_key, test_size, val_size, cv, no_test, seed)
    keep = (split_key,) if split_key else ()
    focal = trainer_type == "focal"
    options = Options(num_labels, focal_loss_alpha if focal else class_weights, focal_loss_gamma if focal else 0.0, focal)
    ensure_checkpoint_dir(spark)
    roles = ("val_folds", "test_folds")
    cands = scored_candidates(with_fold_roles(records.select("record_id", "summary", *keep), plan), k_max, seed, splitter, roles)
    rows = training_rows(cands, features, keep=("record_id", "cand_idx", F.col("n_neg").cast("int").alias("n_neg"))).checkpoint()
    folds, models = run_folds_together(rows, list(plan.fold_numbers()), features, reg_params, options, no_test, compute_metrics)
    folds = folds.checkpoint()  # read by the summary and the sinks
    if output_dir:
        save_fold_models(spark, {f: as_model(features, w, rp) for f, (w, rp, _) in models.items()}, f"{output_dir}/models")
    ok = folds.where(F.col("status") == "ok")
    summary = None if ok.isEmpty() else cv_summary(ok.select("fold", "metric", "value"))
    if output_dir:
        group = run_group or run_group_name(trainer_type, model_name, cv)
        config = {"split_type": split_type, "split_key": split_key, "test_size": test_size, "val_size": val_size,
                  "cv_folds": cv, "k_max": k_max, "trainer_type": trainer_type, "class_weights": class_weights,
                  "focal_loss_alpha": focal_loss_alpha, "focal_loss_gamma": focal_loss_gamma, "seed": seed}
        write_fold_results(folds, f"{output_dir}/fold_results", group, config)
        if summary is not None:
            write_cv_summary(summary, f"{output_dir}/cv_summary", group, config)
    return folds, summary


def cv_lexical(records: DataFrame, split_type: str = "key", split_key: str | None = "source",
               test_size: float = 0.2, val_size: float = 0.2, cv: int = 1, k_max: int = K_MAX,
               seed: int = SEED, compute_metrics=None) -> tuple[DataFrame, DataFrame]:
    """Fixed-scorer cross-validation: ``(fold metrics long, summary)``.

    Items are scored once; every fold's test report comes from one grouped
    aggregate.
    """
    plan = make_splits(records, split_type, split_key if split_type == "key" else None, test_size, val_size, cv,
                       False, seed)
    keep = (split_key,) if split_type == "key" else ()
    items = lexical_items(records, k_max, seed, keep=keep)
    long = prefix_metrics(fold_metrics_long(fold_reports(items, plan, compute_metrics=compute_metrics)))
    return long, cv_summary(long)


def read_and_evaluate(spark: SparkSession, data_path: str, output_file: str | None = None,
                      k_max: int = K_MAX, seed: int = SEED, k_values=(3, 5, 10), make_predict_fn=None,
                      splitter: Splitter = split_sentences, partitions: int | None = None, **options) -> DataFrame:
    """JSONL records -> ranking report (the ``evaluate`` command).

    With ``make_predict_fn`` the report is that classifier's; ``options`` are
    those of ``evaluate_model``.
    """
    records = spread(require_nonempty(read_records(spark, data_path)), "record_id", partitions)
    if make_predict_fn is None:
        return evaluate(records, k_max, seed, k_values, output_file, splitter)
    return evaluate_model(records, make_predict_fn, k_max, seed, k_values, splitter=splitter, partitions=partitions,
                          output_file=output_file, **options)[0]
