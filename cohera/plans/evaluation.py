"""Ranking evaluation plans: records -> sentences -> shuffles -> scores -> items.

The lexical scorer runs inside the row, next to the shuffles it scores: a
text's candidates never leave its row, so the whole evaluation has a single
exchange (the one-row partial aggregate). A model scorer instead explodes
the candidates, scores them in Arrow batches and regroups by id
(``plans.jobs.model_items``).
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import batch_coherence, lexical_coherence_scores
from ..functions.sentences import plain_word_sets, plain_words, split_sentences, word_sets
from ..operators.ranking import items_from_scores
from ..operators.shuffles import DRAWN_INPUTS, batch_listed, batch_orders, drawn_inputs, drawn_parts, generate_shuffles, planned_shuffles, row_orders
from ..session import with_batches

K_MAX = 20
SEED = 42


Splitter = Callable[[str], Column]


def sentence_table(records: DataFrame, summary: str = "summary", keep: tuple[str, ...] = (),
                   splitter: Splitter = split_sentences) -> DataFrame:
    """``(record_id, *keep, summary, sentences)``.

    ``splitter`` maps the text column to an array of sentences.
    """
    return records.select("record_id", *keep, summary).withColumn("sentences", splitter(summary))


def shuffled(records: DataFrame, k_max: int = K_MAX, seed: int = SEED, keep: tuple[str, ...] = (),
             splitter: Splitter = split_sentences) -> DataFrame:
    """Sentence table with up to ``k_max`` unique shuffles per text."""
    return generate_shuffles(sentence_table(records, keep=keep, splitter=splitter), k_max=k_max, seed=seed)


def candidate_orders() -> Column:
    """Original (canonical positions) first, then the shuffles."""
    return F.concat(F.array(F.col("canon")), F.col("negs"))


def with_lexical_scores(df: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Add ``words, word_total`` and ``scores ARRAY<DOUBLE>``: lexical coherence of every candidate.

    Arrow batches score nearly all texts; what they leave out (very long texts,
    texts without sentences) is scored in the row. With ``keep`` only these
    columns and the scores are left.
    """
    df = df.withColumns({"_plain": plain_words("sentences"), "_orders": candidate_orders()})
    if keep is None:
        df = with_batches(df, "_scores", "array<double>", batch_coherence, ("_plain", "_orders"), drop=("_plain", "_orders"))
        df = df.withColumn("words", word_sets("sentences"))
    else:
        rest = ("_plain", "canon", "negs")
        types = [df.schema[c].dataType.simpleString() for c in rest]
        df = with_batches(df.select(*keep, *rest, "_orders"), ("_scores", *rest), ("array<double>", *types),
                          _scored_or_left, ("_orders", *rest), drop=("_orders", *rest))
        df = df.withColumn("words", plain_word_sets("_plain"))
    df = df.withColumn("word_total", F.aggregate(F.col("words"), F.lit(0).cast("bigint"),
                                                 lambda acc, w: acc + F.size(w)))
    in_row = lexical_coherence_scores("words", candidate_orders(), F.col("word_total"))
    df = df.withColumn("scores", F.coalesce("_scores", in_row)).drop("_scores")
    return df if keep is None else df.select(*keep, "scores")


def only_left(made: pa.Array, *rest: pa.Array) -> list[pa.Array]:
    """The columns ``rest`` of an Arrow batch, null in the rows that have a value in ``made``."""
    left = pc.is_null(made)
    return [pc.if_else(left, c, pa.nulls(len(c), c.type)) if made.null_count else pa.nulls(len(c), c.type) for c in rest]


def _scored_or_left(orders, plain, *rest):
    """Scores of an Arrow batch, and what the rows without need."""
    scores = batch_coherence(plain, orders)
    return [scores, *only_left(scores, plain, *rest)]


def with_drawn(df: DataFrame, seed: int, column: tuple[str, ...], kind: tuple[str, ...], compute,
               inputs: tuple[str, ...]) -> DataFrame:
    """Add ``column``, which ``compute`` makes of candidate orders drawn in the same Arrow batch and not passed on.

    ``inputs`` are columns that ``compute`` takes after the orders, then
    ``DRAWN_INPUTS``; they end null, except in the rows whose first made value
    is null, where ``_enum`` has what ``batch_listed`` made.
    """
    own = len(inputs) - len(DRAWN_INPUTS)
    listed = own + DRAWN_INPUTS.index("_enum")

    def run(*columns):
        parts = []
        for at, size in drawn_parts(columns[own + DRAWN_INPUTS.index("canon")]):
            part = [c.slice(at, size) for c in columns]
            part[listed] = batch_listed(seed, *part[own:])
            made = compute(batch_orders(seed, *part[own:-1]), *part[:own])
            parts.append([*made, *only_left(made[0], *part)])
        return [pa.concat_arrays(p) for p in zip(*parts)]

    types = [df.schema[c].dataType.simpleString() for c in inputs]
    return with_batches(df, (*column, *inputs), (*kind, *types), run, inputs, drop=inputs)


def lexical_scores(records: DataFrame, k_max: int = K_MAX, seed: int = SEED,
                   keep: tuple[str, ...] = (), splitter: Splitter = split_sentences) -> DataFrame:
    """``(record_id, *keep, n_sentences, scores)``: the scores that ``with_lexical_scores`` adds to ``shuffled``.

    Orders are drawn and scored in the same Arrow batch and end there; what the
    batches leave out (very long texts, rows without an id or a text) is drawn and scored in
    the row.
    """
    df = planned_shuffles(sentence_table(records, keep=keep, splitter=splitter).drop("summary"), k_max, seed,
                          only_when=F.col("record_id").isNull())
    kept = ("record_id", *keep, "n_sentences")
    df = df.select(*kept, plain_words("sentences").alias("_plain"), *drawn_inputs())
    rest = ("_plain", *DRAWN_INPUTS)
    df = with_drawn(df, seed, ("_scores",), ("array<double>",), lambda orders, plain: [batch_coherence(plain, orders)], rest)
    in_row = lexical_coherence_scores("words", row_orders(seed), F.col("word_total"))
    df = df.withColumn("words", plain_word_sets("_plain"))
    df = df.withColumn("word_total", F.aggregate(F.col("words"), F.lit(0).cast("bigint"), lambda acc, w: acc + F.size(w)))
    return df.select(*kept, F.coalesce("_scores", in_row).alias("scores"))


def lexical_items(records: DataFrame, k_max: int = K_MAX, seed: int = SEED,
                  keep: tuple[str, ...] = (), splitter: Splitter = split_sentences) -> DataFrame:
    """Per-item ranking values with the lexical scorer.

    Columns: ``record_id, *keep, n_sentences, n_neg, pos, neg_scores, rank,
    wins, max_neg, rankable``. Texts are dropped before anything else.
    """
    return items_from_scores(lexical_scores(records, k_max, seed, keep, splitter)).drop("scores")
