"""Candidate tables: labelled pairs (training) and ranking lists (evaluation).

One row per candidate, ``cand_idx`` 0 = the original text. The orders are
exploded first and each candidate's text is joined after, one at a time: a
long text never stands 21 times in one row. The order array is never empty,
so ``posexplode_outer`` gives the same rows as ``posexplode`` without the
size filter the optimizer would infer (and push, with the whole shuffle
expression inlined, below the scan).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sentences import join_sentences


def candidate_text(order: Column, summary: str = "summary", sentences: str = "sentences",
                   normalize_original: bool = False) -> Column:
    """Text of one exploded candidate: the original first, then the shuffles.

    By default the original keeps its own whitespace while shuffles are
    rejoined with one space (a model could tell them apart without reading
    order); ``normalize_original=True`` rejoins the original as well.
    """
    original = join_sentences(sentences) if normalize_original else F.col(summary)
    return F.when(F.col("cand_idx") == 0, original).otherwise(join_sentences(sentences, order))


def ranking_candidates(shuffled: DataFrame, normalize_original: bool = False,
                       keep: tuple[str, ...] = ()) -> DataFrame:
    """``(record_id, *keep, n_neg, cand_idx, text)`` for every text."""
    orders = F.concat(F.array(F.col("canon")), F.col("negs"))
    x = shuffled.select("record_id", *keep, "n_neg", "summary", "sentences",
                        F.posexplode_outer(orders).alias("cand_idx", "order"))
    return x.select("record_id", *keep, "n_neg", F.col("cand_idx").cast("int").alias("cand_idx"),
                    candidate_text(F.col("order"), normalize_original=normalize_original).alias("text"))


def labelled_pairs(shuffled: DataFrame, normalize_original: bool = False,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """``(record_id, cand_idx, label, text)``: originals 1, shuffles 0.

    A text without shuffles still gives its positive row.
    """
    cands = ranking_candidates(shuffled, normalize_original, keep)
    return cands.select("record_id", *keep, "cand_idx", (F.col("cand_idx") == 0).cast("int").alias("label"),
                        "text")


def truncate_tokens(df: DataFrame, text: str = "text", max_length: int = 512) -> DataFrame:
    """Cut texts at ``max_length`` whitespace tokens (``<= 0``: no limit).

    Re-aim of sub-word truncation: adds ``n_tokens``, ``truncated`` and
    ``text_trunc`` so the share of cut candidates is visible. Two candidates
    of one long text can keep different sentences once cut.
    """
    # one space between tokens: then counting and cutting need no array of tokens
    inner = F.trim(F.col(text), F.lit(" \t\r\n"))
    other = F.contains(inner, F.lit("  "))
    for c in "\t\r\n":
        other = other | F.contains(inner, F.lit(c))
    spaced = F.when(other, F.regexp_replace(inner, r"[ \t\r\n]+", " ")).otherwise(inner)
    df = df.withColumn("_tok", spaced).withColumn(
        "n_tokens", F.octet_length("_tok") - F.octet_length(F.replace(F.col("_tok"), F.lit(" "), F.lit(""))) + 1)
    if max_length and max_length > 0:
        df = (df.withColumn("truncated", F.col("n_tokens") > max_length)
              .withColumn("text_trunc", F.when(F.col("truncated"), F.substring_index("_tok", " ", max_length))
                          .otherwise(F.col(text))))
    else:
        df = df.withColumn("truncated", F.lit(False)).withColumn("text_trunc", F.col(text))
    return df.drop("_tok")
