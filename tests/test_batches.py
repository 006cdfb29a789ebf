"""Shuffles, coherence and order features made in Arrow batches, against the expressions in the row."""

import random

import pytest
from pyspark.sql import functions as F

from cohera.functions import scoring as S
from cohera.functions.sentences import EDGE_SPACE
from cohera.operators.candidates import truncate_tokens
from cohera.plans import jobs as J
from cohera.plans.evaluation import candidate_orders, shuffled, with_lexical_scores


def _records(spark):
    rnd = random.Random(5)
    texts = [None, "", "  ", "One.", "A. A. A. A. A. A. A. A.", "... !!! ??? ... !!! ??? ... !!!", "d A. A. d A. b A. c d"]
    for _ in range(60):
        n = rnd.choice([1, 2, 3, 6, 7, 8, 12, 30])
        texts.append(" ".join(" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(rnd.randint(1, 6))) + "." for _ in range(n)))
    return spark.createDataFrame(list(enumerate(texts)), "record_id long, summary string")


@pytest.mark.parametrize("most", [S.MAX_TABLE, 40, 0])
def test_batches_give_what_the_row_gives(spark, monkeypatch, most):
    size, limit = S.MAX_TABLE, most  # 40: texts of both ways; 0: all in the row
    monkeypatch.setattr(S, "MAX_TABLE", limit)
    df = with_lexical_scores(shuffled(_records(spark)))
    rows = df.select("record_id", "scores", S.lexical_coherence_scores("words", candidate_orders(), F.col("word_total")).alias("own")).collect()
    assert size and len(rows) == 67 and all(r.scores == r.own for r in rows)


def test_features_of_batches_and_rows_agree(spark):
    records = _records(spark)
    df = shuffled(records).withColumn("words", S.F.transform("sentences", lambda s: F.array_distinct(F.split(s, "[^a-z]+"))))
    lengths = F.transform("sentences", lambda x: F.length(x))
    df = df.select("record_id", "words", lengths.alias("lengths"), candidate_orders().alias("orders"))
    made = J.with_batches(df, "more", J.FEATURE_TYPE, S.batch_features, ("words", "lengths", "orders"))
    rows = made.select("record_id", "more", S.candidate_features("words", "lengths", F.col("orders")).alias("own")).collect()
    assert sum(r.more is not None for r in rows) > 60
    assert all(r.more is None or r.more == r.own for r in rows)


def test_truncation_counts_as_a_split_does(spark):
    texts = ["", " ", "\t\n", "a", " a  b\tc ", "a\r\nb c d e", "a b c d e f", "ä ö ü ß x", "a b c d", None, "  x  y  z  w  "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    tokens = F.split(F.regexp_replace("text", EDGE_SPACE, ""), r"[ \t\r\n]+")
    want = df.select("i", F.size(tokens).alias("n"), F.when(F.size(tokens) > 3, F.array_join(F.slice(tokens, 1, 3), " "))
                     .otherwise(F.col("text")).alias("t")).orderBy("i").collect()
    got = truncate_tokens(df, max_length=3)
    assert "_tok" not in got.columns and "split(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.i, r.n_tokens, r.text_trunc) for r in got.orderBy("i").collect()] == [(r.i, r.n, r.t) for r in want]


def test_candidates_of_a_model_are_not_moved(spark):
    """Records may be dealt, their up to 21 candidates each are not."""
    docs = spark.createDataFrame([(1, "A b. C d. E f.")], "record_id long, summary string")
    plan = J.model_candidates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    plan = J.model_candidates(docs, partitions=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(record_id") == 1 and plan.index("Generate posexplode") < plan.index("Exchange hashpartitioning")
