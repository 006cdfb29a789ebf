"""The sentence rule, words passed as one string, and columns that end at the scoring step."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from cohera.functions import scoring as S
from cohera.functions.sentences import EDGE_SPACE, plain_words, split_sentences, word_sets
from cohera.plans.evaluation import lexical_items, shuffled, with_lexical_scores
from cohera.session import with_batches


def test_sentence_rule_is_the_regex(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab.!? \t\r\n  ") for _ in range(rnd.randint(0, 30))) for _ in range(600)] + [None, "", " \n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.filter(F.split(F.regexp_replace("t", EDGE_SPACE, ""), r"(?<=[.!?])[ \t\r\n]+"), lambda x: x != "")
    assert all(r.a == r.b for r in df.select(old.alias("a"), split_sentences("t").alias("b")).collect())


def test_plain_words_split_into_the_sets(spark):
    df = spark.createDataFrame([(["A b, a", "...", "Ünï 2x\nİ ΑΣ."],), ([],), (None,), ([""],)], "s array<string>")
    rows = df.select(plain_words("s").alias("p"), word_sets("s").alias("w")).collect()
    got = S.split_words(pa.array([r.p for r in rows], pa.string())).to_pylist()
    assert [g and [list(dict.fromkeys(x)) for x in g] for g in got] == [[["a", "b"], [], rows[0].w[2]], [[]], None, [[]]]


def test_scores_do_not_carry_sentences_on(spark, monkeypatch):
    df = shuffled(spark.createDataFrame([(1, "A b. B c. C a. A d."), (2, ""), (3, None), (4, "a b")], "record_id long, summary string"))
    for most in (S.MAX_TABLE, 0):  # 0: in the row
        monkeypatch.setattr(S, "MAX_TABLE", most)
        few = with_lexical_scores(df, keep=("record_id", "n_sentences"))
        assert few.columns == ["record_id", "n_sentences", "scores"]
        whole = {r.record_id: r.scores for r in with_lexical_scores(df).collect()}
        assert {r.record_id: r.scores for r in few.collect()} == whole
    plan = lexical_items(df.select("record_id", "summary"))._jdf.queryExecution().optimizedPlan().toString()
    assert "summary" not in plan[:plan.index("MapInArrow")]
    first = next(l for l in plan.splitlines() if "MapInArrow" in l)
    assert "_scores" in first and "words" not in first


def test_batches_make_several_columns(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    out = with_batches(df, ("b", "c"), ("string", "int"), lambda a, b: [b, a], ("a", "b"), drop=("b",))
    assert out.columns == ["a", "b", "c"] and sorted(map(tuple, out.collect())) == [(1, "x", 1), (2, "y", 2)]
