"""Orders drawn and scored in the same Arrow batch, against those that pass through the plan."""

import random
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohera.functions import digests as D
from cohera.functions import scoring as S
from cohera.operators import shuffles as SH
from cohera.plans import jobs as J
from cohera.plans.evaluation import lexical_items, lexical_scores, shuffled, with_lexical_scores


def _records(spark):
    rnd = random.Random(7)
    texts = [None, "", " ", "One.", "A. A. A. A. A. A. A. A.", "A. A. A. B. A. A. A. A", "d A. A. d A. b A. c d. a. b. c. d. e. A. d", "a. b. a. b. a. b. a. b. a"]
    for _ in range(40):
        n = rnd.choice([1, 2, 3, 6, 7, 8, 12, 45])
        texts.append(" ".join(" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(rnd.randint(1, 6))) + "." for _ in range(n)))
    rows = [(f"r{i}", t) for i, t in enumerate(texts)] + [(None, texts[-1]), ("i" * 70, "a b. b c. c. d a. e a. f b. g. h."), ("ü", "a. b a. c b. d. e. f. g a. h")]
    return spark.createDataFrame(rows, "record_id string, summary string")


def test_digests_of_many_messages_are_md5():
    for prefix, n in ((b"42|x|", 1), (b"7|" + b"y" * 33 + b"|", 1003)):
        m = np.zeros((12, n, 64), np.uint8)
        D.numbered(m, prefix)
        keys = D.digest_keys(m.reshape(-1, 64)).astype(">u4")
        assert [k.tobytes() for k in keys] == [md5(b"%s%d|%d" % (prefix, j, b)).digest() for j in range(1, 13) for b in range(n)]


@pytest.mark.parametrize("most, drawn", [(S.MAX_TABLE, SH.DRAWN), (8, 40), (0, SH.DRAWN)])
def test_drawn_scores_are_those_of_the_shuffles(spark, monkeypatch, most, drawn):
    records = _records(spark).coalesce(1)
    want = {(r.record_id, r.n_sentences): r.scores for r in with_lexical_scores(shuffled(records), keep=("record_id", "n_sentences")).collect()}
    monkeypatch.setattr(S, "MAX_TABLE", most)  # 0: all in the row
    monkeypatch.setattr(SH, "DRAWN", drawn)    # 40: larger texts one attempt at a time
    rows = lexical_scores(records).collect()
    assert len(rows) == len(want) == 51 and {(r.record_id, r.n_sentences): r.scores for r in rows} == want


def test_orders_end_where_they_are_scored(spark):
    for df in (lexical_items(_records(spark)), J.scored_candidates(_records(spark))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and plan.count("md5(") == 3


def test_drawn_features_are_those_of_the_row(spark, monkeypatch):
    def rows():
        return sorted(map(str, J.scored_candidates(_records(spark), keep=()).collect()))

    batches = rows()
    monkeypatch.setattr(S, "MAX_TABLE", 0)
    assert rows() == batches


def test_bits_of_a_large_text_are_marked_in_blocks(monkeypatch):
    rnd = np.random.default_rng(1)
    sizes = rnd.integers(0, 30, 50)
    codes = rnd.integers(0, 500, sizes.sum())
    whole = S.SentenceBits(codes, sizes, np.zeros(500, np.int64))
    monkeypatch.setattr(S, "MARKED", 64 * 50 * 2)
    blocks = S.SentenceBits(codes, sizes, np.zeros(500, np.int64))
    assert (whole.bits == blocks.bits).all() and (whole.sizes == blocks.sizes).all()
