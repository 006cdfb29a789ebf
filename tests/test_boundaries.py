"""Learned sentence boundaries: planted abbreviations, starters and collocations, and their odd inputs."""

from __future__ import annotations

import random

import pytest

from cohera.functions.sentences import split_sentences
from cohera.operators.boundaries import MARK, learn_boundaries, learned_splitter
from cohera.plans.evaluation import lexical_items
from cohera.operators.ranking import ranking_report

RNG = random.Random(3)
WORDS = [f"{a}{b}{c}" for a in ("ba", "ko", "lu", "mi") for b in ("ran", "sel", "ton") for c in ("", "de", "vi")]


def sentence():
    body = " ".join(RNG.choice(WORDS) for _ in range(RNG.randint(4, 9)))
    middle = RNG.choice(["", "", " with Dr. Smith", " near St. Gallen", " as e.g. birds", " by J. Brown", " approx. ten", " in no. 7"])
    return f"{RNG.choice(['The', 'However', 'Then'])} {body}{middle} {RNG.choice(WORDS)}{RNG.choice(['.', '.', '.', '?'])}"


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, " ".join(sentence() for _ in range(RNG.randint(1, 9)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "..."), (1004, f"One{MARK}two. Three"), (1005, "A. " * 4000)]
    return spark.createDataFrame(rows, "record_id bigint, summary string")


@pytest.fixture(scope="module")
def model(texts):
    return learn_boundaries(texts).cache()


def test_lists(model):
    found = {k: {r["type"] or r["next"] for r in model.collect() if r["kind"] == k} for k in ("abbreviation", "starter")}
    assert {"dr", "st", "e.g", "approx"} <= found["abbreviation"] and not found["abbreviation"] & set(WORDS)
    assert {"the", "however", "then"} <= found["starter"] and not found["starter"] & {"smith", "gallen", "brown"}


def test_abbreviations_are_not_cut(spark, model):
    split = learned_splitter(model)
    cases = {"The luran saw Dr. Smith ton. However baran went to St. Gallen lusel. Then kosel.": 3,
             "Then kosel met J. Brown baran! The mitonvi is e.g. birds lusel.": 2,
             "The baran lusel approx. Then kosel miton.": 2,  # a starter opens a sentence behind an abbreviation
             "One baran. two": 2, "": 0, " ": 0, "no end": 1}
    rows = spark.createDataFrame(list(cases.items()), "t string, n int").select("t", "n", split("t").alias("s"))
    for r in rows.collect():
        assert len(r["s"]) == r["n"], r["s"]
        assert " ".join(r["s"]) == r["t"].strip()
    assert spark.sql("SELECT cast(null AS string) AS t").select(split("t").alias("s")).first()["s"] is None


def test_only_joins_plain_pieces(texts, model):
    split = learned_splitter(model)
    for r in texts.where("summary is not null").select("record_id", split_sentences("summary").alias("p"), split("summary").alias("s")).collect():
        plain = [x.replace(MARK, " ") for x in r["p"]]
        assert " ".join(r["s"]) == " ".join(plain) and len(r["s"]) <= len(plain)


def test_collocation_keeps_a_starter_behind_an_abbreviation(spark):
    rows = [(i, "The baran is so. The kosel of St. Then is here. The luran was lusel. We saw vi. It is.") for i in range(60)]
    rows += [(100 + i, " ".join("Then " + " ".join(RNG.choice(WORDS) for _ in range(12)) + "." for _ in range(4))) for i in range(90)]
    df = spark.createDataFrame(rows, "record_id bigint, summary string")
    model = learn_boundaries(df)
    assert ("st", "then") in {(r["type"], r["next"]) for r in model.where("kind = 'collocation'").collect()}
    split = learned_splitter(model)
    got = df.limit(1).select(split("summary").alias("s")).first()["s"]
    assert any("The kosel of St. Then is here." in x for x in got)


def test_plugs_in_and_checks_its_size(texts, model):
    report = ranking_report(lexical_items(texts.where("record_id < 20"), splitter=learned_splitter(model))).first()
    assert report["total_items_in_dataset"] == 20
    with pytest.raises(ValueError):
        learned_splitter(model, max_listed=3)


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([(1, None), (2, "")], "record_id bigint, summary string")
    model = learn_boundaries(none)
    assert model.count() == 0
    got = spark.createDataFrame([("One. Two",)], "t string").select(learned_splitter(model)("t").alias("s")).first()["s"]
    assert got == ["One.", "Two"]
