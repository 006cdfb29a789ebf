"""Orders that are listed in Arrow batches, against those of the plan."""

import random

import pytest
from pyspark.sql import functions as F

from cohera.operators import shuffles as SH
from cohera.plans.evaluation import sentence_table, shuffled


def _records(spark):
    rnd = random.Random(3)
    texts = ["d A. A. d", "A. A. A. A.", "A. A. B", "a. b", "a. a", "A. d A. A d. A. d"]
    for _ in range(30):
        texts.append(" ".join(rnd.choice("abcdef") + rnd.choice(".!?") for _ in range(rnd.randint(1, 7))) + rnd.choice(["", " a"]))
    return spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(texts)] + [(None, texts[0]), ("n", None)], "record_id string, summary string")


@pytest.mark.parametrize("k_max", [3, 20])
def test_listed_orders_are_those_of_the_plan(spark, k_max):
    records = _records(spark).coalesce(1)
    want = {r.record_id: r.negs for r in shuffled(records, k_max=k_max).where("method = 'enumerate'").collect()}
    df = SH.planned_shuffles(sentence_table(records), k_max, 42, only_when=F.col("record_id").isNull())
    t = df.select("record_id", *SH.drawn_inputs()).toArrow().combine_chunks()
    c = [t[n].combine_chunks() if t[n].num_chunks != 1 else t[n].chunk(0) for n in SH.DRAWN_INPUTS]
    listed = SH.batch_listed(42, *c)
    assert {r: o for r, o, yes in zip(t["record_id"].to_pylist(), listed.to_pylist(), t["_lists"].to_pylist()) if yes} == want
    # in the plan only those of rows without an id
    assert [r for r, o in zip(t["record_id"].to_pylist(), t["_enum"].to_pylist()) if o is not None] == [None]
