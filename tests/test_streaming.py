"""The row-wise operators on a stream give the batch answer."""

import os
import shutil

from cohera.operators.ranking import ranking_report
from cohera.plans.evaluation import lexical_items
from cohera.sources.records import read_documents
from cohera.streaming.scoring import item_scores_stream, read_record_stream, report_stream

from conftest import SF001


def test_stream_report_equals_batch(spark, scratch):
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    shutil.copy(f"{SF001}/documents.parquet", os.path.join(src, "part-0.parquet"))
    stream = read_record_stream(spark, src)
    q = report_stream(stream, name="rep_test", trigger_once=True)
    q.awaitTermination(300)
    got = spark.sql("SELECT * FROM rep_test").first().asDict()
    want = ranking_report(lexical_items(read_documents(spark, SF001))).first().asDict()
    assert got == want
    out = os.path.join(scratch, "items")
    q2 = item_scores_stream(read_record_stream(spark, src), out, name="items_test", trigger_once=True)
    q2.awaitTermination(300)
    assert spark.read.parquet(out).count() == want["total_items_in_dataset"]
