"""Exact dedup by content-defined chunk recipes (native DataFrame code).

A text is normalised (runs of white space become one space) and cut where
its own content says so: at least ``MIN_CHUNK`` characters, then up to the
first anchor, at most ``MAX_CHUNK``. Equal texts are cut alike. A chunk is
named by a 64-bit hash; names are *verified* over the whole corpus: a name
that stands for two contents (by SHA-256) is replaced by the SHA-256 itself.
Two texts are equal when their ordered lists of verified names are equal, so
what moves between executors is a few bytes per chunk, never a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialized

MIN_CHUNK = 1024
MAX_CHUNK = 8192
#: a cut follows this content: an ending consonant and a space or a mark
ANCHOR = "[nst][ .,]"
#: more ambiguous names than this are not listed; every name becomes a SHA-256
MAX_LISTED = 10_000


def normalized(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def chunks(text: Column) -> Column:
    """Content-defined chunks of a text, in order; joined they give it back."""
    rule = f"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?{ANCHOR}|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(text, F.lit(rule), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256, recipe): ``recipe`` lists verified chunk names.

    One pass over the texts; its narrow result is written once. The name
    check and the lists are made from that.
    """
    norm = docs.select(F.col(id_col).alias("doc_id"), normalized(F.col(text_col)).alias("t"))
    cut = norm.select("doc_id", "t", chunks(F.col("t")).alias("c"))
    raw = materialized(cut.select(
        "doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"),
        F.transform("c", lambda x: F.struct(F.xxhash64(x).alias("name"),
                                            F.unhex(F.sha2(x.cast("binary"), 256)).alias("sha"))).alias("c")))
    names = (raw.select(F.explode("c").alias("c")).select("c.name", "c.sha").distinct()
             .groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"))
    clash = [r["name"] for r in names.limit(MAX_LISTED + 1).collect()]
    short = lambda x: F.hex(F.format_string("%016x", x["name"]).cast("binary"))
    if not clash:
        ids = F.transform("c", lambda x: x["name"])
    elif len(clash) <= MAX_LISTED:
        ids = F.transform("c", lambda x: F.when(x["name"].isin(clash), F.hex(x["sha"])).otherwise(short(x)))
    else:
        ids = F.transform("c", lambda x: F.hex(x["sha"]))
    return raw.select("doc_id", "text_sha256", ids.alias("recipe"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with its group of equal texts.

    Columns doc_id, keep_id, group_size, kept, text_sha256. The row with the
    smallest id of a group stays; of rows that repeat that id too, one stays.
    A null id sorts after all others. Null and empty texts are equal; white
    space alone equals one space, not the empty text. An empty table gives
    no rows.

    Rows are counted per (recipe, id) before anything else moves, so a group
    with a third of all rows is folded map-side. The join back is on the
    narrow rows only; the adaptive skew join splits a hot recipe.
    """
    rows = (recipes(docs, id_col, text_col).groupBy("recipe", "doc_id", "text_sha256")
            .agg(F.count(F.lit(1)).alias("n")))
    groups = rows.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    out = rows.join(groups, "recipe")
    out = out.select("doc_id", "keep_id", "group_size", "text_sha256",
                     F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("i"))
    return out.select("doc_id", "keep_id", "group_size",
                      (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"),
                      "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    Only the ids and digests of the copies are shuffled against the texts;
    repeated (id, text) rows are numbered in the same partitioning.
    """
    kept = (exact_groups(docs, id_col, text_col).where("kept")
            .select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")))
    sha = F.sha2(normalized(F.col(text_col)).cast("binary"), 256)
    x = docs.withColumn("_s", sha)
    x = x.join(kept, x[id_col].eqNullSafe(kept["_id"]) & (x["_s"] == kept["_sha"]), "left_semi")
    again = Window.partitionBy(id_col, "_s").orderBy(id_col)
    return x.withColumn("_n", F.row_number().over(again)).where("_n = 1").drop("_n", "_s")


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
g AS (SELECT doc_id, x, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
             row_number() OVER (PARTITION BY x, doc_id) AS i FROM t)
SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id) AND i = 1 AS kept, sha256(x) AS text_sha256
FROM g
"""
