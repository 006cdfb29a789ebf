"""Benchmark decontamination by a broadcast set of test n-grams (native).

Texts are lower-cased (A-Z) and cut into words (runs of 0-9, a-z and all
characters beyond ASCII). Every window of ``n`` consecutive words of a
benchmark item becomes a hash in a broadcast table; an item of fewer words
is one window. Every training window is hashed and looked up, hits are
verified by comparing the words themselves, and the words that any verified
occurrence covers are counted or their documents removed.

The broadcast is guarded: beyond ``MAX_BROADCAST`` bytes of windows the same
join runs as a shuffle join on the hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialized

N_WORDS = 10
MAX_BROADCAST = 64 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: every ASCII character that is neither a digit nor a letter
_MARKS = "".join(chr(i) for i in [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def words(text: Column) -> Column:
    """The words of a text; null and wordless texts have none."""
    spaced = F.trim(F.translate(F.coalesce(text, F.lit("")), _UPPER + _MARKS, _UPPER.lower() + " " * len(_MARKS)))
    return F.filter(F.split(spaced, " +"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """``size(words(text))`` without building the words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")).cast("bigint")


def item_windows(items: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(item, len, h, w): the distinct windows of each item. Rows without id are no items."""
    x = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"),
                                                      words(F.col(text_col)).alias("ws"))
    x = x.where(F.size("ws") > 0).withColumn("len", F.least(F.size("ws"), F.lit(n)))
    x = x.select("item", "ws", "len", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("len") + 1)).alias("p"))
    win = F.slice("ws", F.col("p"), F.col("len"))
    return x.select("item", "len", F.xxhash64(win).alias("h"), F.array_join(win, " ").alias("w")).distinct()


def occurrences(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, p, len, item): verified occurrences of windows in texts.

    ``key`` (a hash of the text) tells rows that share an id apart. Windows
    have at most ``n`` lengths; the lengths in use and the size of the table
    are the only values that reach the driver.
    """
    stats = windows.groupBy("len").agg(F.sum(F.octet_length("w") + F.octet_length("item") + 40).alias("b")).collect()
    lengths, size = sorted(r["len"] for r in stats), sum(r["b"] for r in stats)
    if size <= MAX_BROADCAST:
        windows = F.broadcast(windows)
    x = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), words(F.col(text_col)).alias("ws"))
    shortest = lengths[0] if lengths else 1
    x = x.where(F.size("ws") >= shortest)
    x = x.select("doc_id", "key", "ws", F.explode(F.sequence(F.lit(1), F.size("ws") - shortest + 1)).alias("p"))
    if len(lengths) > 1:  # short items: probe each length that occurs
        x = x.withColumn("len", F.explode(F.array(*[F.lit(k) for k in lengths])))
        x = x.where(F.col("p") + F.col("len") - 1 <= F.size("ws"))
    else:
        x = x.withColumn("len", F.lit(shortest))
    x = x.select("doc_id", "key", "p", "len", F.slice("ws", F.col("p"), F.col("len")).alias("win"))
    x = x.withColumn("h", F.xxhash64("win")).join(windows, ["h", "len"])
    return x.where(F.array_join("win", " ") == F.col("w")).select("doc_id", "key", "p", "len", "item")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", n: int = N_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null, empty and wordless texts have no words and no hits. Rows that
    repeat an id are judged each by its own text. Without items nothing is
    hit; an empty table gives no rows. Only verified hits are shuffled.
    """
    occ = materialized(occurrences(docs, item_windows(items, item_id, item_text, n), id_col, text_col))
    hit = (occ.select("doc_id", "key", F.explode(F.sequence(F.col("p"), F.col("p") + F.col("len") - 1)).alias("at"))
           .distinct().groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n_hit")))
    found = (occ.select("doc_id", "key", "item").distinct()
             .groupBy("doc_id", "key").agg(F.sort_array(F.collect_list("item")).alias("items")))
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"),
                       n_words(F.col(text_col)).alias("n_words"))
    agg = hit.join(found, hit["doc_id"].eqNullSafe(found["doc_id"]) & (hit["key"] == found["key"])).select(
        hit["doc_id"].alias("_d"), hit["key"].alias("_k"), "n_hit", "items")
    out = base.join(agg, base["doc_id"].eqNullSafe(agg["_d"]) & (base["key"] == agg["_k"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("bigint").alias("n_items"),
                      F.sha2(F.array_join(items_, ",").cast("binary"), 256).alias("items_sha256"),
                      (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_id: str = "item_id", item_text: str = "text", n: int = N_WORDS) -> DataFrame:
    """The documents no window occurs in, with all their columns."""
    occ = occurrences(docs, item_windows(items, item_id, item_text, n), id_col, text_col)
    bad = occ.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct()
    x = docs.withColumn("_key", F.xxhash64(text_col))
    return x.join(bad, x[id_col].eqNullSafe(bad["_d"]) & (x["_key"] == bad["_k"]), "left_anti").drop("_key")


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark WHERE item_id IS NOT NULL),
bl AS (SELECT item, ws, least(len(ws), 10) AS k FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item, k, ws[p:p + k - 1] AS w FROM (SELECT item, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM bl)),
ks AS (SELECT DISTINCT k FROM bl),
dw AS (SELECT r, k, p, ws[p:p + k - 1] AS w FROM
        (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, ks WHERE len(ws) >= k)),
o AS (SELECT r, dw.k, p, item FROM dw JOIN bw ON dw.k = bw.k AND dw.w = bw.w),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM o) GROUP BY r),
i AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM o GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""
