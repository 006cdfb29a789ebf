"""Sentence boundaries learned from the texts themselves.

The plain rule (``functions.sentences``) cuts after every full stop. Here
three lists are learned without labels, from counts over all texts and
log-likelihood tests (Kiss and Strunk, 2006):

* abbreviations: word types that nearly always carry a full stop, short ones
  and those with inner stops first;
* sentence starters: words that follow a sentence end more often than chance;
* collocations: an abbreviation and a starter that belong together.

A full stop behind an abbreviation or a single letter then ends a sentence
only before a capitalised starter, and not within a collocation.

``learn_boundaries`` makes the lists as a table: tokens and boundaries are
counted by their spelling first, so what is exchanged is one row per task and
different token or pair of neighbours. ``learned_splitter`` is the rule over
them as a column expression (hash-set lookups, no Python, no exchange); it
plugs in wherever a ``splitter`` is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sentences import split_sentences
from ..session import ensure_checkpoint_dir

# Fixed values of the published method: the share of stops behind an
# abbreviation, and the least scores.
ABBREVIATION_SHARE = 0.99
LEAST_ABBREVIATION = 0.3
LEAST_STARTER = 30.0
LEAST_COLLOCATION = 7.88
# The token rule.
SPACE = r"[ \t\r\n]+"
OUTSIDE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$"
LAST_TOKEN = r"[^ \t\r\n]+$"
FIRST_TOKEN = r"^[^ \t\r\n]+"
#: between sentences that were put together; read as a space where a text has it
MARK = "\u0001"
#: entries that a rule looks up
MAX_LISTED = 50_000
KINDS = ("abbreviation", "starter", "collocation")


def word_type(token: Column) -> Column:
    """A token in lower case without outer punctuation and without its last full stop."""
    return F.regexp_replace(F.lower(F.regexp_replace(token, OUTSIDE, "")), r"\.$", "")


def has_stop(token: Column) -> Column:
    """Whether a full stop ends the token (behind it only closing marks)."""
    return F.regexp_replace(token, OUTSIDE, "").endswith(".")


def has_letter(word: Column) -> Column:
    return word.rlike(r"\p{L}")


def _xlog(k: Column, x: Column) -> Column:
    """``k ln x``, zero for ``k`` = 0; ``x`` is kept above zero."""
    return F.when(k == 0, F.lit(0.0)).otherwise(k * F.log(F.greatest(x, F.lit(1e-12))))


def type_counts(records: DataFrame, text: str = "summary") -> DataFrame:
    """(type, c_p, c_n): occurrences of each word type with and without a full stop."""
    tokens = records.select(F.explode(F.split(F.col(text), SPACE)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    types = tokens.select(word_type(F.col("token")).alias("type"), has_stop(F.col("token")).alias("p"), "n").where(has_letter(F.col("type")))
    return types.groupBy("type").agg(F.sum(F.when(F.col("p"), F.col("n")).otherwise(0)).alias("c_p"),
                                     F.sum(F.when(F.col("p"), 0).otherwise(F.col("n"))).alias("c_n"))


def boundary_counts(records: DataFrame, text: str = "summary") -> DataFrame:
    """(type, next, n): neighbours across a full stop and white space."""
    s = split_sentences(F.regexp_replace(F.col(text), MARK, " "))
    x = records.select(s.alias("s")).where(F.size("s") > 1)
    ends = F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1),
                      lambda a, b: F.struct(F.regexp_extract(a, LAST_TOKEN, 0).alias("a"), F.regexp_extract(b, FIRST_TOKEN, 0).alias("b")))
    pairs = x.select(F.explode(ends).alias("e")).select("e.a", "e.b").where(F.col("a").endswith("."))
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return pairs.select(word_type(F.col("a")).alias("type"), word_type(F.col("b")).alias("next"), "n").groupBy("type", "next").agg(
        F.sum("n").alias("n"))


def abbreviation_score(c_p: Column, c_n: Column, total: Column, stops: Column, word: Column) -> Column:
    """Log-likelihood of a type being an abbreviation, weighed by its length, inner stops and occurrences without one."""
    p = stops / total
    null = _xlog(c_p, p) + _xlog(c_n, 1 - p)
    alternative = _xlog(c_p, F.lit(ABBREVIATION_SHARE)) + _xlog(c_n, F.lit(1 - ABBREVIATION_SHARE))
    dots = F.length(word) - F.length(F.replace(word, F.lit("."), F.lit("")))
    letters = F.length(word) - dots
    return -2 * (null - alternative) * F.exp(-letters.cast("double")) * (dots + 1) * F.pow(letters.cast("double"), -c_n.cast("double"))


def together_score(a: Column, b: Column, ab: Column, total: Column) -> Column:
    """Log-likelihood ratio of ``b`` coming with ``a`` against coming anywhere."""
    p, p1, p2 = b / total, ab / a, F.when(total > a, (b - ab) / F.greatest(total - a, F.lit(1))).otherwise(F.lit(1.0))
    rest = total - a - b + ab
    same = _xlog(ab, p) + _xlog(a - ab, 1 - p) + _xlog(b - ab, p) + _xlog(rest, 1 - p)
    apart = _xlog(ab, p1) + _xlog(a - ab, 1 - p1) + _xlog(b - ab, p2) + _xlog(rest, 1 - p2)
    return -2 * (same - apart)


def learn_boundaries(records: DataFrame, text: str = "summary", least: int = 2) -> DataFrame:
    """(kind, type, next, score): abbreviations, starters and collocations of the texts.

    An abbreviation has at least ``least`` occurrences with a full stop. For
    starters ``type`` is null, for abbreviations ``next``. Null and empty texts
    count for nothing.
    """
    ensure_checkpoint_dir(records.sparkSession)
    counts = type_counts(records, text).checkpoint()  # read for the totals and for every list
    bounds = boundary_counts(records, text).checkpoint()
    t = counts.agg(F.coalesce(F.sum(F.col("c_p") + F.col("c_n")), F.lit(0)).alias("total"), F.coalesce(F.sum("c_p"), F.lit(0)).alias("stops")).first()
    total, stops = F.lit(t["total"]), F.lit(t["stops"])
    scored = counts.where(F.col("c_p") >= least).withColumn(
        "score", abbreviation_score(F.col("c_p"), F.col("c_n"), total, stops, F.col("type")))
    found = scored.where(F.col("score") >= LEAST_ABBREVIATION).select("type", "score").checkpoint()
    sizes = counts.select(F.col("type").alias("next"), (F.col("c_p") + F.col("c_n")).alias("b"))
    ends = bounds.join(found.select("type"), "type", "left_anti")
    breaks = F.lit(ends.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    starts = ends.groupBy("next").agg(F.sum("n").alias("ab")).join(sizes, "next").withColumn(
        "score", together_score(breaks, F.col("b"), F.col("ab"), total))
    starts = starts.where((F.col("score") >= LEAST_STARTER) & (F.col("ab") * total > F.col("b") * breaks)).select("next", "score")
    short = found.select("type").union(counts.where(F.col("type").rlike(r"^\p{L}$")).select("type")).distinct()
    pairs = bounds.join(short, "type").join(starts.select("next"), "next").join(sizes, "next")
    pairs = pairs.join(counts.select("type", (F.col("c_p") + F.col("c_n")).alias("a")), "type").withColumn(
        "score", together_score(F.col("a"), F.col("b"), F.col("n"), total))
    pairs = pairs.where((F.col("score") >= LEAST_COLLOCATION) & (F.col("n") * total > F.col("a") * F.col("b")))
    none = F.lit(None).cast("string")
    return found.select(F.lit(KINDS[0]).alias("kind"), "type", none.alias("next"), "score").unionByName(
        starts.select(F.lit(KINDS[1]).alias("kind"), none.alias("type"), "next", "score")).unionByName(
        pairs.select(F.lit(KINDS[2]).alias("kind"), "type", "next", "score"))


def learned_splitter(model: DataFrame, max_listed: int = MAX_LISTED):
    """A sentence splitter (column to column) from the lists of ``learn_boundaries``.

    The text is cut by the plain rule, then put together again, by one space,
    where a full stop does not end the sentence. The lists reach the tasks
    with the plan; their number is checked, and more than ``max_listed``
    entries raise ``ValueError`` (learn with a larger ``least``).
    """
    rows = model.limit(max_listed + 1).collect()
    if len(rows) > max_listed:
        raise ValueError(f"more than {max_listed} entries; learn the boundaries with a larger 'least'")
    lists = {k: sorted((r["type"], r["next"]) for r in rows if r["kind"] == k) if k == KINDS[2] else
             sorted(r["type"] or r["next"] for r in rows if r["kind"] == k) for k in KINDS}

    def listed(value: Column, entries: list[str]) -> Column:
        return value.isin(entries) if entries else F.lit(False)

    def keeps_together(a: Column, b: Column) -> Column:
        last, first = F.regexp_extract(a, LAST_TOKEN, 0), F.regexp_extract(b, FIRST_TOKEN, 0)
        word, follows = word_type(last), word_type(first)
        short = listed(word, lists[KINDS[0]]) | word.rlike(r"^\p{L}$")
        opens = listed(follows, lists[KINDS[1]]) & first.rlike(r"^[^\p{L}]*\p{Lu}")
        paired = listed(F.concat(word, F.lit(" "), follows), [f"{x} {y}" for x, y in lists[KINDS[2]]])
        return last.endswith(".") & short & ~(opens & ~paired)

    def split(text: Column | str) -> Column:
        text = F.col(text) if isinstance(text, str) else text
        parts = split_sentences(F.regexp_replace(text, MARK, " "))

        def whole(s: Column) -> Column:
            marks = F.zip_with(s, F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))),
                               lambda a, b: F.when(b.isNull(), a).otherwise(
                                   F.concat(a, F.when(keeps_together(a, b), F.lit(" ")).otherwise(F.lit(MARK)))))
            return F.filter(F.split(F.array_join(marks, ""), MARK), lambda x: x != F.lit(""))

        return F.element_at(F.transform(F.array(parts), whole), 1)

    return split
