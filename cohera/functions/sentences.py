"""Sentence and word columns.

Sentence rule (re-aim of a Punkt tokenizer, which needs a downloaded model
and a per-row Python library): a sentence ends at ``.``, ``!`` or ``?``
followed by whitespace; the whitespace is dropped, edge whitespace of the
text is dropped, empty pieces are dropped. The rule is one regex that Java
and RE2 read alike, so the DuckDB oracle reproduces it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sentence rule and the word rule.
EDGE_SPACE = r"\A[ \t\r\n]+|[ \t\r\n]+\z"
SENTENCE_BREAK = r"[ \t\r\n](?<=[.!?][ \t\r\n])[ \t\r\n]*"  # the space first: looking back at every character costs more
WORD_BREAK = r"[^\p{L}\p{N}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_sentences(text: Column | str) -> Column:
    """``ARRAY<STRING>`` of sentences; null text gives null."""
    stripped = F.btrim(_col(text), F.lit(" \t\r\n"))  # as EDGE_SPACE
    return F.filter(F.split(stripped, SENTENCE_BREAK), lambda x: x != F.lit(""))


def sentence_count(sentences: Column | str) -> Column:
    """Number of sentences; fewer than two means no shuffle exists."""
    return F.size(_col(sentences))


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable and evaluate ``body(var)`` once.

    Inside higher-order functions a sub-expression referred to twice is
    computed twice (no common-subexpression elimination in lambdas); binding
    it through a one-element ``transform`` computes it once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def canonical_positions(sentences: Column | str) -> Column:
    """0-based position of the first equal sentence, per sentence.

    Two orders hold the same sentences in the same order exactly when their
    canonical position arrays are equal. (Their joined texts can be equal
    beyond that: see ``operators.shuffles.distinct_texts``.) When all sentences differ (the usual
    case) this is ``sequence(0, n-1)``. Otherwise it is O(n log n): sort
    ``(sentence, position)``, find where runs of equal sentences start, and
    give every member of a run the position of its first member.
    """
    s = _col(sentences)
    n = F.size(s)

    def with_sorted(srt):
        starts = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda j: (j == 0) | (F.element_at(srt, j + 1)["x"] != F.element_at(srt, F.greatest(j, F.lit(1)))["x"]))

        def with_starts(st):
            m = F.size(st)

            def run(a, k):
                nxt = F.when(k + 1 < m, F.element_at(st, F.least(k + 2, m))).otherwise(n)
                return let(F.element_at(srt, a + 1)["i"], lambda first: F.transform(
                    F.slice(srt, a + 1, nxt - a), lambda z: F.struct(z["i"].alias("i"), first.alias("c"))))

            return F.transform(F.sort_array(F.flatten(F.transform(st, run))), lambda p: p["c"].cast("int"))

        return let(starts, with_starts)

    srt = F.sort_array(F.transform(s, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return (
        F.when(n == 0, F.array().cast("array<int>"))
        .when(F.size(F.array_distinct(s)) == n, F.sequence(F.lit(0), n - 1))
        .otherwise(let(srt, with_sorted))
    )


def pick_sentences(sentences: Column | str, order: Column) -> Column:
    """Sentences in the order of a 0-based position array."""
    s = _col(sentences)
    return F.transform(order, lambda i: F.element_at(s, i + 1))


def join_sentences(sentences: Column | str, order: Column | None = None) -> Column:
    """Candidate text: sentences (optionally reordered) joined by one space."""
    s = _col(sentences) if order is None else pick_sentences(sentences, order)
    return F.array_join(s, " ")


def word_sets(sentences: Column | str) -> Column:
    """Per sentence, the distinct lower-case words (letters and digits)."""
    return F.transform(
        _col(sentences),
        lambda x: F.array_distinct(F.filter(F.split(F.lower(x), WORD_BREAK), lambda w: w != F.lit(""))),
    )


def plain_words(sentences: Column | str) -> Column:
    """The lower-case words of all sentences as one string: a space between words, a line per sentence.

    Words repeat as they stand and may be empty; ``word_sets`` are their sets.
    """
    return F.array_join(F.transform(_col(sentences), lambda x: F.regexp_replace(F.lower(x), WORD_BREAK, " ")), "\n")


def plain_word_sets(plain: Column | str) -> Column:
    """``word_sets`` from what ``plain_words`` gives (no sentences count as one without words)."""
    return F.transform(F.split(_col(plain), "\n"), lambda x: F.array_distinct(F.filter(F.split(x, " "), lambda w: w != F.lit(""))))
