"""Scoring and probability columns (row-wise, JVM side), and coherence and order features of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: eighth of sentences times words of the texts that ``SentenceBits`` holds (bytes of its bits, if no word repeats)
MAX_TABLE = 1 << 25
#: sentences times words marked together (a byte each for a moment)
MARKED = 1 << 24
#: pairs of sentences compared together, of texts with 1,024 words
PAIRS = 1 << 14
#: places of orders scored together
SCORED = 1 << 20
_NONE = np.zeros(1, np.int64)
ORDER_FEATURES = ("first_overlap", "last_overlap", "skip_overlap", "length_change", "first_length")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shared_words(words: Column | str, order: Column) -> Column:
    """Sum over neighbouring sentences of the order of their shared words."""
    w = _col(words)
    last = F.size(order) - 1
    overlaps = F.zip_with(
        F.slice(order, 1, last), F.slice(order, 2, last),
        lambda a, b: F.size(F.array_intersect(F.element_at(w, a + 1), F.element_at(w, b + 1))),
    )
    return F.aggregate(overlaps, F.lit(0).cast("bigint"), lambda acc, x: acc + x.cast("bigint"))


def lexical_coherence_scores(words: Column | str, orders: Column, size_total: Column) -> Column:
    """Stand-in coherence score of every sentence order, needing no model file.

    ``words`` is the per-sentence distinct word sets (``word_sets``),
    ``orders`` the candidates as 0-based sentence positions and
    ``size_total`` the sum of all set sizes. Score = shared words over
    united words, summed over neighbouring sentences (0.0 with fewer than
    two sentences or no words). Only integers and one division, so every
    engine gets the same bits.

    The pair overlaps are computed once per candidate into a struct and the
    ratio is taken in a second pass: lambdas get no common-subexpression
    elimination, so referring to the sum twice would compute it twice.
    """
    w = _col(words)

    def stats(o):
        ends = F.size(F.element_at(w, F.element_at(o, 1) + 1)) + F.size(F.element_at(w, F.element_at(o, -1) + 1))
        return F.when(F.size(o) >= 2, F.struct(shared_words(w, o).alias("sh"), ends.cast("bigint").alias("ends")))

    def ratio(p):
        union = 2 * size_total - p["ends"] - p["sh"]
        return (F.when(p.isNull(), F.lit(0.0))
                .when(union > 0, p["sh"].cast("double") / union.cast("double"))
                .otherwise(F.lit(0.0)))

    return F.transform(F.transform(orders, stats), ratio)


def lexical_coherence(words: Column | str, order: Column, size_total: Column) -> Column:
    """Lexical coherence score of one sentence order (see the array form)."""
    return F.element_at(lexical_coherence_scores(words, F.array(order), size_total), 1)


def candidate_features(words: Column | str, lengths: Column | str, orders: Column) -> Column:
    """``ARRAY<STRUCT>`` of order-dependent features of every candidate.

    Overlaps are shared over united words of the first two, the last two and
    all next-but-one sentences; ``length_change`` is the mean change of length
    between neighbours and ``first_length`` the first sentence's length, both
    as shares of the longest. Fewer than two sentences give zeros.
    """
    w, n = _col(words), _col(lengths)

    def overlap(a, b):
        shared = F.size(F.array_intersect(F.element_at(w, a + 1), F.element_at(w, b + 1)))
        united = F.size(F.element_at(w, a + 1)) + F.size(F.element_at(w, b + 1)) - shared
        return F.when(united > 0, shared / united).otherwise(F.lit(0.0))

    def length(a):
        return F.element_at(n, a + 1)

    def mean(values, count):
        return F.when(count > 0, F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / count).otherwise(F.lit(0.0))

    longest = F.greatest(F.array_max(n), F.lit(1))

    def one(o):
        k = F.size(o)
        skip = F.zip_with(F.slice(o, 1, F.greatest(k - 2, F.lit(0))), F.slice(o, F.least(F.lit(3), k), F.greatest(k - 2, F.lit(0))), overlap)
        change = F.zip_with(F.slice(o, 1, k - 1), F.slice(o, 2, k - 1),
                            lambda a, b: F.abs(length(a) - length(b)).cast("double"))
        full = F.struct(overlap(F.element_at(o, 1), F.element_at(o, 2)).alias("first_overlap"),
                        overlap(F.element_at(o, -2), F.element_at(o, -1)).alias("last_overlap"),
                        mean(skip, k - 2).alias("skip_overlap"),
                        (mean(change, k - 1) / longest).alias("length_change"),
                        (length(F.element_at(o, 1)) / longest).alias("first_length"))
        none = F.struct(*[F.lit(0.0).alias(c) for c in ORDER_FEATURES])
        return F.when(k >= 2, full).otherwise(none)

    return F.transform(orders, one)


def split_words(plain: pa.Array) -> pa.Array:
    """The words of each sentence of each text, from what ``sentences.plain_words`` gives."""
    lines = pc.split_pattern(plain, "\n")
    cut = pc.split_pattern(lines.flatten(), " ")
    words = cut.flatten()
    full = pc.not_equal(words, "")
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    size = pc.list_value_length(cut).to_numpy(zero_copy_only=False)
    at = upto[np.concatenate([[0], np.cumsum(size)])]
    sets = pa.ListArray.from_arrays(pa.array(at, pa.int32()), words.filter(full))
    line_at = np.cumsum(np.concatenate([[0], pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False)]))
    return pa.ListArray.from_arrays(pa.array(line_at, pa.int32()), sets, mask=pc.is_null(lines))


def texts_in(words: pa.Array, orders: pa.Array):
    """``(row, SentenceBits, flat orders, start and end of each order)`` of the rows with both.

    ``words`` holds a list per sentence, or all as ``sentences.plain_words`` gives them. A row whose bits would pass ``MAX_TABLE`` is left out.
    """
    def spans(lists):
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        return size, np.concatenate([[0], np.cumsum(size)])

    if not pa.types.is_list(words.type):
        words = split_words(words)
    _, sentence_at = spans(words)
    sets = words.flatten()
    set_size, word_at = spans(sets)
    codes = sets.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    _, order_at = spans(orders)
    each = orders.flatten()
    order_size, position_at = spans(each)
    positions = each.flatten().to_numpy(zero_copy_only=False)
    both = pc.and_(pc.is_valid(words), pc.is_valid(orders)).to_numpy(zero_copy_only=False)
    number = np.zeros(int(codes.max()) + 1 if len(codes) else 0, np.int64)
    for i in np.flatnonzero(both).tolist():
        s0, s1, o0, o1 = sentence_at[i], sentence_at[i + 1], order_at[i], order_at[i + 1]
        if (s1 - s0) * (word_at[s1] - word_at[s0]) > 8 * MAX_TABLE or o0 == o1:
            continue
        p0 = position_at[o0]
        ends = position_at[o0:o1 + 1] - p0
        yield (i, SentenceBits(codes[word_at[s0]:word_at[s1]], set_size[s0:s1], number),
               positions[p0:position_at[o1]], ends[:-1], ends[1:])


class SentenceBits:
    """The words of one text's sentences as bits: a column per sentence, 64 words to a row."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, number: np.ndarray):
        """``number`` is scratch space with a place for every code."""
        at = np.arange(len(codes))
        number[codes] = at
        last = number[codes]              # one occurrence stands for each word
        word = (np.cumsum(last == at) - 1)[last]
        rows = (int(word.max()) if len(word) else 0) // 64 + 1
        sentence = np.repeat(np.arange(len(sizes)), sizes)
        step = max(1, MARKED // (64 * max(len(sizes), 1)))
        if rows <= step:
            self.bits = self._marked(sentence, word, len(sizes), rows)
        else:
            self.bits = np.empty((rows, len(sizes)), np.uint64)
            for a in range(0, rows, step):
                z = min(a + step, rows)
                part = (word >= 64 * a) & (word < 64 * z)
                self.bits[a:z] = self._marked(sentence[part], word[part] - 64 * a, len(sizes), z - a)
        self.step = max(1 << 8, PAIRS * 16 // max(rows, 16))
        self.sizes = np.bitwise_count(self.bits).sum(0, dtype=np.int64)  # of the sets: words may repeat

    @staticmethod
    def _marked(sentence: np.ndarray, word: np.ndarray, sentences: int, rows: int) -> np.ndarray:
        table = np.zeros((sentences, rows * 64), bool)
        table[sentence, word] = True
        return np.ascontiguousarray(np.packbits(table, axis=1).view(np.uint64).T)

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of words that the sentences ``a`` and ``b`` share, pair by pair."""
        out = np.zeros(len(a), np.int64)
        for k in range(0, len(a), self.step):
            both = self.bits[:, a[k:k + self.step]] & self.bits[:, b[k:k + self.step]]
            out[k:k + self.step] = np.bitwise_count(both).sum(0, dtype=np.int64)
        return out

    def neighbours(self, flat: np.ndarray) -> np.ndarray:
        """Number of words that each sentence shares with the next one of ``flat``."""
        out = np.zeros(max(len(flat) - 1, 0), np.int64)
        for k in range(0, len(out), self.step):
            own = self.bits.take(flat[k:k + self.step + 1], axis=1)
            out[k:k + self.step] = np.bitwise_count(own[:, :-1] & own[:, 1:]).sum(0, dtype=np.int64)
        return out

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Shared over united words, 0 without any."""
        shared = self.shared(a, b)
        united = self.sizes[a] + self.sizes[b] - shared
        return np.where(united > 0, shared / np.maximum(united, 1), 0.0)


def _lists(values: dict[int, pa.Array], rows: int, kind: pa.DataType) -> pa.Array:
    """A list per row, null for rows without one."""
    sizes = np.array([len(values[i]) if i in values else 0 for i in range(rows)], np.int64)
    flat = pa.concat_arrays([pa.array([], kind), *(values[i] for i in sorted(values))])
    absent = pa.array([i not in values for i in range(rows)], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat, mask=absent)


def batch_coherence(words: pa.Array, orders: pa.Array) -> pa.Array:
    """``lexical_coherence_scores`` of an Arrow batch; null for rows that ``texts_in`` leaves out."""
    counts, scores = np.zeros(len(words), np.int64), []
    some, places = [], 0
    for i, bits, flat, start, end in texts_in(words, orders):
        counts[i] = len(start)
        some.append((bits.sizes, flat, start, end, bits.neighbours(flat)))
        places += len(flat)
        if places >= SCORED:
            scores.append(_coherence(some))
            some, places = [], 0
    if some:
        scores.append(_coherence(some))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()),
                                    pa.array(np.concatenate([np.zeros(0), *scores])), mask=pa.array(counts == 0))


def _coherence(texts: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Scores of the orders of some texts, one text after the other.

    ``texts`` has the sizes of the sentences' word sets, flat orders, start and
    end of each order, and the words that neighbours in the flat orders share.
    """
    sizes, flat, start, end, shared = zip(*texts)
    sentence_at = np.cumsum([0, *map(len, sizes)])
    place_at = np.cumsum([0, *map(len, flat)])
    orders = list(map(len, start))
    total = np.repeat([int(x.sum()) for x in sizes], orders)
    before, sentence = np.repeat(place_at[:-1], orders), np.repeat(sentence_at[:-1], orders)
    # up to each place; a text with any has one place more than neighbours
    upto = np.cumsum(np.concatenate([x for places, own in zip(flat, shared) if len(places) for x in (_NONE, own)] or [_NONE]))
    sizes, flat = np.concatenate(sizes), np.concatenate(flat)
    start, end = np.concatenate(start), np.concatenate(end)
    score = np.zeros(len(start))
    on = np.flatnonzero(end - start >= 2)
    if len(on):
        first, last, sentence = start[on] + before[on], end[on] - 1 + before[on], sentence[on]
        both = upto[last] - upto[first]
        united = 2 * total[on] - sizes[flat[first] + sentence] - sizes[flat[last] + sentence] - both
        score[on] = np.where(united > 0, both / np.maximum(united, 1), 0.0)
    return score


def batch_features(words: pa.Array, lengths: pa.Array, orders: pa.Array) -> pa.Array:
    """``candidate_features`` of an Arrow batch; null for rows that ``texts_in`` leaves out."""
    kind = pa.struct([(c, pa.float64()) for c in ORDER_FEATURES])
    length_at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lengths), 0).to_numpy(zero_copy_only=False))])
    all_lengths = lengths.flatten().to_numpy(zero_copy_only=False)
    out = {}
    for i, bits, flat, start, end in texts_in(words, orders):
        own = all_lengths[length_at[i]:length_at[i + 1]].astype(np.int64)
        longest = max(int(own.max()) if len(own) else 1, 1)
        value = np.zeros((len(ORDER_FEATURES), len(start)))
        on = np.flatnonzero(end - start >= 2)
        if len(on):
            first, last = start[on], end[on] - 1
            value[0, on] = bits.overlap(flat[first], flat[first + 1])
            value[1, on] = bits.overlap(flat[last - 1], flat[last])
            skip = bits.overlap(flat[:-2], flat[2:])
            change = np.abs(np.diff(own[flat])).astype(np.float64)
            for j, a, z in zip(on.tolist(), first.tolist(), last.tolist()):
                # summed from the left, as the row's own expression does
                if z - a > 1:
                    value[2, j] = np.cumsum(skip[a:z - 1])[-1] / (z - a - 1)
                value[3, j] = np.cumsum(change[a:z])[-1] / (z - a) / longest
            value[4, on] = own[flat[first]] / longest
        out[i] = pa.StructArray.from_arrays([pa.array(v) for v in value], list(ORDER_FEATURES))
    return _lists(out, len(words), kind)


def softmax(logits: Column | str) -> Column:
    """Max-shifted softmax over an ``ARRAY<DOUBLE>`` of logits."""
    lg = _col(logits)
    m = F.array_max(lg)
    ex = F.transform(lg, lambda x: F.exp(x - m))
    total = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(ex, lambda x: x / total)


def softmax_positive(logits: Column | str, positive_index: int = 1) -> Column:
    """Probability of the positive class (index 1, also for more classes)."""
    return F.element_at(softmax(logits), positive_index + 1)


def log_softmax_at(logits: Column | str, label: Column | str) -> Column:
    """``log p_y`` from logits, numerically stable."""
    lg = _col(logits)
    m = F.array_max(lg)
    lse = m + F.log(F.aggregate(lg, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))
    return F.element_at(lg, _col(label).cast("int") + 1) - lse


def predict_label(probs: Column | str) -> Column:
    """Argmax class; the first maximum wins, so a tie goes to class 0."""
    p = _col(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def logits_from_score(score: Column | str, threshold: float) -> Column:
    """Two-class logits of a fixed linear model over a score: ``[0, s - t]``.

    Class 1 wins exactly when the score exceeds the threshold.
    """
    return F.array(F.lit(0.0), _col(score) - F.lit(float(threshold)))
