"""Orders of many texts scored together, against each text alone."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cohera.functions import scoring as S

WORDS, ORDERS = pa.list_(pa.list_(pa.string())), pa.list_(pa.list_(pa.int32()))


def _texts():
    rnd = random.Random(5)
    words = [[["a"], ["b", "a"], ["a"]], None, [["a"]], [[]], [["x"], ["x"]], [["a", "b"], ["b"]], [["a"], ["a"]]]
    orders = [[[0, 1, 2], [], [1], [2, 1]], [[0]], [[], []], [[0]], None, [[1, 0], [0, 1, 0]], []]
    for _ in range(30):
        n = rnd.randint(1, 12)
        words.append([rnd.sample("abcdefgh", rnd.randint(0, 6)) for _ in range(n)])
        orders.append([rnd.sample(range(n), rnd.randint(0, n)) for _ in range(rnd.randint(1, 21))])
    return words, orders


def _score(words, order):
    sets = [set(words[i]) for i in order]
    shared = sum(len(a & b) for a, b in zip(sets, sets[1:]))
    united = 2 * sum(map(len, map(set, words))) - len(sets[0]) - len(sets[-1]) - shared if len(sets) > 1 else 0
    return shared / united if united > 0 else 0.0


@pytest.mark.parametrize("scored", [1, 40, 1 << 20])
def test_scores_of_each_text(monkeypatch, scored):
    words, orders = _texts()
    monkeypatch.setattr(S, "SCORED", scored)
    got = S.batch_coherence(pa.array(words, WORDS), pa.array(orders, ORDERS)).to_pylist()
    assert got == [[_score(w, o) for o in os] if w is not None and os else None for w, os in zip(words, orders)]


def test_neighbours_share_words_as_any_two_do():
    rnd = np.random.default_rng(2)
    sizes = rnd.integers(0, 40, 60)
    codes = rnd.integers(0, 900, sizes.sum())
    bits = S.SentenceBits(codes, sizes, np.zeros(900, np.int64))
    bits.step = 7
    for flat in (rnd.integers(0, 60, 500), np.zeros(0, np.int64), np.array([3])):
        assert bits.neighbours(flat).tolist() == bits.shared(flat[:-1], flat[1:]).tolist()
