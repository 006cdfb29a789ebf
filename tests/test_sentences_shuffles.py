"""Sentence rule and the unique-shuffle contract (fixture table of FIXTURES §3)."""

import math
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from cohera.functions.sentences import canonical_positions, split_sentences, word_sets
from cohera.operators.shuffles import enumerable_sizes, generate_shuffles, shuffle_texts


def _sentences(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "record_id long, summary string")
    return df.withColumn("sentences", split_sentences("summary"))


def test_split_rule(spark):
    rows = _sentences(spark, ["  A. B!  C? d", "", "   ", "One only", "x.\ny.\n", "a.. b. . c"]).orderBy(
        "record_id").collect()
    assert rows[0].sentences == ["A.", "B!", "C?", "d"]
    assert rows[1].sentences == []
    assert rows[2].sentences == []
    assert rows[3].sentences == ["One only"]
    assert rows[4].sentences == ["x.", "y."]
    assert rows[5].sentences == ["a..", "b.", ".", "c"]


def test_canonical_positions(spark):
    df = _sentences(spark, ["A. A. B.", "A. B. C.", "B. A. B. A."])
    got = {r.record_id: r.c for r in df.select("record_id", canonical_positions("sentences").alias("c")).collect()}
    assert got == {0: [0, 0, 2], 1: [0, 1, 2], 2: [0, 1, 0, 1]}


def test_word_sets(spark):
    df = _sentences(spark, ["Hello, hello World! É é 12x."])
    w = df.select(word_sets("sentences").alias("w")).first().w
    assert w == [["hello", "world"], ["é", "12x"]]


CASES = [
    ("", 20, 0),
    ("Only one.", 20, 0),
    ("A. B.", 20, 1),
    ("A. A.", 20, 0),
    ("A. A. B.", 20, 2),
    ("A. B. C.", 20, 5),
    ("A. B. C. D. E. F.", 20, 20),
    (" ".join(f"S{i}." for i in range(12)), 20, 20),
    (" ".join("Same." for _ in range(12)), 20, 0),
    ("A. B. C.", 0, 0),
    ("A. B. C. D. E. F. G.", 3, 3),
]


@pytest.mark.parametrize("text,k,expected", CASES)
def test_shuffle_counts(spark, text, k, expected):
    df = generate_shuffles(_sentences(spark, [text]), k_max=k, seed=7)
    row = df.select("n_neg", "negs", "canon", "sentences", shuffle_texts().alias("texts")).first()
    assert row.n_neg == expected
    s = row.sentences
    orig = tuple(s)
    texts = row.texts
    assert len(set(texts)) == len(texts)                  # unique strings
    for o, t in zip(row.negs, texts):
        assert sorted(o) == sorted(row.canon)             # a permutation of the sentences
        assert tuple(s[i] for i in o) != orig             # never the original order
        assert t == " ".join(s[i] for i in o)


def test_enumerated_count_is_min_of_distinct_and_want(spark):
    text = "A. B. C. A."  # 4!/2! = 12 distinct orders, 11 without the original
    row = generate_shuffles(_sentences(spark, [text]), k_max=20, seed=1).first()
    assert row.method == "enumerate" and row.n_neg == 11
    distinct = set(permutations(row.sentences)) - {tuple(row.sentences)}
    assert len(distinct) == 11


def test_plan_heuristic():
    assert enumerable_sizes(20) == [2, 3, 4, 5, 6]
    assert enumerable_sizes(2521) == [2, 3, 4, 5, 6, 7]
    assert enumerable_sizes(20161) == [2, 3, 4, 5, 6, 7, 8]
    assert enumerable_sizes(181441) == [2, 3, 4, 5, 6, 7, 8, 9]
    assert math.factorial(6) < 1000


def test_same_seed_same_rows_under_other_partitioning(spark):
    texts = [" ".join(f"W{i}x{j}." for j in range(3 + i % 9)) for i in range(60)]
    base = _sentences(spark, texts)
    a = generate_shuffles(base.repartition(1), k_max=20, seed=5).select("record_id", "negs")
    b = generate_shuffles(base.repartition(7, "summary"), k_max=20, seed=5).select("record_id", "negs")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    c = generate_shuffles(base, k_max=20, seed=6).select("record_id", "negs")
    assert sorted(map(tuple, a.collect())) != sorted(map(tuple, c.collect()))


def test_sample_branch_matches_attempt_loop(spark):
    """The array form equals an explicit attempt loop over the same keys."""
    text = "A. B. C. D. E. F. G. H."
    row = generate_shuffles(_sentences(spark, [text]), k_max=20, seed=42).first()
    n, canon, want = 8, list(range(8)), 20
    found = []
    for j in range(1, 5 * want + 11):
        order = [canon[i] for i in _drawn(42, 0, j, n)]
        if order != canon and order not in found:
            found.append(order)
        if len(found) == want:
            break
    assert [list(o) for o in row.negs] == found


def _drawn(seed, rid, j, n):
    """Positions in the order of their 8-digit keys, four to a digest."""
    import hashlib

    hexes = [hashlib.md5(f"{seed}|{rid}|{j}|{b}".encode()).hexdigest() for b in range((n + 3) // 4)]
    return sorted(range(n), key=lambda i: (hexes[i // 4][8 * (i % 4):8 * (i % 4) + 8], i))


def _python_shuffles(rid, sentences, k, seed):
    """Plain-Python statement of the contract, with the same md5 draws."""
    import hashlib

    def text(order):
        return " ".join(sentences[i] for i in order)

    n = len(sentences)
    canon = [sentences.index(x) for x in sentences]
    if n < 2:
        return []
    want = min(math.factorial(n) - 1, k) if n <= 12 else k
    if want <= 0:
        return []
    enum = n < 10 and (math.factorial(n) < 2 * k or math.factorial(n) < 1000)
    if enum:
        orders = {tuple(canon[i] for i in p) for p in permutations(range(n))} - {tuple(canon)}
        keyed = sorted((hashlib.md5(f"{seed}|{rid}|p|{','.join(map(str, o))}".encode()).hexdigest(), o)
                       for o in orders)
        found = []
        for _, o in keyed[:want]:  # sampled as orders first, equal texts dropped after
            if text(o) not in map(text, found):
                found.append(list(o))
        return found
    found = []
    for j in range(1, 5 * want + 11):
        o = [canon[i] for i in _drawn(seed, rid, j, n)]
        if o != canon and text(o) not in map(text, found):
            found.append(o)
        if len(found) == want:
            break
    return found


def test_random_texts_match_plain_python(spark):
    import random

    rnd = random.Random(12)
    texts = []
    for _ in range(200):
        n = rnd.choice([0, 1, 2, 3, 4, 5, 6, 7, 9, 12])
        pool = [f"P{x}." for x in range(max(1, rnd.randint(1, n + 1)))]  # repeats likely
        texts.append(" ".join(rnd.choice(pool) for _ in range(n)))
        texts.append(" ".join(rnd.choice(["A.", "d A.", "A. d", "B."]) for _ in range(n)) + " d")  # open end: texts can meet
    texts.append("d A. A. d")
    for k in (3, 20):
        rows = generate_shuffles(_sentences(spark, texts), k_max=k, seed=9).select(
            "record_id", "sentences", "negs").collect()
        for r in rows:
            assert [list(o) for o in r.negs] == _python_shuffles(r.record_id, list(r.sentences), k, 9), r


def test_different_orders_of_one_text_count_once(spark):
    row = generate_shuffles(_sentences(spark, ["d A. A. d"]), k_max=20, seed=3).select(
        shuffle_texts().alias("texts"), "n_neg").first()
    assert sorted(row.texts) == ["A. d A. d", "A. d d A.", "d A. d A.", "d d A. A."] and row.n_neg == 4


@pytest.mark.parametrize("n,k", [(8, 20161), (9, 181441)])
def test_large_k_max_enumerates(spark, n, k):
    text = " ".join(f"S{i}." for i in range(n))
    row = generate_shuffles(_sentences(spark, [text]), k_max=k, seed=1).select(
        "method", "n_neg", F.size(F.array_distinct(F.transform("negs", lambda o: F.array_join(o, ",")))).alias("d")).first()
    assert (row.method, row.n_neg) == ("enumerate", min(math.factorial(n) - 1, k)) and row.d == row.n_neg
