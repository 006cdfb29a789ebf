"""SimHash components, vector codes and collocations against brute force, and their odd inputs."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash

from cohera.llm import collocations, simhash, vector_codes
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, fp string, a int, n int, word string, mask string"


def docs(spark, rows):
    """(id, text, lang) as a table whose extra columns clash with the operators' own names."""
    return spark.createDataFrame([(i, t, g, "x", 1, 2, "w", "m") for i, t, g in rows], DOCS)


def rows_of(df, key):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is None, r[key], str(r)))


# -------------------------------------------------------------------- simhash
def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """{fingerprint: smallest linked index} by comparing all pairs."""
    own = sorted(set(prints))
    up = list(range(len(own)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(own)):
        for j in range(i):
            if (own[i] ^ own[j]).bit_count() <= 3:
                up[root(i)] = root(j)
    return {x: root(i) for i, x in enumerate(own)}


def near_texts(seed=5):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(3000)}" for _ in range(400)]
    out = [None, "", " \t\n", "One", "one two", "ONE  two\nthree", "one two three", "x" * 5000, " ".join(base * 60)]
    for i in range(60):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 5])):
            t[rng.randrange(len(t))] = f"v{rng.randrange(9)}"
        out += [" ".join(t)] * rng.choice([1, 1, 3])
    return out + [" ".join(rng.choices(base, k=rng.choice([1, 5, 60]))) for _ in range(60)]


@pytest.mark.parametrize("bucket", [None, 60])
def test_simhash_components(spark, monkeypatch, bucket):
    if bucket:
        monkeypatch.setattr(simhash, "BUCKET", bucket)
    texts = near_texts()
    ids = [7 * i % 1009 for i in range(len(texts))]
    ids[3], ids[12] = None, ids[11]
    got = rows_of(simhash.near_components(docs(spark, [(i, t, "en") for i, t in zip(ids, texts)])), "doc_id")
    prints = [plain_fingerprint(t) for t in texts]
    classes = plain_components(prints)
    members = collections.defaultdict(list)
    for i, p in zip(ids, prints):
        members[classes[p]].append(i)
    want = []
    for i, p in zip(ids, prints):
        m = members[classes[p]]
        want.append({"doc_id": i, "fingerprint": f"{p:016x}", "component_id": min((x for x in m if x is not None), default=None),
                     "component_size": len(m)})
    assert got == sorted(want, key=lambda r: (r["doc_id"] is None, r["doc_id"], str(r)))
    assert max(map(len, members.values())) > 30 and any(r["fingerprint"] == "0" * 16 for r in got)


def test_simhash_index_finds_every_pair():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fp = np.concatenate([rng.integers(0, 1 << 63, 300, dtype=np.uint64), np.array([0, 1, 2, (1 << 64) - 1, 1 << 63], np.uint64)])
    for c in centre:
        near = np.full(80, c)
        for _ in range(3):
            near = near ^ (np.uint64(1) << rng.integers(0, 64, 80, dtype=np.uint64))
        fp = np.concatenate([fp, near])
    fp = np.unique(fp)
    bucket = np.sort(rng.integers(0, 3, len(fp)))
    new = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    got = {(int(a), int(b)) for q, r in simhash.GrayIndex(fp, new).pairs(3) for a, b in zip(q, r)}
    want = {(i, j) for j in range(len(fp)) for i in range(j)
            if bucket[i] == bucket[j] and (int(fp[i]) ^ int(fp[j])).bit_count() <= 3}
    assert got == want and len(want) > 200


def test_simhash_batches_cut_between_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SEARCHED", 10)
    rng = random.Random(1)
    own = sorted({rng.randrange(1 << 16) << 48 | rng.randrange(1 << 5) for _ in range(400)} | {rng.randrange(1 << 7) for _ in range(90)})
    df = spark.createDataFrame([(simhash.signed(x),) for x in own], "fp bigint")
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.linked(df).collect()]
    assert all((a ^ b).bit_count() <= 3 * 90 for a, b in links)
    up = {x: x for x in own}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[root(a)] = root(b)
    want = plain_components(own)
    pairs = {frozenset((root(x), root(y))) for x in own for y in own if want[x] == want[y]}
    assert all(len(p) == 1 for p in pairs)
    assert len({root(x) for x in own}) == len(set(want.values()))


def test_simhash_empty_and_gray_order(spark):
    assert simhash.near_components(docs(spark, [])).count() == 0
    ranks = spark.range(64).select("id", simhash.gray_rank(simhash.F.col("id")).alias("r")).orderBy("r").collect()
    order = [r["id"] for r in ranks]
    assert all((a ^ b).bit_count() == 1 for a, b in zip(order, order[1:]))


# --------------------------------------------------------------- vector codes
VECTORS = "vec_id bigint, embedding array<float>, label int, code string, part int, v string"


def plain_codes(rows, parts, entries, rounds):
    kept = []
    for i, x, label in rows:
        if not x or any(c is None or not math.isfinite(c) or abs(c) >= 65536 for c in x):
            continue
        kept.append((i, [math.floor(256 * float(np.float32(c))) for c in x], label))
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = len(order[0][1])
    kept, order = [[r for r in k if len(r[1]) == dims] for k in (kept, order)]
    w = dims // parts
    cut = lambda v: [tuple(v[p * w:(p + 1) * w]) for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in order[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda p, c: min((dist(c, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = collections.defaultdict(list)
            for _, v, _ in kept:
                own[best(p, cut(v)[p])[1]].append(cut(v)[p])
            new.append([tuple(sum(c) // len(own[k]) for c in zip(*own[k])) if k in own else e for k, e in enumerate(books[p])])
        books = new
    out = []
    for i, v, label in kept:
        near = [best(p, c) for p, c in enumerate(cut(v))]
        out.append({"vec_id": i, "label": label, "code": "".join(f"{k:02x}" for _, k in near), "error": sum(d for d, _ in near)})
    per = collections.Counter()
    for r in out:
        per[r["label"]] += r["error"]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [r | {"label_error": per[r["label"]], "codebooks_sha256": digest} for r in out]


def some_vectors(n=700, dims=32, seed=2):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 0.2, (12, dims))
    x = np.round(centre[rng.integers(0, 12, n)] + rng.normal(0, 0.03, (n, dims)), 2)  # coarse: many ties
    rows = [(int(i), [float(c) for c in v], int(i) % 5 if i % 7 else None) for i, v in zip(rng.permutation(n), x)]
    bad = [(3, None, 1), (1, [], 1), (2, [float("nan")] + [0.0] * (dims - 1), 1), (2, [None] + [0.0] * (dims - 1), 1),
           (5, [float("inf")] * dims, 0), (-1, [1e9] * dims, 0), (900, [0.5] * (dims + 1), 2)]
    return rows + bad + [(4, rows[0][1], 1), (4, rows[0][1], 1), (None, rows[3][1], None)] + [(5000 + i, [0.25] * dims, 3) for i in range(150)]


@pytest.mark.parametrize("block", [4096, 37])
def test_vector_codes(spark, monkeypatch, block):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rows = some_vectors()
    df = spark.createDataFrame([(i, x, g, "c", 1, "v") for i, x, g in rows], VECTORS)
    got = rows_of(vector_codes.vector_codes(df, parts=8, entries=20, rounds=3), "vec_id")
    want = plain_codes(rows, 8, 20, 3)
    assert got == sorted(want, key=lambda r: (r["vec_id"] is None, r["vec_id"], str(r)))


def test_vector_codes_few_and_none(spark):
    few = [(9, [0.1, -0.2, 0.3, 0.4], 1), (8, [0.1, -0.2, 0.3, 0.5], None)]
    df = spark.createDataFrame([(i, x, g, "c", 1, "v") for i, x, g in few], VECTORS)
    got = rows_of(vector_codes.vector_codes(df, parts=2), "vec_id")
    assert got == sorted(plain_codes(few, 2, 64, 2), key=lambda r: r["vec_id"])
    none = vector_codes.vector_codes(df.where("vec_id > 99"))
    assert none.count() == 0 and none.columns == list(got[0])
    with pytest.raises(ValueError):
        vector_codes.vector_codes(df, parts=3)


def test_dual_tree_assigns_like_all_distances():
    rng = np.random.default_rng(0)
    v = rng.integers(-300, 300, (1000, 24))
    v[:400] = v[0]  # a node that is settled whole
    books = np.ascontiguousarray(v[rng.integers(0, 1000, 30)].reshape(30, 6, 4).transpose(1, 0, 2))
    books[:, 7] = books[:, 3]  # equal entries: the lower index wins
    tree = vector_codes.Tree.grown(v, 6)
    again = vector_codes.Tree.unpacked(tree.packed(), 1000, 6)
    codes, sums, counts = vector_codes.assign(again, vector_codes.EntryTree(books))
    for p in range(6):
        part = v[:, 4 * p:4 * p + 4]
        want = ((part[:, None] - books[p][None]) ** 2).sum(2).argmin(1)
        assert (codes[p] == want[tree.order[p]]).all()
        assert (counts[p] == np.bincount(want, minlength=30)).all()
        assert (sums[p] == [part[want == k].sum(0) for k in range(30)]).all()


# --------------------------------------------------------------- collocations
def plain_collocations(rows, least, top):
    counts, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i:i + k])] += 1
    cands = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    inside = collections.defaultdict(int)
    for (g, p), a in cands.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[g, p[i:i + k]] = max(inside[g, p[i:i + k]], a)
    out = collections.defaultdict(list)
    for (g, p), a in cands.items():
        if 100 * inside[g, p] >= 100 * a:
            continue
        s, _, l, r = min((1000 * a * n[g] // (counts[g, p[:k]] * counts[g, p[k:]]), k, counts[g, p[:k]], counts[g, p[k:]])
                         for k in range(1, len(p)))
        out[g].append((-s, -a, " ".join(p).encode(), l, r))
    return [{"lang": g, "rank": i + 1, "phrase": ph.decode(), "a": -a, "l": l, "r": r, "n": n[g], "score": -s}
            for g, v in out.items() for i, (s, a, ph, l, r) in enumerate(sorted(v)[:top])]


def phrase_rows(seed=4):
    rng = random.Random(seed)
    words = ["the", "The", "of", "état", "word", "a", "b", " x", "c-d", "日本"]
    common = "new york city hall is"
    rows = [(0, None, "en"), (1, "", None), (2, " \t ,.;", "en"), (3, "a a a a a a", "en"), (4, "a " * 9000 + common, None)]
    for i in range(150):
        t = [rng.choice(words) + ("" if rng.random() < 0.6 else str(rng.randrange(40))) for _ in range(rng.choice([0, 3, 40]))]
        t.insert(rng.randrange(len(t) + 1), rng.choice([common, "New  York\tCity", "new york, city", "x\ny z"]))
        rows.append((i % 50, rng.choice([" ", "  ", "\t"]).join(t), rng.choice(["en", "fr", None, "und"])))
    return rows + [(9, "one very common line of words", "de")] * 40


@pytest.mark.parametrize("hot, keys", [(500_000, 4 << 20), (30, 4 << 20), (500_000, 3)])
def test_collocations(spark, monkeypatch, hot, keys):
    monkeypatch.setattr(collocations, "HOT", hot)
    monkeypatch.setattr(collocations, "MAX_KEYS", keys)
    monkeypatch.setattr(collocations, "HELD", 700)
    if keys < 10:  # too many names to send: the list of hot pairs is empty here
        monkeypatch.setattr(collocations, "HOT", 10_000_000)
    rows = phrase_rows()
    got = rows_of(collocations.collocations(docs(spark, rows), least=4, top=25), "phrase")
    want = plain_collocations(rows, 4, 25)
    assert got == sorted(want, key=lambda r: (r["phrase"], str(r))) and len(want) > 40


def test_collocations_words_that_share_a_hash(spark, monkeypatch):
    real = collocations._hashes

    def weak(values, starts, ends, seed):  # the first hash knows only a word's length
        return real(values, starts, ends, seed) if seed else (ends - starts).astype(np.uint64)

    monkeypatch.setattr(collocations, "_hashes", weak)
    rows = phrase_rows(6)
    got = rows_of(collocations.collocations(docs(spark, rows), least=6, top=9), "phrase")
    assert got == sorted(plain_collocations(rows, 6, 9), key=lambda r: (r["phrase"], str(r)))


def test_multikey_counts():
    rng = np.random.default_rng(8)
    keys = rng.integers(1, 5, (4000, 6)).astype(np.uint64)
    ends = rng.integers(2, 7, 4000)
    keys[np.arange(6)[None] >= ends[:, None]] = 0
    weights = rng.integers(1, 4, 4000)
    want = collections.Counter()
    for k, e, w in zip(keys.tolist(), ends, weights.tolist()):
        for m in range(3, e + 1):
            want[tuple(k[:m])] += w
    got = {tuple(keys[r, :m].tolist()): c for r, m, c in collocations.multikey_counts(keys, weights, 50, 3)}
    assert got == {k: c for k, c in want.items() if c >= 50} and got


def test_collocations_empty(spark):
    assert collocations.collocations(docs(spark, [])).count() == 0
    assert collocations.collocations(docs(spark, [(1, None, None)])).count() == 0


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_collocations"])
def test_oracle(spark, name):
    from cohera.llm import queries

    ok, msg = compare(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLE_SQL[name])
    assert ok, msg
