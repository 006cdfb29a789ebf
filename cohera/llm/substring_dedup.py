"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

Every window of ``WINDOW`` consecutive words gets a rolling (prefix-sum)
64-bit hash and, from another base over separately hashed words, a 32-bit
check. Windows are dealt by hash into buckets of bounded size, counted
there, and the ones that occur more than once, in any document, come back as
positions; positions that follow each other merge into maximal intervals,
and the words they cover are removed.

What moves per window is its hash, its check and about one byte of address. A
hash that a piece of the input holds several times is sent once, marked as
repeated, so a passage that a third of all documents share reaches its bucket
once per piece and not once per document. Windows count as equal where hash
and check are; words are not compared. Of N windows, one that occurs once is
taken for repeated with odds of N / 2**96.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, materialized, range_hashes, text_batches, word_spans

WINDOW = 35
#: text whose windows one bucket counts, on average
BUCKET_BYTES = 12 << 20
#: intervals up to this size are broadcast to the texts; beyond, both are shuffled by key
MAX_BROADCAST = 64 << 20

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False

#: odd multiplier of the checks
CHECK_BASE = 0xD1342543DE82EF95

_ASK = "bucket int, hashes binary, checks binary, many binary, many_checks binary, keys binary, counts binary, gaps binary"


def _planes(x: np.ndarray) -> bytes:
    """uint32 values as four byte planes: small values compress to about a byte each."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _pack(keys: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Addresses as (keys of documents, positions per document, gaps between positions)."""
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    gaps = np.diff(pos, prepend=0)
    gaps[first] = pos[first]
    return keys[doc[first]].astype("<i8").tobytes(), _planes(np.diff(np.append(first, len(doc)))), _planes(gaps)


def _unpack(keys: bytes, counts: bytes, gaps: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, document of each position, positions)."""
    n, g = _from_planes(counts), _from_planes(gaps)
    first = np.cumsum(n) - n
    run = np.cumsum(g)
    base = (run[first] - g[first]) if len(n) else run
    return np.frombuffer(keys, "<i8"), np.repeat(np.arange(len(n)), n), run - np.repeat(base, n)


def window_hashes(buf: np.ndarray, offs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, position of the first word, hash, check) of every window of the texts in a buffer."""
    starts, ends, doc = word_spans(buf, offs, _IS_WORD)
    if len(doc) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    at = np.flatnonzero(doc[:len(doc) - window + 1] == doc[window - 1:])
    first = np.searchsorted(doc, doc[at])
    h, check = (range_hashes(range_hashes(buf, starts, ends, base), at, at + window, base) for base in (BASE, CHECK_BASE))
    return doc[at], at - first, h, (check >> np.uint64(32)).astype(np.uint32)


def _alike(h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of equal (hash, check): a member of each, each row's group, sizes."""
    _, first, inv, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    if (check != check[first][inv]).any():  # different windows share a hash
        _, first, inv, n = np.unique(np.stack([h, check.astype(np.uint64)], 1), axis=0, return_index=True,
                                     return_inverse=True, return_counts=True)
    return first, inv.ravel(), n


def _ask(batches, n_buckets: int, window: int):
    for part, buf, offs in text_batches(batches, "text"):
        doc, pos, h, check = window_hashes(buf, offs, window)
        if not len(h):
            continue
        keys = part.column(part.schema.get_field_index("key")).to_numpy()
        first, inv, n = _alike(h, check)
        many = first[n > 1]
        again = n[inv] > 1
        del first, inv, n
        bucket = ((h >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64)
        once = np.flatnonzero(~again)
        order = once[np.argsort(bucket[once], kind="stable")]
        edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        many = many[np.argsort(bucket[many], kind="stable")]
        many_edges = np.searchsorted(bucket[many], np.arange(n_buckets + 1))
        rows = []
        for b in np.flatnonzero((np.diff(edges) > 0) | (np.diff(many_edges) > 0)).tolist():
            own, twice = order[edges[b]:edges[b + 1]], many[many_edges[b]:many_edges[b + 1]]
            rows.append((b, h[own].tobytes(), check[own].tobytes(), h[twice].tobytes(), check[twice].tobytes(),
                         *_pack(keys, doc[own], pos[own])))
        if again.any():  # known to be repeated: no hash, addresses only
            own = np.flatnonzero(again)
            rows.append((int(h[own[0]] % np.uint64(n_buckets)), b"", b"", b"", b"", *_pack(keys, doc[own], pos[own])))
        kinds = [pa.int32()] + [pa.binary()] * 7
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                         ["bucket", "hashes", "checks", "many", "many_checks", "keys", "counts", "gaps"])


def _answer(table: pa.Table, n_bins: int) -> pa.Table:
    """Addresses of one bucket's repeated windows, packed into a row per bin of documents."""
    sent = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
    def column(*names: str, kind: type) -> np.ndarray:
        return np.concatenate([np.frombuffer(x, kind) for c in names for x in table[c].to_pylist()])

    _, inv, n = _alike(column("hashes", "many", kind=np.uint64), column("checks", "many_checks", kind=np.uint32))
    here = sum(map(len, sent))
    again = n > 1
    again[inv[here:]] = True  # those that a piece holds several times
    repeated = again[inv[:here]]
    del inv, n, again
    found, start = [], 0
    for hashes, keys, counts, gaps in zip(sent, *(table[c].to_pylist() for c in ("keys", "counts", "gaps"))):
        hit = repeated[start:start + len(hashes)] if len(hashes) else None
        start += len(hashes)
        if hit is not None and not hit.any():
            continue
        key, doc, pos = _unpack(keys, counts, gaps)
        if hit is not None:
            doc, pos = doc[hit], pos[hit]
        found.append((key[doc], pos))
    rows = []
    if found:
        key, pos = (np.concatenate(x) for x in zip(*found))
        into = (key.view(np.uint64) % np.uint64(n_bins)).astype(np.int64)
        order = np.lexsort((pos, key, into))
        key, pos, into = key[order], pos[order], into[order]
        edges = np.flatnonzero(np.concatenate([[True], into[1:] != into[:-1], [True]]))
        for a, b in zip(edges[:-1], edges[1:]):
            own, doc = np.unique(key[a:b], return_inverse=True)
            rows.append((int(into[a]), *_pack(own, doc, pos[a:b])))
    kinds = {"bin": pa.int32(), "keys": pa.binary(), "counts": pa.binary(), "gaps": pa.binary()}
    return pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(kinds.items())})


def _merge(table: pa.Table, window: int) -> pa.Table:
    """A bin's positions to maximal intervals [from, to) of words, packed pairs per document."""
    found = []
    for keys, counts, gaps in zip(*(table[c].to_pylist() for c in ("keys", "counts", "gaps"))):
        key, doc, pos = _unpack(keys, counts, gaps)
        found.append((key[doc], pos))
    key, pos = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((pos, key))
    key, pos = key[order], pos[order]
    other = np.concatenate([[True], key[1:] != key[:-1]])
    new = np.flatnonzero(other | np.concatenate([[True], pos[1:] > pos[:-1] + window]))
    last = np.append(new[1:], len(pos)) - 1
    spans = np.stack([pos[new], pos[last] + window], 1).astype("<u4")
    edges = np.append(np.flatnonzero(other[new]), len(new))
    return pa.table({"key": pa.array(key[new[edges[:-1]]], pa.int64()),
                     "spans": pa.array([spans[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())})


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, key): the key is a hash of id and text, so equal rows share it and nothing else does."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn(
        "key", F.xxhash64("doc_id", "text"))


def repeated_spans(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, spans): maximal intervals of words that repeated windows cover, of the texts that have any."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(1, math.ceil(total / BUCKET_BYTES))
    asked = rows.select("key", "text").mapInArrow(lambda b: _ask(b, n_buckets, window), _ASK)
    answers = asked.groupBy("bucket").applyInArrow(lambda t: _answer(t, n_buckets),
                                                   "bin int, keys binary, counts binary, gaps binary")
    return answers.groupBy("bin").applyInArrow(lambda t: _merge(t, window), "key bigint, spans binary")


def _cut(batches, keep_text: bool):
    for part, buf, offs in text_batches(batches, "text"):
        spans = part.column(part.schema.get_field_index("spans")).to_pylist()
        raw, n_words, n_removed, digest, texts = buf.tobytes(), [], [], [], []
        for i, span in enumerate(spans):
            words = raw[offs[i]:offs[i + 1]].split()  # bytes.split cuts at exactly 0x20 and 0x09-0x0D
            n = len(words)
            if span:
                kept, at = [], 0
                for a, b in np.frombuffer(span, "<u4").reshape(-1, 2).tolist():
                    kept += words[at:a]
                    at = b
                words = kept + words[at:]
            text = b" ".join(words)
            n_words.append(n)
            n_removed.append(n - len(words))
            digest.append(hashlib.sha256(text).hexdigest())
            if keep_text:
                texts.append(text.decode("utf-8"))
        cols = [part.column(part.schema.get_field_index("doc_id")), pa.array(n_words, pa.int64()),
                pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
        head = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if keep_text:
            cols.append(pa.array(texts, pa.string()))
            head.append("kept")
        yield pa.RecordBatch.from_arrays(cols, head)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                   keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and the ``kept`` text).

    Null and empty texts have no words; texts shorter than a window lose
    nothing. Rows that repeat repeat each other's windows, so all of them
    lose those words. Texts of any length are read whole; other columns,
    whatever their names, are not read. An empty table gives no rows. The interval table is
    written once; it is broadcast if its measured size allows, else joined
    by a shuffle.
    """
    rows = keyed(docs, id_col, text_col)
    spans = materialized(repeated_spans(rows, window))
    size = spans.agg(F.sum(F.octet_length("spans") + 32)).first()[0] or 0
    if size <= MAX_BROADCAST:
        spans = F.broadcast(spans)
    x = rows.join(spans, "key", "left").select("doc_id", "text", "spans")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept string" if keep_text else "")
    return x.mapInArrow(lambda b: _cut(b, keep_text), schema)
