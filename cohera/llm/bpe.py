"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is cut into pre-tokens by a pattern; each is merged separately. The
merge order comes from a queue with one bucket per merge rank. A bucket
holds linked-list positions; a three-level bitmap marks the buckets that
hold any, so find-first-set gives the lowest rank in three steps whatever
the length. Entries whose pair has changed since are stale and skipped.

Many distinct pre-tokens share one queue (no pair crosses a border), which
spreads its cost; a single pre-token of any length works the same way, in
time near linear in its length. Per worker, results are kept for a bounded
number of pre-tokens.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import text_batches

#: pre-tokens kept per worker, and the longest that is kept
MEMO_PIECES = 200_000
MEMO_BYTES = 64
#: ranks of token pairs kept per worker
MEMO_PAIRS = 200_000
#: text whose pre-tokens are merged together
PIECE_BYTES = 1 << 20
#: up to here plain lists are quicker to set up than arrays
FEW_BYTES = 128
_NONE = -1


class RankQueue:
    """Positions by rank; the lowest rank first, in a rank from left to right."""

    def __init__(self, n_ranks: int):
        self.low = [0] * ((n_ranks >> 6) + 1)
        self.mid = [0] * ((n_ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        self._mark(rank)

    def fill(self, rank: int, positions: list[int]) -> None:
        """Give an empty bucket its positions."""
        self.buckets[rank] = positions
        self._mark(rank)

    def _mark(self, rank: int) -> None:
        w, v = rank >> 6, rank >> 12
        self.low[w] |= 1 << (rank & 63)
        self.mid[v] |= 1 << (w & 63)
        self.top |= 1 << v

    def take(self) -> tuple[int, list[int]] | None:
        """Remove and return the lowest rank's bucket."""
        if not self.top:
            return None
        v = (self.top & -self.top).bit_length() - 1
        m = self.mid[v]
        w = (v << 6) | ((m & -m).bit_length() - 1)
        x = self.low[w]
        rank = (w << 6) | ((x & -x).bit_length() - 1)
        self.low[w] = x & (x - 1)
        if not self.low[w]:
            self.mid[v] = m & (m - 1)
            if not self.mid[v]:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class ByteBPE:
    """Encoder and decoder for a table of byte strings and their ranks (= ids)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_pieces: int | None = None):
        self.ranks = ranks
        self.memo_pieces = memo_pieces
        self.pattern = regex.compile(pattern)
        self.n = max(ranks.values(), default=0) + 1
        self.vocab: list[bytes] = [b""] * self.n
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.byte_pair = np.full(65536, _NONE, np.int32)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.byte_pair[token[0] << 8 | token[1]] = rank
        self.id_list, self.pair_list = self.byte_id.tolist(), self.byte_pair.tolist()
        self.pairs: dict[int, int] = {}
        self.memo: dict[str, bytes] = {}

    @classmethod
    def parse(cls, raw: bytes, pattern: str, memo_pieces: int | None = None) -> ByteBPE:
        """From the text of a rank file: base64 token and rank per line."""
        return cls({base64.b64decode(t): int(r) for t, r in map(bytes.split, raw.splitlines()) if t}, pattern, memo_pieces)

    def _pair(self, a: int, b: int) -> int:
        """Rank of two neighbouring tokens' bytes, or none."""
        key = a * self.n + b
        rank = self.pairs.get(key)
        if rank is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            rank = self.pairs[key] = self.ranks.get(self.vocab[a] + self.vocab[b], _NONE)
        return rank

    def _lists(self, pieces: list[bytes]) -> tuple:
        """Tokens, pair ranks, links and queue of a few bytes."""
        token, pair, nxt, prv, queue = [], [], [], [], RankQueue(self.n)
        for piece in pieces:
            start, last = len(token), len(token) + len(piece) - 1
            for i, (x, y) in enumerate(zip(piece, piece[1:]), start):
                rank = self.pair_list[x << 8 | y]
                pair.append(rank)
                if rank != _NONE:
                    queue.push(rank, i)
            pair.append(_NONE)
            token += [self.id_list[x] for x in piece]
            nxt += [*range(start + 1, last + 1), _NONE]
            prv += [_NONE, *range(start, last)]
        return token, pair, nxt, prv, queue

    def _arrays(self, pieces: list[bytes], ends: np.ndarray) -> tuple:
        """The same for any number of bytes: compact arrays, filled at once."""
        buf = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(buf)
        token = array("i", self.byte_id[buf].astype(np.int32).tobytes())
        first = np.full(n, _NONE, np.int32)
        first[:-1] = self.byte_pair[buf[:-1].astype(np.int32) << 8 | buf[1:]]
        inner = ends[ends < n]
        first[inner - 1] = _NONE
        queue = RankQueue(self.n)
        at = np.flatnonzero(first != _NONE)
        at = at[np.argsort(first[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(first[at])) + 1
        for part in np.split(at, cuts) if len(at) else []:
            queue.fill(int(first[part[0]]), part.tolist())
        right = np.arange(1, n + 1, dtype=np.int32)
        left = np.arange(-1, n - 1, dtype=np.int32)
        right[ends - 1] = _NONE
        left[np.concatenate([[0], inner])] = _NONE
        return token, array("i", first.tobytes()), array("i", right.tobytes()), array("i", left.tobytes()), queue

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids (little-endian uint32) of each piece (not empty), all through one queue."""
        ends = np.cumsum([len(p) for p in pieces], dtype=np.int64)
        token, pair, nxt, prv, queue = self._lists(pieces) if ends[-1] <= FEW_BYTES else self._arrays(pieces, ends)
        push, rank_of = queue.push, self._pair
        while (lowest := queue.take()) is not None:
            rank, bucket = lowest
            bucket.sort()
            for k, i in enumerate(bucket):
                if pair[i] != rank:
                    continue  # stale: a neighbour was merged meanwhile
                j = nxt[i]
                token[i] = rank
                pair[j] = token[j] = _NONE
                after = nxt[j]
                nxt[i] = after
                new = least = _NONE
                if after != _NONE:
                    prv[after] = i
                    new = rank_of(rank, token[after])
                    if new != _NONE:
                        push(new, i)
                        least = new
                pair[i] = new
                before = prv[i]
                if before != _NONE:
                    new = rank_of(token[before], rank)
                    pair[before] = new
                    if new != _NONE:
                        push(new, before)
                        if least == _NONE or new < least:
                            least = new
                if least != _NONE and least < rank:  # a lower rank came up: it goes first
                    if k + 1 < len(bucket):
                        queue.fill(rank, bucket[k + 1:])
                    break
        ids = np.array(token, np.int32)
        live = np.flatnonzero(ids != _NONE)
        packed = ids[live].astype("<u4").tobytes()
        upto = np.searchsorted(live, ends) * 4
        out, a = [], 0
        for b in upto.tolist():
            out.append(packed[a:b])
            a = b
        return out

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Packed ids of each text; the texts' new pre-tokens are merged together."""
        split = [self.pattern.findall(t) for t in texts]
        found = self.lookup(p for pieces in split for p in pieces)
        for pieces in split:
            yield b"".join(map(found.__getitem__, pieces))

    def lookup(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """A mapping that has the packed ids of every piece given."""
        memo = self.memo
        new = set(pieces).difference(memo)
        if not new:
            return memo
        whole, parts = {}, []
        for p in new:
            raw = p.encode("utf-8")
            rank = self.ranks.get(raw)
            if rank is None:
                parts.append((p, raw))
            else:
                whole[p] = rank.to_bytes(4, "little")
        merged = self.merge([raw for _, raw in parts]) if parts else []
        whole.update((p, ids) for (p, _), ids in zip(parts, merged))
        if len(memo) + len(whole) > (self.memo_pieces or MEMO_PIECES):
            kept = dict(memo)
            kept.update(whole)
            memo.clear()
            memo.update((p, ids) for p, ids in whole.items() if len(p) <= MEMO_BYTES)
            return kept
        if max(map(len, whole)) <= MEMO_BYTES:
            memo.update(whole)
            return memo
        memo.update((p, ids) for p, ids in whole.items() if len(p) <= MEMO_BYTES)
        return {**memo, **whole}

    def decode(self, packed: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        return b"".join(map(self.vocab.__getitem__, array_u4(packed)))


def array_u4(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


_LOADED: dict[tuple, ByteBPE] = {}


def load(raw: bytes, pattern: str, memo_pieces: int | None = None) -> ByteBPE:
    """The tokenizer of a rank file, made once per worker process; it keeps ``memo_pieces`` pre-tokens (or ``MEMO_PIECES``)."""
    key = (hashlib.sha256(raw).hexdigest(), pattern, memo_pieces)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBPE.parse(raw, pattern, memo_pieces)
    return _LOADED[key]


def ship(spark: SparkSession, path: str) -> Broadcast:
    """The rank file, read on the driver and broadcast: a vocabulary's size does not grow with the data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids",
           keep_text: bool = True) -> DataFrame:
    """``docs`` with its token ids packed as little-endian uint32; null texts have none."""
    raw = ship(docs.sparkSession, path)
    keep = [c for c in docs.columns if (keep_text or c != text_col) and c != ids_col]
    schema = StructType([*[f for f in docs.schema.fields if f.name in keep], StructField(ids_col, BinaryType())])

    def run(batches):
        bpe = load(raw.value, pattern)
        for part, _, _ in text_batches(batches, text_col, PIECE_BYTES):
            texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
            ids = pa.array(list(bpe.encode_all(t or "" for t in texts)), pa.binary())
            cols = [part.column(part.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, ids], [*keep, ids_col])

    return docs.mapInArrow(run, schema)


def decode(ids: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``ids`` with the bytes its packed ids decode to; null ids decode to no bytes."""
    raw = ship(ids.sparkSession, path)
    keep = [c for c in ids.columns if c != out_col]
    schema = StructType([*[f for f in ids.schema.fields if f.name in keep], StructField(out_col, BinaryType())])

    def run(batches):
        bpe = load(raw.value, pattern)
        for part in batches:
            packed = part.column(part.schema.get_field_index(ids_col)).to_pylist()
            out = pa.array([bpe.decode(p or b"") for p in packed], pa.binary())
            cols = [part.column(part.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, out], [*keep, out_col])

    return ids.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no tokens and the digests of no bytes. Rows
    that repeat are encoded each; an empty table gives no rows.
    """
    raw = ship(docs.sparkSession, path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):  # both ways in one worker: the vocabulary is held once, ids and bytes stay in the task
        bpe = load(raw.value, pattern)
        for part, _, _ in text_batches(batches, "text", PIECE_BYTES):
            n, ids, decoded = [], [], []
            for packed in bpe.encode_all(t or "" for t in part.column(1).to_pylist()):
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                                              pa.array(decoded, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    x = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return x.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
