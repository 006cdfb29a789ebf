"""Edit-aware token counts: a segment tree over each document's pre-tokens.

The leaves of a document's tree are runs of pre-tokens with their texts,
lengths and token counts; every inner node holds the sums of its subtree. An
edit (position, characters to delete, text to insert) re-matches and
re-encodes only the pre-tokens it touches plus the context that their
boundaries depend on, replaces those leaves and updates the sums on their
paths to the root.

Why the context is enough: matching goes from left to right and looks at the
text from a boundary on, so from a boundary beyond the edit that both old and
new matching share, all later boundaries are the same. On the left, a match
looks at most two characters beyond its end, or to the end of the white space
it stands in; matching restarts before that.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from ..session import ensure_checkpoint_dir
from . import bpe as B
from .common import text_batches

#: pre-tokens per leaf when a tree is built; a leaf that outgrows GROWN times that is dealt anew
LEAF = 32
GROWN = 8
#: what a match may look at beyond its end
LOOK = 2
#: pre-tokens whose ids a worker keeps
MEMO_PIECES = 1_000_000
#: bytes of trees that are edited together
STATE_BYTES = 4 << 20
#: of the derived edits, those of the first round
FIRST = 2
EDIT = "array<struct<pos:bigint,del:bigint,ins:string>>"


#: text, lengths and token counts of a run of pre-tokens
Leaf = tuple[str, np.ndarray, np.ndarray]


class TokenTree:
    """Pre-tokens of one text with subtree sums of characters, tokens and pre-tokens."""

    def __init__(self, tokenizer: B.ByteBPE, leaves: list[Leaf], sums: list[tuple[int, int, int]] | None = None):
        self.tokenizer = tokenizer
        self.reencoded = 0
        self._deal(leaves, sums)

    @classmethod
    def build(cls, tokenizer: B.ByteBPE, text: str) -> TokenTree:
        pieces = tokenizer.pattern.findall(text)
        return cls.of(tokenizer, text, pieces, tokenizer.lookup(pieces))

    @classmethod
    def of(cls, tokenizer: B.ByteBPE, text: str, pieces: list[str], found: dict[str, bytes]) -> TokenTree:
        """The tree of a text whose pre-tokens and their ids are known."""
        if not pieces:
            return cls(tokenizer, [])
        leaves = _cut(text, np.fromiter(map(len, pieces), np.uint32, len(pieces)), counts := _counts(found, pieces))
        tokens = np.add.reduceat(counts, np.arange(0, len(counts), LEAF), dtype=np.int64).tolist()
        return cls(tokenizer, leaves, [(len(leaf[0]), t, len(leaf[1])) for leaf, t in zip(leaves, tokens)])

    def _deal(self, leaves: list[Leaf], sums: list[tuple[int, int, int]] | None = None) -> None:
        """Lay the leaves out under a complete binary tree and sum upwards."""
        self.leaves = leaves or [_EMPTY]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = [(0, 0, 0)] * (2 * self.size)
        self.sums[self.size:self.size + len(self.leaves)] = sums or map(_sum, self.leaves)
        for n in range(self.size - 1, 0, -1):
            a, b = self.sums[2 * n], self.sums[2 * n + 1]
            self.sums[n] = (a[0] + b[0], a[1] + b[1], a[2] + b[2])

    def _set(self, i: int, leaf: Leaf) -> None:
        self.leaves[i] = leaf
        n = self.size + i
        self.sums[n] = _sum(leaf)
        while n > 1:
            n >>= 1
            a, b = self.sums[2 * n], self.sums[2 * n + 1]
            self.sums[n] = (a[0] + b[0], a[1] + b[1], a[2] + b[2])

    n_chars = property(lambda self: self.sums[1][0])
    n_tokens = property(lambda self: self.sums[1][1])
    n_pieces = property(lambda self: self.sums[1][2])

    def find(self, pos: int) -> tuple[int, int]:
        """The leaf that holds character ``pos`` (the last filled one for the end) and where it starts."""
        n, start = 1, 0
        pos = min(pos, max(self.n_chars - 1, 0))
        while n < self.size:
            n *= 2
            if pos - start >= self.sums[n][0]:
                start += self.sums[n][0]
                n += 1
        return min(n - self.size, len(self.leaves) - 1), start

    def tokens_before(self, pos: int) -> int:
        """Tokens of the pre-tokens that end at or before character ``pos``."""
        if pos >= self.n_chars:
            return self.n_tokens
        n, start, total = 1, 0, 0
        while n < self.size:
            n *= 2
            if pos - start >= self.sums[n][0]:
                start += self.sums[n][0]
                total += self.sums[n][1]
                n += 1
        for length, count in _pairs(self.leaves[n - self.size]):
            start += length
            if start > pos:
                break
            total += count
        return total

    def text(self) -> str:
        return "".join(leaf[0] for leaf in self.leaves)

    def take(self, edits: list[dict] | None) -> None:
        """Apply edits in order; null edits and null fields change nothing."""
        for e in edits or []:
            if e is not None:
                self.edit(e["pos"] or 0, e["del"] or 0, e["ins"] or "")

    def edit(self, pos: int, delete: int, insert: str) -> None:
        """Replace ``delete`` characters at ``pos`` by ``insert``; both are held within the text."""
        pos = max(0, min(pos, self.n_chars))
        delete = max(0, min(delete, self.n_chars - pos))
        if not delete and not insert:
            return
        lo, lo_at = self.find(max(pos - 1, 0))
        hi, hi_at = self.find(pos + delete)
        hi = max(hi, lo)
        left = self.leaves[lo][0][:pos - lo_at]
        while lo and len(left.rstrip()) <= LOOK:  # boundaries may depend on the white space before the edit
            lo -= 1
            left = self.leaves[lo][0] + left
        lo_at = pos - len(left)
        keep = len(left.rstrip()) - LOOK  # matches that end here or before stay
        old = [x for i in range(lo, hi + 1) for x in _pairs(self.leaves[i])]
        head, at = 0, 0
        while head < len(old) and at + old[head][0] <= keep:
            at += old[head][0]
            head += 1
        span = "".join(self.leaves[i][0] for i in range(lo, hi + 1))
        shift = len(insert) - delete
        edited = pos - lo_at + len(insert)  # from here on the text is old text
        new_text = span[:pos - lo_at] + insert + span[pos - lo_at + delete:]
        starts, x = {}, 0
        for k, (length, _) in enumerate(old):
            starts[x + shift] = k
            x += length
        starts[x + shift] = len(old)
        pieces, here, tail = [], at, None
        while tail is None:
            if here >= edited and here in starts and (here < len(new_text) or hi == len(self.leaves) - 1):
                tail = starts[here]
                break
            match = self.tokenizer.pattern.match(new_text, here)
            end = match.end() if match else len(new_text)
            if hi < len(self.leaves) - 1 and end > len(new_text) - LOOK - 1:  # needs the text that follows
                hi += 1
                more = self.leaves[hi]
                for length, count in _pairs(more):
                    old.append((length, count))
                    x += length
                    starts[x + shift] = len(old)
                new_text += more[0]
                continue
            if end <= here:
                tail = len(old)
                break
            pieces.append(new_text[here:end])
            here = end
        self.reencoded += len(pieces)
        new = list(zip(map(len, pieces), _counts(self.tokenizer.lookup(pieces), pieces).tolist()))
        run = np.array(old[:head] + new + old[tail:], np.uint32).reshape(-1, 2)
        lens = run[:, 0]
        leaf = (new_text, lens, run[:, 1])
        if len(lens) > GROWN * LEAF:
            self._deal(self.leaves[:lo] + _cut(*leaf) + self.leaves[hi + 1:])
            return
        self._set(lo, leaf)
        for i in range(lo + 1, hi + 1):
            self._set(i, _EMPTY)


_EMPTY: Leaf = ("", np.zeros(0, np.uint32), np.zeros(0, np.uint32))


def _sum(leaf: Leaf) -> tuple[int, int, int]:
    return len(leaf[0]), int(leaf[2].sum()), len(leaf[1])


def _pairs(leaf: Leaf) -> list[tuple[int, int]]:
    return list(zip(leaf[1].tolist(), leaf[2].tolist()))


def _counts(found: dict[str, bytes], pieces: list[str]) -> np.ndarray:
    """Tokens of each piece, from the packed ids."""
    return np.fromiter(map(len, map(found.__getitem__, pieces)), np.uint32, len(pieces)) >> np.uint32(2)


def _cut(text: str, lens: np.ndarray, counts: np.ndarray) -> list[Leaf]:
    """Leaves of ``LEAF`` pre-tokens each; the pre-tokens joined are the text."""
    ends = np.cumsum(lens, dtype=np.int64)
    out, at = [], 0
    for i in range(0, len(lens), LEAF):
        end = int(ends[min(i + LEAF, len(lens)) - 1])
        out.append((text[at:end], lens[i:i + LEAF], counts[i:i + LEAF]))
        at = end
    return out


STATE = ("leaves", "lens", "counts", "per_leaf")


def _pack(leaves: list[Leaf]) -> tuple[list[str], bytes, bytes, bytes]:
    """Leaves as columns: texts, then lengths, counts and pre-tokens per leaf as packed integers.

    Lengths and counts take one, two or four bytes each, as the largest needs.
    """
    full = [leaf for leaf in leaves if len(leaf[1])]
    return ([leaf[0] for leaf in full], _narrow([leaf[1] for leaf in full]), _narrow([leaf[2] for leaf in full]),
            np.array([len(leaf[1]) for leaf in full], "<u4").tobytes())


def _narrow(parts: list[np.ndarray]) -> bytes:
    if not parts:
        return b""
    x = np.concatenate(parts)
    most = int(x.max())
    return x.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _unpack(tokenizer: B.ByteBPE, leaves: list[str], lens: bytes, counts: bytes, per_leaf: bytes) -> TokenTree:
    k = np.frombuffer(per_leaf, "<u4")
    if not len(k):
        return TokenTree(tokenizer, [])
    total = int(k.sum())
    n, c = (np.frombuffer(x, f"<u{len(x) // total}") for x in (lens, counts))
    ends = np.cumsum(k, dtype=np.int64)
    starts = ends - k
    tokens = np.add.reduceat(c, starts, dtype=np.int64).tolist()
    sums = list(zip(map(len, leaves), tokens, k.tolist()))
    out = [(text, n[a:b], c[a:b]) for text, a, b in zip(leaves, starts.tolist(), ends.tolist())]
    return TokenTree(tokenizer, out, sums)


_STATE_FIELDS = [StructField("tree", StructType([StructField("leaves", ArrayType(StringType())),
                                                 *[StructField(c, BinaryType()) for c in STATE[1:]]]))]


def build_trees(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with its text replaced by ``tree``: the kept state of each document.

    A null or empty text has a tree without leaves.
    """
    raw = B.ship(docs.sparkSession, path)
    keep = [c for c in docs.columns if c != text_col]
    fields = [f for f in docs.schema.fields if f.name in keep]

    def run(batches):
        bpe = B.load(raw.value, pattern, MEMO_PIECES)
        for part, _, _ in text_batches(batches, text_col, B.PIECE_BYTES):
            texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
            split = [bpe.pattern.findall(t or "") for t in texts]
            found = bpe.lookup(p for pieces in split for p in pieces)  # one queue for all new pre-tokens
            rows = []
            for text, pieces in zip(texts, split):
                lens = np.fromiter(map(len, pieces), np.uint32, len(pieces))
                rows.append(_pack(_cut(text or "", lens, _counts(found, pieces))))
            cols = [part.column(part.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, _tree_column(rows)], [*keep, "tree"])

    return docs.mapInArrow(run, StructType(fields + _STATE_FIELDS))


def _tree_column(rows: Iterable[tuple]) -> pa.Array:
    rows = list(rows)
    kinds = (pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary())
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(STATE))


def _by_bytes(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
    """Pieces of a batch with about ``STATE_BYTES`` of trees each, by the lengths stored in them."""
    lens = batch.column(batch.schema.get_field_index("tree")).field("lens")
    sizes = pc.fill_null(pc.binary_length(lens), 0).to_numpy(zero_copy_only=False).astype(np.int64) * 8 + 64
    piece = np.cumsum(sizes) // STATE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def apply_edits(state: DataFrame, path: str, pattern: str, edits_col: str = "edits") -> DataFrame:
    """Apply each row's edits in order to its tree.

    ``edits`` is an array of (pos, del, ins); each position is in the text
    that the earlier edits left, and is held within it. Null edits, and null
    fields of an edit, change nothing. Adds n_tokens_before, n_tokens,
    n_pieces, n_reencoded; ``tree`` is the new state.
    """
    raw = B.ship(state.sparkSession, path)
    keep = [c for c in state.columns if c not in ("tree", edits_col, *COUNTS)]  # counts of an earlier round are replaced
    fields = [f for f in state.schema.fields if f.name in keep]
    schema = StructType(fields + _STATE_FIELDS + [StructField(c, LongType()) for c in COUNTS])

    def run(batches):
        bpe = B.load(raw.value, pattern, MEMO_PIECES)
        for batch in batches:
            for part in _by_bytes(batch):
                trees, nums = [], []
                col = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023, E731
                for kept, edits in zip(col("tree").to_pylist(), col(edits_col).to_pylist()):
                    tree = _unpack(bpe, *(kept[k] for k in STATE))
                    before = tree.n_tokens
                    tree.take(edits)
                    trees.append(_pack(tree.leaves))
                    nums.append((before, tree.n_tokens, tree.n_pieces, tree.reencoded))
                cols = [pa.array([n[i] for n in nums], pa.int64()) for i in range(4)]
                yield pa.RecordBatch.from_arrays([*map(col, keep), _tree_column(trees), *cols], [*keep, "tree", *COUNTS])

    return state.mapInArrow(run, schema)


COUNTS = ["n_tokens_before", "n_tokens", "n_pieces", "n_reencoded"]


def derived_edits(id_col: Column, text: Column) -> Column:
    """Three edits that a document's own id and text fix: a replacement, an insertion, a removal.

    They stand in for a log of edits: anywhere in the text, of words, of
    parts of words and of white space.
    """
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    def at(k: int, most: Column) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(k)), most.cast("bigint"))
    def own(k: int, length: Column) -> Column:
        return F.substring(t, (at(k, n + 1) + 1).cast("int"), length.cast("int"))
    def edit(pos: Column, delete: Column, insert: Column) -> Column:
        return F.struct(pos.alias("pos"), delete.cast("bigint").alias("del"), insert.alias("ins"))
    return F.array(edit(at(1, n + 1), at(2, F.lit(60)), own(3, at(4, F.lit(80)))),
                   edit(at(5, n + 1), F.lit(0), F.concat(F.lit("\n "), own(6, at(7, F.lit(30))))),
                   edit(at(8, n + 1), at(9, F.lit(200)), F.lit("")))


def edited_counts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                  folder: str | None = None) -> DataFrame:
    """One row per document, before and after its derived edits.

    The trees are written to ``folder`` (by default a new one in the session's
    shared folder): ``round-0`` as built, ``round-1`` after the first edits,
    which are applied to the state read again; the later edits are applied to
    ``round-1`` read again.

    doc_id, n_edits, n_tokens_before, n_tokens, n_pieces (pre-tokens after),
    n_reencoded (pre-tokens encoded anew, in all rounds), text_sha256 (of the
    edited text). Null and empty texts have an empty tree, which the edits
    fill; texts of any length are read whole, one at a time where they are
    long; rows that repeat are counted each; other columns, whatever their
    names, are not read. An empty table gives no rows.
    """
    folder = folder or f"{ensure_checkpoint_dir(docs.sparkSession)}/trees-{uuid.uuid4().hex}"
    x = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                    derived_edits(F.col(id_col), F.col(text_col)).cast(EDIT).alias("log"))
    state = _kept(build_trees(x, path, pattern), f"{folder}/round-0")
    first = apply_edits(state.withColumn("edits", F.slice("log", 1, FIRST)), path, pattern)
    first = first.withColumnsRenamed({"n_tokens_before": "before", "n_reencoded": "redone"})
    state = _kept(first, f"{folder}/round-1")
    last = apply_edits(state.withColumn("edits", F.slice("log", F.lit(FIRST + 1), F.size("log"))), path, pattern)
    return last.select("doc_id", F.size("log").cast("bigint").alias("n_edits"), F.col("before").alias("n_tokens_before"),
                       "n_tokens", "n_pieces", (F.col("redone") + F.col("n_reencoded")).alias("n_reencoded"),
                       F.sha2(F.array_join("tree.leaves", ""), 256).alias("text_sha256"))


def _kept(state: DataFrame, path: str) -> DataFrame:
    """``state`` written to ``path``, and read from there."""
    state.write.option("compression", "zstd").parquet(path)
    return state.sparkSession.read.schema(state.schema).parquet(path)
