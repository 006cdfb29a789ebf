"""md5 of many short messages at once: the keys of a batch of texts take millions of digests."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

#: messages worked on together (they stay in a core's cache)
TOGETHER = 1 << 12
#: bytes before the last number of a message, at most
MAX_PREFIX = 48
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2 ** 32)) for i in range(64)]
_START = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


@lru_cache(maxsize=32)
def _numbers(upto: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers below ``upto`` (at most ten million) as digits and md5's end mark in 8 bytes, and their digit counts."""
    ends = np.array([b"%d\x80" % b for b in range(upto)], "S8").view(np.uint8).reshape(upto, 8)
    return ends, ((ends != 0).sum(1) - 1).astype(np.uint16)


def numbered(out: np.ndarray, prefix: bytes) -> None:
    """Fill ``out`` (attempts, blocks, 64 zero bytes) with the messages ``prefix j|b`` of attempts from 1 and blocks from 0, padded for md5."""
    attempts, n, _ = out.shape
    ends, digits = _numbers(1 << (n - 1).bit_length())
    first = 1
    while first <= attempts:  # those with as many digits together
        last = min(10 ** len(str(first)) - 1, attempts)
        heads = b"".join([b"%s%d|" % (prefix, j) for j in range(first, last + 1)])
        size = len(heads) // (last + 1 - first)
        part = out[first - 1:last]
        part[:, :, :size] = np.frombuffer(heads, np.uint8).reshape(-1, 1, size)
        part[:, :, size:size + 8] = ends[:n]
        part[:, :, 56:58] = ((digits[:n] + size) * 8).astype("<u2").view(np.uint8).reshape(n, 2)
        first = last + 1


def _some(words: np.ndarray) -> np.ndarray:
    a, b, c, d = (np.full(words.shape[1], v) for v in _START)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            f, g = d ^ (b & (c ^ d)), i
        elif turn == 1:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif turn == 2:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), (7 * i) % 16
        f += a
        f += words[g]
        f += _SINES[i]
        s = _SHIFTS[turn][i % 4]
        high = f << np.uint32(s)
        f >>= np.uint32(32 - s)
        f |= high
        f += b
        a, d, c, b = d, c, b, f
    return np.stack([x + v for x, v in zip((a, b, c, d), _START)], axis=1)


def digest_keys(messages: np.ndarray) -> np.ndarray:
    """Four keys (8 hex digits each, as numbers) of the digest of each padded message."""
    out = np.empty((len(messages), 4), np.uint32)
    for a in range(0, len(messages), TOGETHER):
        words = np.ascontiguousarray(messages[a:a + TOGETHER].view("<u4").T)
        out[a:a + TOGETHER] = _some(words)
    return out.byteswap()
