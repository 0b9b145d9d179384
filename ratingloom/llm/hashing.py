"""Vectorised hashing of words, shingles and byte windows over UTF-8 buffers."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
WHITE = (0x20, *range(0x09, 0x0E))


def byte_class(members) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Bytes of words between ASCII white space, and of words of letters, digits and all beyond ASCII.
NOT_WHITE = ~byte_class(WHITE)
WORD = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
LOWER_TABLE = LOWER.tobytes()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(1)
def letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(BASE))


@lru_cache(2)
def powers(n: int, back: bool) -> np.ndarray:
    """BASE**i, or its inverse, modulo 2**64, for i < n."""
    step = pow(BASE, -1, 1 << 64) if back else BASE
    out = np.ones(n, U64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * U64(pow(step, have, 1 << 64))
        have += more
    return out


def table_size(n: int) -> int:
    return 1 << max(20, int(n).bit_length())


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Polynomial hash of every prefix; n + 1 values."""
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(letters()[buf] * powers(table_size(len(buf) + 1), False)[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each [start, end), the same wherever the bytes stand; the length is mixed in."""
    value = (prefix[end] - prefix[start]) * powers(table_size(len(prefix)), True)[start]
    return mix(value + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def joined(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts, each followed by a line feed, and where each begins (one more at the end)."""
    data = b"\n".join([*texts, b""])
    if lower:
        data = data.translate(LOWER_TABLE)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return np.frombuffer(data, np.uint8), bounds


def word_spans(buf: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of member bytes. The buffer ends with a line feed, which is no member."""
    inside = members[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the `size`-word shingles of each text, one after the other, and where each text's begin.

    Words are runs without ASCII white space, with A-Z in lower case. With fewer words the whole sequence is the one
    shingle; a text without words has none.
    """
    buf, bounds = joined(texts, lower=True)
    start, end = word_spans(buf, NOT_WHITE)
    words = span_hash(prefix_hash(buf), start, end)
    first = np.searchsorted(start, bounds)
    count = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), count)
    within = np.arange(len(words)) - first[owner] if len(words) else np.zeros(0, np.int64)
    have = np.minimum(count, size)[owner]
    value = have.astype(U64) * U64(0xA0761D6478BD642F)
    for k in range(size):
        part = mix(words + U64((k + 1) * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF))
        shifted = np.zeros_like(value)
        shifted[: max(len(part) - k, 0)] = part[k:]
        value = value + np.where(have > k, shifted, U64(0))
    keep = within <= np.maximum(count - size, 0)[owner]
    value, owner = mix(value[keep]), owner[keep]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))
