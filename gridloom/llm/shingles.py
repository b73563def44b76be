"""Hashes of word shingles, and the bits that most of them have."""

from __future__ import annotations

import numpy as np

_SPREAD = np.array([sum((b >> i & 1) << 8 * i for i in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(words: list[bytes], shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, in order, repeats included (of fewer words all; none without words)."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def lower_words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits more than half of the hashes have; 0 of none."""
    n = len(hashes)
    octets = np.zeros((-(-n // 255) * 255, 8), np.uint8)
    octets[:n] = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    counts = np.concatenate([_SPREAD[octets[:, j]].reshape(-1, 255).sum(axis=1).astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64) for j in range(8)])
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])
