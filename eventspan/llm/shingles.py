"""Word shingles of a text and the fingerprint made of them."""

from __future__ import annotations

import numpy as np

BITS = 64


def shingles(text: str, words: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each of the text's word shingles; of all its words where they are fewer; nothing for a text without words."""
    import xxhash

    hash64 = xxhash.xxh64_intdigest
    w = text.encode("utf-8", "replace").lower().split()
    n = len(w)
    if not n:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(w)
    if n < words:
        hashes = [hash64(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [hash64(joined[a:b], seed) for a, b in zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist())]
    return np.array(hashes, dtype="<u8")


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have; zero without hashes."""
    if not len(h):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """Bit majority of the XXH64 of the text's word shingles; zero for a text without words."""
    return majority(shingles(text, words, seed))
