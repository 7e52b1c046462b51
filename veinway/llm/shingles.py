"""Sets of word shingles and their circulant minimum hashes, as numpy helpers for Spark tasks."""

import hashlib

import numpy as np
import xxhash

from veinway.llm.common import kept

FOLD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


class ShingleSets:
    """of(text): the sorted 64-bit hashes of a text's distinct shingles of `words` words.

    A-Z are lower-cased; words are runs of other than white space (0x20, 0x09 to 0x0D). A text
    with fewer words gives its whole sequence as one shingle, without words the set is empty.
    """

    def __init__(self, words: int, remember_mb: int = 60):
        self.words, self.most, self.used = words, remember_mb * 1_000_000, 0  # an entry counts about 200 bytes besides its word
        self.known: dict[bytes, bytes] = {}

    def of(self, text: str | None) -> np.ndarray:
        parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not parts:
            return np.zeros(0, np.uint64)
        known = self.known
        if self.used > self.most:
            known.clear()
            self.used = 0
        for w in [w for w in set(parts) if w not in known]:
            known[w] = xxhash.xxh64_digest(w)
            self.used += 200 + len(w)
        h, k = np.frombuffer(b"".join(map(known.__getitem__, parts)), "<u8"), self.words
        if len(h) < k:
            k = len(h)
        out = h[: len(h) - k + 1] + np.uint64(k)
        for i in range(1, k):
            out = out * FOLD + h[i : len(h) - k + 1 + i]
        return np.unique(mixed(out))


class Circulant:
    """Signatures from two permutations of a ring: one places elements, the other is read at every shift."""

    def __init__(self, bands: int, rows: int, ring_bits: int = 20, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.size = bands, rows, bands * rows
        ring = 1 << ring_bits
        self.first = rng.permutation(ring).astype(np.uint32)
        second = rng.permutation(ring).astype(np.uint32)
        self.shifts = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: self.size]]), self.size)
        self.factors = rng.integers(1, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)

    def signature(self, elements: np.ndarray) -> np.ndarray:
        """Coordinate k is the least value of the second permutation, shifted by k, over the elements' places."""
        at = self.first[(elements & np.uint64(len(self.first) - 1)).astype(np.int64)]
        out = np.full(self.size, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(at), 1024):
            np.minimum(out, self.shifts[at[i : i + 1024]].min(0), out)
        return out

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        parts = signature.reshape(self.bands, self.rows).astype(np.uint64) + np.uint64(1)
        sums = (parts * self.factors).sum(1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64) * FOLD
        return mixed(mixed(sums)).view(np.int64)


def set_digest(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted sets without repeats."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(both) and 100 * both >= percent * (len(a) + len(b) - both)


def shingler(words: int, bands: int, rows: int) -> tuple[ShingleSets, Circulant]:
    """Sets and signatures, once a Python worker."""
    return kept(("shingles", words, bands, rows), lambda: (ShingleSets(words), Circulant(bands, rows)))
