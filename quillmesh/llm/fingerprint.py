"""SimHash fingerprints of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Hashes whose bits are counted at a time.
_BLOCK = 1 << 16


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """Bit j is set if over half of the shingles' XXH64 have it; shingles count as often as they occur; no words: 0."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()][:n]
    last = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(line)]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(line[a:b], seed) for a, b in zip(starts, last, strict=True)], "<u8"))


def majority(hashes: np.ndarray) -> int:
    """Bit j is set if over half of the hashes have it; of no hashes: 0."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        counts += np.unpackbits(hashes[i : i + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")
