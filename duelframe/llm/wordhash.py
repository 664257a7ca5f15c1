"""64-bit hashes of words and word shingles for whole batches of texts."""

from __future__ import annotations

import numpy as np

#: The six separators of a word: blank, tab, line feed, vertical tab, form feed, return.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_SPACE = np.zeros(256, bool)
_SPACE[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(10)
_BYTES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _RANDOM.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over the word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(max(n, 1 << 20), np.uint64(base))
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z as a-z, text after text, and how many each text has."""
    raw = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    solid = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(solid, prepend=False))
    begins, ends = edges[0::2], edges[1::2]
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * up[: len(raw)], out=sums[1:])
    hashes = mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))
    text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return hashes, np.diff(np.searchsorted(begins, text_ends), prepend=0)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles of `size` words; with fewer
    words, the whole sequence is one shingle; without words there is none."""
    hashes, counts = words(texts)
    rows = len(hashes) - size + 1
    joined = np.zeros(max(rows, 0), np.uint64)
    for i in range(size if rows > 0 else 0):
        joined += hashes[i : i + rows] * _STEPS[i]
    joined = mix(joined)
    out = []
    end = 0
    for n in counts.tolist():
        begin, end = end, end + n
        if n >= size:
            out.append(np.unique(joined[begin : end - size + 1]))
        elif n:
            alone = (hashes[begin:end] * _STEPS[8 : 8 + n]).sum(dtype=np.uint64)
            out.append(mix(np.array([alone + np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
