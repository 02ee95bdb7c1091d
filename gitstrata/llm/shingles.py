"""Word shingles of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the public splitmix64 generator."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles.

    Words are runs without white space, A-Z lower-cased. A text with fewer than ``width`` words has its
    whole sequence as one shingle, one without words or null has none. A word's hash is multilinear in
    its bytes, a shingle's in its words' hashes.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    data = _FOLD[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    empty = np.empty(0, np.int64)
    if not len(starts):
        return [empty for _ in raw]
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    data, space = data[starts[0] :], space[starts[0] :]
    with np.errstate(over="ignore"):
        factors = mix(np.arange(int(place.max()) + 1, dtype=np.uint64)) | np.uint64(1)
        values = (data.astype(np.uint64) + np.uint64(1)) * factors[place]
        values[space] = 0
        word = mix(np.add.reduceat(values, starts - starts[0]))
        by = mix(np.arange(1000, 1000 + width, dtype=np.uint64)) | np.uint64(1)
        n = len(word)
        grams = np.zeros(max(n - width + 1, 0), np.uint64)
        for k in range(width):
            grams += word[k : n - width + 1 + k] * by[k] if n >= width else np.uint64(0)
        grams = mix(grams)
        upto = np.searchsorted(starts, ends)
        out, low = [], 0
        for high in upto:
            have = high - low
            if have >= width:
                out.append(np.unique(grams[low : high - width + 1].view(np.int64)))
            elif have:
                out.append(mix(np.array([np.sum(word[low:high] * by[:have]) + np.uint64(have)], np.uint64)).view(np.int64))
            else:
                out.append(empty)
            low = high
    return out


def chunks(sizes: list[int], limit: int = 1_000_000):
    """Ranges of consecutive texts of about ``limit`` characters, for bounded memory; a longer text is its own."""
    low = total = 0
    for k, s in enumerate(sizes):
        if total and total + s > limit:
            yield low, k
            low, total = k, 0
        total += s
    yield low, len(sizes)
