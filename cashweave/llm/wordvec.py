"""Hashes of words and shingles over whole Arrow batches, without a Python step for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.default_rng(20240607)
#: A random value for each byte; A-Z have those of a-z, so hashes ignore ASCII case.
_VALUES = _rng.integers(0, 1 << 64, 256, dtype=U64)
_VALUES[65:91] = _VALUES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = int(_rng.integers(0, 1 << 62)) * 8 + 3
_KEYS = _rng.integers(0, 1 << 63, 16, dtype=U64) * U64(2) + U64(1)
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word ``[^\\x20\\x09-\\x0D]+``, number of words of each text); NULL is empty."""
    return located(texts)[:2]


def located(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`word_hashes`, the UTF-8 bytes of the texts, and each word's first and last byte in them."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    n = int(offsets[-1] - offsets[0])
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), np.zeros(len(texts), np.int64), np.zeros(0, np.uint8), none, none
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    starts_of_texts = offsets[:-1] - offsets[0]
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    firsts = starts_of_texts[starts_of_texts < n]
    begins[firsts] = solid[firsts]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    lasts = firsts[firsts > 0] - 1
    ends[lasts] = solid[lasts]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    up, down = _power_tables(n)
    sums = np.cumsum(_VALUES[data] * up[:n])
    before = np.where(start > 0, sums[start - 1], U64(0))
    hashes = mix((sums[end] - before) * down[start])
    return hashes, np.diff(np.searchsorted(start, np.append(starts_of_texts, n))), data, start, end


def shingles(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's distinct ``width``-word shingles as sorted 64-bit hashes.

    A text with fewer words has its whole sequence as the one shingle; one without words has none.
    """
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    if len(hashes) >= width:
        full = np.zeros(len(hashes) - width + 1, U64)
        for k in range(width):
            full += hashes[k:len(full) + k] * _KEYS[k]
        full = mix(full)
    out = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(full[end - n:end - width + 1]))
        elif n:
            own = hashes[end - n:end]
            out.append(mix((own * _KEYS[:n]).sum(keepdims=True, dtype=U64) + _KEYS[width:width + 1] * U64(n)))
        else:
            out.append(np.zeros(0, U64))
    return out


def pieces(texts: pa.Array):
    """Cut a batch of texts to runs of about CHUNK_BYTES: yields (first, number of texts)."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
    at, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and total + n > CHUNK_BYTES:
            yield at, i - at
            at, total = i, 0
        total += n
    if len(sizes) > at:
        yield at, len(sizes) - at
