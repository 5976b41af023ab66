"""Word shingles of batches of texts, hashed by vectorised numpy."""

from __future__ import annotations

import numpy as np

WIDTH = 5

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = _rng.integers(1, 2**64, WIDTH, np.uint64) | np.uint64(1)
_SHORT = _rng.integers(1, 2**64, WIDTH, np.uint64)
_CHUNK = 1 << 21


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finisher, so that close sums end far apart."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple:
    """Hashes of the words in bytes, and the number of words before each text's start.

    A word's hash is a polynomial over its bytes, taken from running sums.
    """
    space = _IS_SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    inner = bounds[1:-1]
    inner = inner[inner < len(data)]
    start[inner] = ~space[inner]
    last = ~space
    last[:-1] &= space[1:]
    ends = inner[inner > 0] - 1
    last[ends] = ~space[ends]
    first, end = np.flatnonzero(start), np.flatnonzero(last) + 1
    power = np.full(len(data), _BASE)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power, out=sums[1:])
    back = np.full(len(data), _INVERSE)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    return mixed((sums[end] - sums[first]) * back[first]), np.searchsorted(first, bounds)


def sets_of(texts) -> list:
    """For an Arrow array of texts: the sorted distinct shingle hashes of each, as uint64 arrays.

    Fewer than five words: the whole sequence is one shingle. No words or null: empty.
    """
    import pyarrow as pa

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    out: list = []
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CHUNK, side="right")) - 1)
        to = min(to, len(texts))
        out += _chunk(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to
    return out


def _chunk(data: np.ndarray, bounds: np.ndarray) -> list:
    none = np.zeros(0, np.uint64)
    if not len(data):
        return [none] * (len(bounds) - 1)
    words, index = _words(data, bounds)
    many = len(words) - WIDTH + 1
    if many > 0:
        joined = words[:many] * _PLACE[0]
        for k in range(1, WIDTH):
            joined += words[k : many + k] * _PLACE[k]
        joined = mixed(joined)
    out = []
    for a, b in zip(index[:-1].tolist(), index[1:].tolist()):
        if b - a >= WIDTH:
            out.append(np.unique(joined[a : b - WIDTH + 1]))
        elif b > a:
            whole = (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mixed(whole + _SHORT[b - a]))
        else:
            out.append(none)
    return out


def key_of(held: np.ndarray) -> bytes:
    """16 bytes that name a set: equal sets have equal keys."""
    import hashlib

    return hashlib.blake2b(held.astype("<u8").tobytes(), digest_size=16).digest()
