"""Byte and word runs of texts as numpy arrays of 64-bit hashes.

Words are hashed eight bytes at a time through a mixing function, in two lanes
that together make 128 bits. Runs of words or bytes are hashed by polynomials
modulo 2**64 with odd bases over such numbers: any run's hash is a difference of
prefix sums times an inverse power, so all windows of all texts of a batch are
hashed by a few array operations. Runs have fewer than 1,024 units, below the
length at which such polynomials have systematic collisions.
"""

from __future__ import annotations

import numpy as np
import xxhash

BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_MASK = (1 << 64) - 1
_TABLE = np.random.default_rng(20240101).integers(0, _MASK, 256, dtype=np.uint64, endpoint=True)
_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)
#: Bytes beyond which a word is hashed on its own.
LONG = 256
_LOW = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**i, or its inverse modulo 2**64, for i below n at least."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        size = max(n, 1 << 12)
        have = np.full(size, step & _MASK, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 1 << 22:
            _powers[(base, inverse)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix(units: np.ndarray, base: int) -> np.ndarray:
    """Sums of units[i] * base**i before each position."""
    out = np.zeros(len(units) + 1, dtype=np.uint64)
    np.cumsum(units * powers(base, len(units)), out=out[1:])
    return out


def runs(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of units[start:end] for each start and end."""
    return mix((sums[ends] - sums[starts]) * powers(base, len(sums), True)[starts])


def windows(sums: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of units[i:i + n] for every i where the window fits."""
    count = len(sums) - n
    if count <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[n:] - sums[:count]) * powers(base, len(sums), True)[:count])


def byte_units(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~is_space(data)
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64 bits of each word: eight bytes at a time are mixed into what the bytes before left."""
    length = ends - starts
    h = mix(length.astype(np.uint64) * np.uint64(BASES[lane]) + np.uint64(_SEEDS[lane]))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    loads = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    live, at = np.flatnonzero(length <= LONG), 0
    while True:
        left = length[live] - at
        live, left = live[left > 0], left[left > 0]
        if not len(live):
            break
        h[live] = mix((h[live] ^ (loads[starts[live] + at] & _LOW[np.minimum(left, 8)])) * np.uint64(BASES[1 - lane]))
        at += 8
    for i in np.flatnonzero(length > LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), _SEEDS[lane])
    return h


def leftmost_minima(values: np.ndarray, m: int) -> np.ndarray:
    """Position of the leftmost smallest of values[i:i + m], for every i."""
    count = len(values) - m + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    at, low, width = np.arange(len(values)), values, 1
    while width * 2 <= m:
        right = low[width:] < low[:-width]
        at = np.where(right, at[width:], at[:-width])
        low = np.where(right, low[width:], low[:-width])
        width *= 2
    rest = m - width
    if rest:
        right = low[rest:] < low[: len(low) - rest]
        at = np.where(right, at[rest:], at[: len(at) - rest])
    return at[:count]


def chunks(texts, size: int = 1 << 20, lower: bool = False):
    """(lo, hi, data, starts, ends): texts lo..hi joined by line feeds, about size bytes at a time.

    texts is an Arrow array of strings; nulls are empty. starts and ends are
    the bytes of each text in data.
    """
    values = [v or b"" for v in texts.cast("binary").to_pylist()]
    lo = 0
    while lo < len(values):
        hi, total = lo, 0
        while hi < len(values) and (hi == lo or total + len(values[hi]) < size):
            total += len(values[hi]) + 1
            hi += 1
        part = values[lo:hi]
        joined = b"\n".join(part)
        lengths = np.array([len(v) for v in part], dtype=np.int64)
        ends = np.cumsum(lengths + 1) - 1
        yield lo, hi, np.frombuffer(joined.lower() if lower else joined, np.uint8), ends - lengths, ends
        lo = hi


def segments(sums: np.ndarray, owner: np.ndarray, window: int, gram: int):
    """(starts, counts, anchors, loops): windows of one owner each, grouped by the gram that anchors them.

    sums are prefix sums by BASES[1]. The anchor of a window is its smallest gram
    hash, so equal windows have equal anchors wherever they stand. A group is a
    run of windows with one anchor, cut after window - gram + 1 of them: it
    starts at units[start] and has count windows. About 2 of window - gram + 2
    units begin a group. loops marks groups in which the anchor's gram stands
    more than once, whose windows may equal one another.
    """
    nothing = np.zeros(0, np.int64)
    units = len(sums) - 1
    if units < window:
        return nothing, nothing, np.zeros(0, np.uint64), np.zeros(0, bool)
    grams = windows(sums, gram, BASES[1])
    at = leftmost_minima(grams, window - gram + 1)
    valid = np.flatnonzero(owner[: len(at)] == owner[window - 1 :])
    if not len(valid):
        return nothing, nothing, np.zeros(0, np.uint64), np.zeros(0, bool)
    at = at[valid]
    value = grams[at]
    new = np.ones(len(valid), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (np.diff(valid) != 1)
    place = np.arange(len(valid))
    new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % (window - gram + 1) == 0
    first = np.flatnonzero(new)
    counts = np.diff(np.concatenate([first, [len(valid)]]))
    return valid[first], counts, value[first], at[first] != at[first + counts - 1]


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the units within any of the spans."""
    step = np.zeros(size + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0
