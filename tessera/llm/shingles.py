"""Word shingles of whole texts, hashed with numpy over Arrow buffers.

A word is a maximal run of bytes other than [\\x20\\x09-\\x0D] (UTF-8, so no
character is cut); A-Z count as a-z. Texts with fewer words than a shingle
has give one shingle, of all their words; texts without words give none.
"""

from __future__ import annotations

import numpy as np

#: Fixed odd multipliers of shingles and of the finaliser.
STEP = np.uint64(0xD1342543DE82EF95)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes that are hashed at a time; a longer single word is taken whole.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which each input bit reaches each output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_2
    return x ^ (x >> np.uint64(31))


def _random(key: np.ndarray, table: int) -> np.ndarray:
    """Fixed random numbers of keys, other ones for each table."""
    return mix(mix(key.astype(np.uint64) * STEP + np.uint64(2 * table + 1)) + np.uint64(0x9E3779B97F4A7C15))


#: Places of a word whose random numbers are tabled, for each byte and two independent hashes; later places compute theirs.
PLACES = 64
_TABLES = [_random(np.arange(PLACES * 256), t) for t in range(2)]
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and how many words lie before each text."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # a word never reaches over two texts
    begins = ~space
    begins[1:] &= space[:-1] | first[1:n]
    ends = ~space
    ends[:-1] &= space[1:] | first[1:n]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets).astype(np.int64)


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, lower: bool = True, table: int = 0) -> np.ndarray:
    """64-bit hashes of spans that are in order and don't overlap; lower: A-Z count as a-z.

    Tabulation hashing: a random number for each byte at each place of a span,
    added up. Whatever two spans are, they collide with a chance of 2^-64
    over the tables; hashes of the two tables (0, 1) are independent.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(stops, starts[at] + BLOCK, "right")))
        lo, hi = starts[at], stops[to - 1]
        piece = data[lo:hi]
        code = (_LOWER[piece] if lower else piece).astype(np.int32)
        a, b = starts[at:to] - lo, stops[at:to] - lo
        place = np.arange(hi - lo, dtype=np.int32) - np.repeat(a, np.diff(a, append=hi - lo)).astype(np.int32)
        far = np.flatnonzero(place >= PLACES)
        code += place << 8 if not len(far) else np.minimum(place, PLACES - 1) << 8
        value = _TABLES[table][code]
        if len(far):
            value[far] = _random((place[far].astype(np.uint64) << np.uint64(8)) + (code[far] & 255).astype(np.uint64), table)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        out[at:to] = mix(total[b] - total[a])
        at = to
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word, in order, and how many words lie before each text."""
    starts, stops, at = word_spans(data, offsets)
    return span_hashes(data, starts, stops), at


def _rolled(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of word hashes, and the bounds of each text's shingles."""
    count = np.diff(at)
    many = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    bounds = np.concatenate(([0], np.cumsum(many)))
    out = np.empty(int(bounds[-1]), np.uint64)
    if not len(words):
        return out, bounds
    if len(words) >= size:
        rolled = words[: len(words) - size + 1].copy()
        for k in range(1, size):
            rolled *= STEP
            rolled += words[k : len(words) - size + 1 + k]
        inside = np.ones(len(rolled), bool)
        for k in range(1, size):  # windows that begin in the last words of a text reach over its end
            cut = at[1:] - k
            cut = cut[(cut >= at[:-1]) & (cut < len(rolled))]
            inside[cut] = False
        full = np.repeat(count >= size, many)
        out[full] = mix(rolled[inside])
    for n in range(1, size):
        few = np.flatnonzero(count == n)
        if len(few):
            value = words[at[few]].copy()
            for k in range(1, n):
                value = value * STEP + words[at[few] + k]
            out[bounds[few]] = mix(value + np.uint64(n))
    return out, bounds


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles (repeats kept) and the n + 1 bounds of each text's shingles."""
    return _rolled(*word_hashes(data, offsets), size)


def wide_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text its distinct shingles as 2 x n hashes, in order of the first ones: 128 bits that tell them apart."""
    starts, stops, at = word_spans(data, offsets)
    (first, bounds), (second, _) = (_rolled(span_hashes(data, starts, stops, table=t), at, size) for t in (0, 1))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own, where = np.unique(first[a:b], return_index=True)
        out.append(np.stack([own, second[a:b][where]]))
    return out


def in_common(x: np.ndarray, y: np.ndarray) -> int:
    """How many shingles two wide sets share; both hashes count."""
    if not x.shape[1] or not y.shape[1]:
        return 0
    at = np.minimum(np.searchsorted(y[0], x[0]), y.shape[1] - 1)
    return int(((y[0][at] == x[0]) & (y[1][at] == x[1])).sum())


def distinct_sorted(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    return [np.unique(hashes[bounds[i] : bounds[i + 1]]) for i in range(len(bounds) - 1)]


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n pairs of a multiplier (odd) and an addend of the universal family a * x + b mod 2^64."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 64, n, np.uint64, endpoint=False) | np.uint64(1)
    return a, rng.integers(0, 1 << 64, n, np.uint64, endpoint=False)


def minima(hashes: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """For each text and permutation the least permuted hash; all ones where a text has no shingle."""
    out = np.full((len(bounds) - 1, len(a)), np.iinfo(np.uint64).max, np.uint64)
    has = np.flatnonzero(np.diff(bounds))
    lo = 0
    while lo < len(has):
        hi = max(lo + 1, int(np.searchsorted(bounds[has + 1], bounds[has[lo]] + block, "right")))
        rows = has[lo:hi]
        part = hashes[bounds[rows[0]] : bounds[rows[-1] + 1]]
        begin = bounds[rows] - bounds[rows[0]]
        work = np.empty_like(part)
        for k in range(len(a)):
            np.multiply(part, a[k], out=work)
            work += b[k]
            out[rows, k] = np.minimum.reduceat(work, begin)
        lo = hi
    return out
