"""Word shingles of texts as 64-bit hashes, by array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 20
_RNG = np.random.default_rng(23)
#: A random odd word for each byte.
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_weights: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weights(n: int) -> np.ndarray:
    """n odd random words, always the same: what a symbol counts by its place in its word.

    Sums of symbols times such weights, modulo 2**64, tell words apart whatever their structure. Powers of one odd base
    don't: two different words that follow a Thue-Morse sequence for a thousand letters get the same sum.
    """
    kept = _weights.get(0, ())
    if n > len(kept):
        kept = mixed(np.arange(1, max(n, 1 << 12) + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
        if n <= CHUNK_BYTES:
            _weights[0] = kept
    return kept[:n]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    size = max(1 << 16, 1 << (n - 1).bit_length() if n > 1 else 1)
    if size not in _powers:
        _powers.clear()
        up, down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))))
        _powers[size] = up, down
    up, down = _powers[size]
    return up[:n], down[:n]


#: A prime, and two random numbers below it.
PRIME, BASES = np.uint64((1 << 31) - 1), (1102930943, 1886519531)
_prime_powers: dict[int, np.ndarray] = {}


def _prime_powers_of(base: int, n: int) -> np.ndarray:
    """The first n powers of base modulo the prime, as 32-bit numbers."""
    kept = _prime_powers.get(base, ())
    if n > len(kept):
        out = np.ones(-(-n // (1 << 16)) << 16, np.uint32)
        have = 1
        while have < len(out):
            part = out[have : 2 * have]
            part[:] = out[: len(part)] * np.uint64(pow(base, have, int(PRIME))) % PRIME
            have *= 2
        _prime_powers[base] = kept = out
    return kept[:n]


def _prime_power(base: int, exponents: np.ndarray) -> np.ndarray:
    """base to each exponent, modulo the prime."""
    out, square = np.ones(len(exponents), np.uint64), base
    for bit in range(int(exponents.max(initial=0)).bit_length()):
        odd = (exponents >> bit) & 1 == 1
        out[odd] = out[odd] * np.uint64(square) % PRIME
        square = square * square % int(PRIME)
    return out


def prime_sums(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of ranges of bytes, which may overlap: polynomials modulo a prime at two random places.

    Two different strings of n bytes agree in both with a chance of (n / 2**31) ** 2 at most, whatever their structure;
    polynomials modulo a power of two don't keep such a bound.
    """
    out = np.zeros(len(begin), np.uint64)
    for j, base in enumerate(BASES):
        terms = _prime_powers_of(base, len(raw)) * (raw.astype(np.uint64) + np.uint64(1))
        terms %= PRIME
        sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, out=terms)])
        one = (sums[end] - sums[begin]) % PRIME * _prime_power(pow(base, -1, int(PRIME)), begin) % PRIME
        out |= one << np.uint64(31 * j)
    return mixed(out + np.uint64(1))


def word_hashes(data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes other than white space; A-Z count as a-z) of texts in a row, and the text of
    each word. bounds: where the texts begin, and the end of the last."""
    raw = np.frombuffer(data.lower(), np.uint8)
    inside = ~_WHITE[raw]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    begin[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    if not len(begin):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    size = end - begin
    to = np.cumsum(size)
    place = np.arange(to[-1]) - np.repeat(to - size, size)
    terms = _BYTE[raw[inside]] * weights(int(size.max()))[place]
    words = mixed(np.add.reduceat(terms, to - size) + size.astype(np.uint64))
    return words, np.searchsorted(bounds, begin, side="right") - 1


def shingle_sets(texts: list[str | None], width: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks (first text, distinct shingle hashes, where each text's begin and end) of the texts' shingle sets.

    A text with fewer words than width has its whole word sequence as the only shingle; one without words has none.
    The hashes of a text are sorted.
    """
    at = 0
    while at < len(texts):
        data, bounds, i = [], [0], at
        while i < len(texts) and (i == at or bounds[-1] < CHUNK_BYTES):
            data.append((texts[i] or "").encode("utf-8", "replace"))
            bounds.append(bounds[-1] + len(data[-1]))
            i += 1
        n = i - at
        words, owner = word_hashes(b"".join(data), np.array(bounds))
        count = np.bincount(owner, minlength=n)
        first = np.cumsum(count) - count
        weight = mixed(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
        m = max(0, len(words) - width + 1)
        full = np.zeros(m, np.uint64)
        for j in range(width):
            full += words[j : j + m] * weight[j]
        whole = owner[:m] == owner[width - 1 : width - 1 + m]
        values, of = mixed(full[whole]), owner[:m][whole]
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            extra = np.array([(words[first[k] : first[k] + count[k]] * weight[: count[k]]).sum(dtype=np.uint64) + np.uint64(count[k]) for k in short], np.uint64)
            values, of = np.concatenate([values, mixed(~extra)]), np.concatenate([of, short])
        order = np.lexsort((values, of))
        values, of = values[order], of[order]
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
        values, of = values[fresh], of[fresh]
        yield at, values, np.searchsorted(of, np.arange(n + 1))
        at = i
